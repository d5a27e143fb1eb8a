"""SimHash near-dedup: Golay-code fuzzy hashing of 64-bit fingerprints.

Fingerprint: each bit is set if it is set in over half of the XXH64 hashes of
a text's word shingles. Two fingerprints link at `DISTANCE` = 4 or fewer
differing bits. Candidates come from the perfect (23, 12, 7) Golay code:

* A fingerprint is cut in three segments of 23, 23 and 18 bits (the last one
  counts as a 23-bit vector with five zeros). Decoding a segment, and all
  vectors one bit away from it, to the nearest codeword gives a few 12-bit
  indices, usually one or six.
* Pigeonhole: of four errors over three segments, either two segments have at
  most one each, or the errors are (0, 2, 2) in some order.
* One error at most in both segments of a pair: x's index of the first and any of
  its near indices of the second, against any near index of the first and the
  index of the second. Exactly one key of x then meets one key of y.
* (0, 2, 2): equal segment, and a near index of another segment in common; two
  vectors at distance two share the codeword of a vector between them.

The join verifies the distance and keeps a pair only under the first rule that
finds it, so close pairs aren't emitted once for each key they share. Equal
fingerprints are one class before the join; its members are never paired.

Several fingerprints, of the same hashes mixed anew, may be taken of each text, which
then link if they do in any of them: near copies whose distance in one fingerprint
happens to be 5 or 6 are close enough in another.

Nulls and empty texts have fingerprint zero and link like any other. A null
doc_id belongs to its class, but never names a component unless all ids are null.
Repeated rows are of one class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import BATCH_ROWS, SHUFFLED, cut, in_parts, table
from recordloom.llm.components import components

DISTANCE = 4
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Shift and width of the segments, from the low end of the fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """The hashes themselves for number 0, else other hashes made of them."""
    if not number:
        return hashes
    h = hashes + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprints(text: str | None, words: int = 4, prints: int = 1) -> list[int]:
    """64-bit SimHashes of a text's word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * prints
    joined = b" ".join(tokens)
    ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes, out = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n], ends[-n:])), np.uint64, n), []
    for number in range(prints):
        planes = _mixed(hashes, number).astype(">u8").view(np.uint8).reshape(n, 8)
        if n < 400:
            set_bits = np.unpackbits(planes, axis=1).sum(axis=0, dtype=np.int64)
        else:
            set_bits = np.concatenate([np.bincount(planes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
        out.append(int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big"))
    return out


def fingerprint(text: str | None, words: int = 4) -> int:
    return fingerprints(text, words)[0]


def fingerprint_columns(text: Column, words: int = 4, prints: int = 1) -> Column:
    """Struct of the fingerprints fp0, fp1, ... as signed longs."""
    names = [f"fp{k}" for k in range(prints)]

    @F.pandas_udf(", ".join(f"{n} bigint" for n in names))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in in_parts(batches):
            yield pd.DataFrame(np.array([fingerprints(t, words, prints) for t in texts], dtype=np.uint64).view(np.int64), columns=names)

    return of(F.coalesce(text, F.lit("")))


@cache
def golay_table() -> np.ndarray:
    """Of each 23-bit vector, the 12-bit index of the nearest codeword: the code is perfect with radius 3."""
    index = np.arange(4096, dtype=np.int64)
    code = np.zeros(4096, dtype=np.int64)
    for bit in range(12):
        code ^= np.where(index >> bit & 1, GENERATOR << bit, 0)
    one = [1 << i for i in range(23)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    out = np.empty(1 << 23, dtype=np.int16)
    for e in errors:
        out[code ^ e] = index
    return out


def _near(segment: np.ndarray, width: int) -> np.ndarray:
    """Rows of the distinct codeword indices within one bit of each segment, sorted; -1 pads."""
    flips = np.array([0, *(1 << i for i in range(width))], dtype=np.int64)
    found = np.sort(golay_table()[segment[:, None] ^ flips[None, :]].astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def _keys(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Left and right join keys of each fingerprint.

    A key is rule << 46 | first << 23 | second: rules 0 to 2 for PAIRS, 3 to 5 for an equal segment.
    """
    bits = prints.view(np.uint64)
    part = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    mid = [golay_table()[p].astype(np.int64) for p in part]
    near = [_near(p, w) for p, (_, w) in zip(part, SEGMENTS)]
    left, right = [], []
    for rule, (a, b) in enumerate(PAIRS):
        left.append(np.where(near[a] >= 0, rule << 46 | near[a] << 23 | mid[b][:, None], -1))
        right.append(np.where(near[b] >= 0, rule << 46 | mid[a][:, None] << 23 | near[b], -1))
    for a in range(3):
        b = (a + 1) % 3
        same = np.where(near[b] >= 0, (3 + a) << 46 | part[a][:, None] << 23 | near[b], -1)
        left.append(same)
        right.append(same)
    pick = lambda rows: [r[r >= 0] for r in np.concatenate(rows, axis=1)]
    return pick(left), pick(right)


def _exploded(classes: DataFrame, side: int) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["keys"] = _keys(b["fp"].to_numpy(np.int64))[side]
                yield b[["rep", "fp", "keys"]]

    rows = classes.select("rep", "fp").mapInPandas(of, "rep bigint, fp bigint, keys array<bigint>")
    return rows.select("rep", "fp", F.explode("keys").alias("key"))


def _differ(shift: int = 0, width: int = 64) -> Column:
    both = F.expr("a_fp ^ b_fp")
    return F.bit_count(both if width == 64 else F.shiftrightunsigned(both, shift).bitwiseAND(F.lit((1 << width) - 1)))


def links(classes: DataFrame) -> DataFrame:
    """Classes (rep, fp: distinct) to the pairs (u, v) of reps whose fingerprints link, each once."""
    a = _exploded(classes, 0).select("key", F.col("rep").alias("u"), F.col("fp").alias("a_fp"))
    b = _exploded(classes, 1).select("key", F.col("rep").alias("v"), F.col("fp").alias("b_fp"))
    parts = [_differ(s, w) <= 1 for s, w in SEGMENTS]
    first = F.when(parts[0] & parts[1], 0).when(parts[0] & parts[2], 1).when(parts[1] & parts[2], 2)
    equal = [_differ(s, w) == 0 for s, w in SEGMENTS]
    rule = F.coalesce(first, F.when(equal[0], 3).when(equal[1], 4).when(equal[2], 5))
    found = a.join(b.hint(SHUFFLED), (a["key"] == b["key"]) & (F.col("a_fp") < F.col("b_fp")) & (_differ() <= DISTANCE) & (rule == F.shiftright(a["key"], 46)))
    return found.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, prints: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; component_id is the smallest id reachable by links in any of `prints` fingerprints."""
    names = [f"fp{k}" for k in range(prints)]
    printed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), fingerprint_columns(F.col(text_col), words, prints).alias("r"))
    printed = cut(printed.select("doc_id", "r.*"), "fingerprints", BATCH_ROWS)
    # A class is named by its smallest id; a class with null ids alone is named below all ids, and so by no id.
    # Repeated ids may stand in several classes, so nodes have numbers of their own.
    classes = cut(printed.groupBy(*names).agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = []
    for name in names:
        reps = classes.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("rep"))
        if prints > 1:
            reps = cut(reps, "reps")
            edges.append(classes.select(F.col(name).alias("fp"), F.col("node").alias("u")).join(reps.hint(SHUFFLED), "fp").select("u", F.col("rep").alias("v")).where("u <> v"))
        edges.append(links(reps))
    found = components(reduce(DataFrame.union, edges))
    rooted = classes.join(found.hint(SHUFFLED), "node", "left").select(*names, "doc_id", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = rooted.join(named.hint(SHUFFLED), "root").select(*names, "component_id")
    return printed.join(of_class.hint(SHUFFLED), names).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document; null texts are empty, rows of no id stay without one."""
    return near_duplicates(table(spark, sf_dir, "documents"))
