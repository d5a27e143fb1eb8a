"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are character n-grams of the letters of a text (lower case, anything else
one space), hashed to 2^HASH_BITS, each counted once a text. From labelled texts
come each n-gram's document counts in both classes; every n-gram of the labelled
texts is a feature, whose value in a text is the log ratio of the smoothed counts,
drawn towards zero the less it exceeds its standard error (z): by z^2 / (z^2 + SHRINK).
Counts are smoothed in proportion to the classes. A logistic model with a quadratic penalty is fitted on all of them: the texts'
features stay in partitions, which give a gradient for each step of a limited-memory
quasi-Newton method.

The labelled sample is bounded by SAMPLE texts of each class, the ones of the
least hashes of their ids; the weights give the classes their full counts again.

Null and empty texts have no features and so the score of the intercept. Rows with
a null id or label teach nothing; of several labels of an id the largest holds, and
of several rows of a labelled id the text that comes last. With texts of one class
alone, or none, every score is that class's share, or 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import BATCH_ROWS, cut, in_parts, local, remainder, small_batches, table, trim
from recordloom.llm.letters import letters, slices

#: Lengths of the n-grams, and bits of their hashes.
ORDERS = (4, 5)
HASH_BITS = 18
#: Labelled texts of each class that the model is fitted on at most.
SAMPLE = 8_192
#: Weight of the squared weights; steps of the fit at most; partitions that the bounded sample's features are in.
PENALTY, STEPS, PARTITIONS = 0.3, 60, 12
#: Smoothing of the counts, and how far ratios are drawn to zero; with PENALTY by cross-validation on training labels.
SMOOTHING, SHRINK = 4.0, 25.0
#: Texts whose features are in one row, and such rows that a worker gets together: small ones, as each step of the fit reads all of them again.
_PACK, _PACKS = 32, 8


def _slots(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashes of all n-grams of the pieces, one piece after another, and each piece's number of them."""
    chars, sizes = letters(pieces)
    ends, h = np.cumsum(sizes), np.zeros(len(chars), dtype=np.uint32)
    for k in range(max(ORDERS)):
        if k + 1 > len(chars):
            break
        h = h[: len(chars) - k] * np.uint32(0x01000193) + chars[k:] * np.uint32(0x9E3779B1)
        if k + 1 in ORDERS:
            slot = ((h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS)
            whole = np.ones(len(h), dtype=bool)
            for j in range(k):  # those that reach into the next piece
                at = ends[:-1] - 1 - j
                whole[at[(at >= 0) & (at < len(whole))]] = False
            yield slot[whole].astype(np.int32), np.maximum(sizes - k, 0)


def distinct(texts: list[str]) -> list[np.ndarray]:
    """Of each text the hashes of its n-grams, each once, in no order.

    Every hash writes its place in a table, and stays if it is still there: the last of equal ones.
    """
    out: list[list[np.ndarray]] = [[] for _ in texts]
    table = np.zeros(1 << HASH_BITS, dtype=np.int32)
    for owners, pieces in slices(texts):
        found = list(_slots(pieces))
        bounds = [np.concatenate([[0], np.cumsum(sizes)]) for _, sizes in found]
        for k, owner in enumerate(owners):
            own = [slot[b[k] : b[k + 1]] for (slot, _), b in zip(found, bounds)]
            if own and (codes := np.concatenate(own)).size:
                place = np.arange(len(codes), dtype=np.int32)
                table[codes] = place
                out[owner].append(codes[table[codes] == place])
    none = np.zeros(0, np.int32)
    return [none if not o else o[0] if len(o) == 1 else np.unique(np.concatenate(o)) for o in out]


def gaps(own: list[np.ndarray]) -> bytes:
    """The sorted hashes of a few texts, one text after another, as gaps: a byte each, and one of 255 more for each 255 in a gap."""
    keys = np.concatenate([np.sort(codes).astype(np.int64) + (k << HASH_BITS) for k, codes in enumerate(own)])
    more, rest = np.divmod(np.diff(keys, prepend=0), 255)
    out = np.full(int(more.sum()) + len(rest), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def of_gaps(written: bytes, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """What gaps() was given: the hashes one after another, and each text's number of them."""
    raw = np.frombuffer(written, np.uint8)
    keys = np.cumsum(raw, dtype=np.int32)[raw != 255]
    return keys & (1 << HASH_BITS) - 1, np.bincount(keys >> HASH_BITS, minlength=texts)


@dataclass
class Classifier:
    """weights: of each hash, times its log ratio; 0 for n-grams that no labelled text has."""

    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        if self.weights.any():
            z += [self.weights[codes].sum() for codes in distinct(["" if t is None else t for t in texts])]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def log_ratios(n0: np.ndarray, n1: np.ndarray, texts_0: int, texts_1: int) -> np.ndarray:
    """Log ratios of the shares of both classes' texts that have an n-gram, smoothed and drawn towards zero."""
    share = texts_1 / (texts_0 + texts_1)
    a0, a1 = SMOOTHING * (1 - share), SMOOTHING * share
    r = np.log((n1 + a1) / (texts_1 + a1)) - np.log((n0 + a0) / (texts_0 + a0))
    z2 = r * r / (1 / (n0 + 1) + 1 / (n1 + 1))
    return r * z2 / (z2 + SHRINK)


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = STEPS, memory: int = 5, least: float = 1e-3) -> np.ndarray:
    """Where a convex function is least, from its values and gradients, by L-BFGS with halved steps."""
    value, g = f(x)
    first, pairs = max(1e-12, float(np.abs(g).max())), []
    for _ in range(steps):
        if np.abs(g).max() <= least * first:
            break
        d, alphas = -g, []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * y
        d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.linalg.norm(g))))
        for (s, y, rho), alpha in zip(pairs, reversed(alphas)):
            d = d + s * (alpha - rho * (y @ d))
        slope, size = float(g @ d), 1.0
        for _ in range(20):
            new_value, new_g = f(x + size * d)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * d, new_g - g
        x, value, g = x + s, new_value, new_g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s.astype(np.float32), y.astype(np.float32), float(1 / (s @ y)))]
    return x


def loss(codes: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """Weighted logistic loss of texts, whose features follow one another, and its gradient by feature and by the intercept."""
    starts, some, z = np.cumsum(sizes) - sizes, sizes > 0, np.full(len(sizes), b)
    if some.any():
        z[some] += np.add.reduceat(w[codes], starts[some])
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    miss = weight * (p - y)
    value = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    return value, np.bincount(codes, weights=np.repeat(miss, sizes), minlength=len(w)), float(miss.sum())


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Classifier:
    """The classifier of the labelled rows of docs; labels: (id_col, label_col) with 1 for toxic."""
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).where("key is not null and y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    present = cut(own.join(docs.groupBy(F.col(id_col).alias("key")).agg(F.count("*").alias("rows")), "key"), "labelled")
    totals = {r["y"]: r["n"] for r in present.groupBy("y").agg(F.count("*").alias("n")).collect()}
    size = 1 << HASH_BITS
    if len(totals) < 2:
        share = float(next(iter(totals), 0))
        return Classifier(np.zeros(size), 700.0 if share else -700.0)
    of = lambda y: present.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    sample = of(0).union(of(1))  # 2 * SAMPLE rows at most
    rows = texts.join(F.broadcast(sample.where("rows = 1")), "key").select("y", "text")
    if sample.where("rows > 1").limit(1).count():  # one row of each id
        several = texts.join(F.broadcast(sample.where("rows > 1")), "key").groupBy("key", "y").agg(F.max("text").alias("text"))
        rows = rows.union(several.select("y", "text"))
    share = {y: totals[y] / min(totals[y], SAMPLE) for y in (0, 1)}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in in_parts(batches, _PACK):
            yield pd.DataFrame({"codes": [gaps(distinct(b["text"].tolist()))], "y": [b["y"].to_numpy("i1").tobytes()]})

    # However the table's files are split, as many tasks read it as wrote it: each sends the driver numbers for all features.
    packed = cut(rows.repartition(PARTITIONS).mapInPandas(pack, "codes binary, y binary"), "labelled-features", _PACK, scans=True).coalesce(PARTITIONS)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            for codes, y in zip(b["codes"], b["y"]):
                yield *of_gaps(codes, len(y)), np.frombuffer(y, "i1")
        trim()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, size), dtype=np.int64)
        for codes, sizes, y in opened(batches):
            owner = np.repeat(y, sizes)
            for k in (0, 1):
                n[k] += np.bincount(codes[owner == k], minlength=size)
        if n.any():
            yield pd.DataFrame({"n": [n.astype(kind).tobytes()]})

    kind = np.min_scalar_type(SAMPLE)  # holds the count of any feature: texts of a class
    with small_batches(spark, _PACKS, scans=True):
        parts = local(packed.mapInPandas(count, "n binary"))  # PARTITIONS rows at most
    n0, n1 = sum((np.frombuffer(n, kind).astype(np.int64) for n in parts["n"]), np.zeros(2 * size, np.int64)).reshape(2, size)
    some, ratio = n0 + n1 > 0, np.zeros(size)
    ratio[some] = log_ratios(n0[some], n1[some], *(min(totals[y], SAMPLE) for y in (0, 1)))

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast((ratio * x[:-1], float(x[-1])))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, b = shared.value
            value, g, of_b = 0.0, np.zeros(size), 0.0
            for codes, sizes, y in opened(batches):
                v, more, more_b = loss(codes, sizes, y, np.where(y == 1, share[1], share[0]), w, b)
                value, g, of_b = value + v, g + more, of_b + more_b
            if g.any() or of_b:
                yield pd.DataFrame({"value": [value], "g": [g.astype("<f4").tobytes()], "b": [of_b]})

        with small_batches(spark, _PACKS, scans=True):
            parts = local(packed.mapInPandas(part, "value double, g binary, b double"))  # PARTITIONS rows at most
        shared.destroy()
        g = ratio * sum((np.frombuffer(g, "<f4").astype(np.float64) for g in parts["g"]), np.zeros(size)) + PENALTY * x[:-1]
        return float(parts["value"].sum()) + PENALTY / 2 * float(x[:-1] @ x[:-1]), np.append(g, parts["b"].sum())

    start = np.zeros(size + 1)
    start[-1] = np.log(totals[1] / totals[0])
    x = minimum(objective, start)
    return Classifier(ratio * x[:-1], float(x[-1]))


def scored(text: Column, model: Classifier) -> Column:
    """Struct of score and predicted."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("score double, predicted int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in in_parts(batches):
            score = shared.value.score(texts.tolist())
            yield pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype("int32")})

    return of(text)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learnt from labels not held out; null and empty texts have the score of the intercept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train(docs, labels.where(~held_out))
    return cut(docs.select("doc_id", held_out.alias("held_out"), scored(F.col("text"), model).alias("r")).select("doc_id", "held_out", "r.*"), "toxicity", BATCH_ROWS, scans=True)
