"""Secret scans with an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its text. The
ledger holds one row per blob and rule version with what the scan found. A run
scans only pairs of blob and rule version that the ledger lacks, one row of each,
appends them, and joins the findings back to all paths of the blobs.

Which rows are scanned is decided on ids and digests alone. Where the rows to scan
are few, as in a later run, or those to leave are few, as in a first one, they go to
all executors and the texts stay where they are read; where both are many, the
texts are joined by a shuffle.

Null texts count as empty and have no findings. A null doc_id stays null. Repeated
rows, and rows of one blob under several ids or none, share one scan and one row
of the ledger. Every pattern takes time in proportion to the text, however long.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import cut, in_parts, shared_dir, small_batches, table

#: A change to the rules below needs a new version.
RULE_VERSION = "1"
#: Pairs of id and blob, of some 100 bytes each, are sent to all executors up to this many.
BROADCAST_ROWS = 200_000
LEDGER = "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

#: Kind, pattern, group whose length counts, least length, strings of which a text must hold one (in lower case).
RULES = (
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 12, (b"passw", b"secret", b"token", b"api")),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18, (b"akia",)),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16, ()),
    ("pem", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"), 0, 1, (b"private key-----",)),
    ("jwt", re.compile(r"[A-Za-z0-9_.-]+"), 0, 1, (b"eyj",)),  # runs, in which web_tokens() looks
    ("forge", re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}"), 0, 1, (b"gho_", b"ghp_", b"ghs_", b"ghu_", b"ghr_")),
    ("chat", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1, (b"xox",)),
)
BASE = ("assign", "access", "hex")
_HEX_MARKS = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")

Span = tuple[int, int, int]


def web_tokens(run: str) -> list[tuple[int, int]]:
    """Matches of eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,} in a run of such characters and dots, in one pass."""
    fields, starts, out, k = run.split("."), [0], [], 0
    for f in fields:
        starts.append(starts[-1] + len(f) + 1)
    while k + 2 < len(fields):
        at = fields[k].find("eyJ")
        if at >= 0 and len(fields[k]) - at >= 11 and fields[k + 1].startswith("eyJ") and len(fields[k + 1]) >= 11 and len(fields[k + 2]) >= 8:
            out.append((starts[k] + at, starts[k + 2] + len(fields[k + 2])))
            k += 3
        else:
            k += 1
    return out


def spans(text: str) -> list[Span]:
    """(start, rule number, end) of every finding, by start and rule; offsets are code points, end exclusive."""
    data = text.encode("utf-8", "surrogatepass")
    lower, found = data.lower(), []
    for k, (kind, pattern, group, least, needs) in enumerate(RULES):
        if kind == "hex":
            # a run of 16 or more is a maximal run, so shorter ones can be passed over in bytes
            if b"x" * least in data.translate(_HEX_MARKS):
                found += [(m.start(), k, m.end()) for m in _LONG_HEX.finditer(text)]
        elif kind == "jwt":
            if needs[0] in lower:
                found += [(m.start() + a, k, m.start() + b) for m in pattern.finditer(text) for a, b in web_tokens(m[0])]
        elif any(n in lower for n in needs):
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def written(found: list[Span]) -> str:
    return ",".join(f"{RULES[k][0]}:{start}:{end}" for start, k, end in found)


def findings(text: Column) -> Column:
    """Struct of the counts of the base kinds, the digest of the base spans, and all spans."""

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in in_parts(batches):
            rows = []
            for t in texts:
                found = spans(t)
                base = [s for s in found if s[1] < len(BASE)]
                kinds = [s[1] for s in base]
                rows.append((*(kinds.count(k) for k in range(len(BASE))), hashlib.sha256(written(base).encode()).hexdigest(), written(found)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(F.coalesce(text, F.lit("")))


def new_ledger(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/recordloom/ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def read_ledger(spark: SparkSession, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per blob; a blob that two runs scanned at the same time counts once."""
    return spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])


def scan_history(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the unseen blobs of docs, append them to the ledger, and return the findings of every row.

    docs may hold any number of versions of a document, as rows of the same id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = cut(rows.select("doc_id", "blob"), "paths")
    pairs = paths.groupBy("doc_id", "blob").agg(F.count("*").alias("n"))
    chosen = pairs.groupBy("blob").agg(F.min(F.struct("doc_id", "n")).alias("one"))
    chosen = chosen.join(read_ledger(spark, ledger, rule_version).select("blob"), "blob", "left_anti")
    chosen = cut(chosen.select("blob", "one.*"), "to-scan")  # a pair for each unseen blob, with the number of rows that are it
    same = lambda other: (rows["blob"] == other["blob"]) & rows["doc_id"].eqNullSafe(other["doc_id"])
    count = lambda df: df.limit(BROADCAST_ROWS + 1).count()
    n = F.coalesce("n", F.lit(1))
    if (wanted := count(chosen)) <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(chosen), same(chosen)).select(rows["blob"], "text", n.alias("n"))
    else:
        own = F.col("n").isNotNull() & chosen["doc_id"].eqNullSafe(paths["doc_id"])
        marks = paths.distinct().join(chosen, "blob", "left").select(paths["doc_id"], "blob", F.when(own, F.col("n")).otherwise(0).alias("n"))
        marks = cut(marks.where("n <> 1"), "not-once")  # 0: not to scan
        if count(marks) <= BROADCAST_ROWS:
            met = rows.join(F.broadcast(marks), same(marks), "left").select(rows["blob"], "text", n.alias("n")).where("n > 0")
        else:
            met = rows.join(chosen, same(chosen)).select(rows["blob"], "text", n.alias("n"))
    if wanted:
        parted = [met.where("n = 1").select("blob", "text")]
        if chosen.where("n > 1").limit(1).count():
            parted.append(met.where("n > 1").select("blob", "text").dropDuplicates(["blob"]))  # equal rows of equal ids
        for to_scan in parted:
            scanned = to_scan.select("blob", findings(F.col("text")).alias("r")).select("blob", F.lit(rule_version).alias("rule_version"), "r.*")
            with small_batches(spark):
                scanned.write.mode("append").parquet(ledger)
    return paths.join(read_ledger(spark, ledger, rule_version), "blob").select("doc_id", "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redacted(text: Column, spans_text: Column, mask: str = "[secret]") -> Column:
    """The text with every span of scan_history's `spans` replaced; overlapping spans become one mask."""

    @F.pandas_udf("string")
    def mask_spans(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t: str | None, s: str | None) -> str | None:
            if not t or not s:
                return t
            out, done = [], 0
            for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in s.split(",")):
                if start >= done:
                    out += [t[done:start], mask]
                done = max(done, end)
            return "".join(out) + t[done:]

        return pd.Series([one(t, s) for t, s in zip(texts, found)], dtype=object)

    return mask_spans(text, spans_text)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of all documents against an empty ledger, so that the result depends on the table alone."""
    return scan_history(table(spark, sf_dir, "documents"), new_ledger(spark))
