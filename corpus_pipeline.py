"""A corpus pipeline: language, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet in the shared folder and reads it again as the next stage's docs. All
stages but the last return the columns of `documents`. Models are learnt from the
tables of sf_dir, as in the queries of the operators; decisions are on docs.

Null and empty texts are rejected by the first stage; a later one alone takes them as empty.
Repeated rows stay or go together, as do rows of one id in the near-duplicate stage, where
rows without an id stay. An empty table gives an empty result with the same columns. Further
columns, whatever their names, are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bin_slack, language_id, secret_scan, simhash_dedup, toxicity
from recordloom.llm.common import BATCH_ROWS, cut, remainder, table

#: Ids that go to all executors up to this many; beyond it rows are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Fingerprints of each text in the near-duplicate stage, which link in any of them: one alone misses near copies.
PRINTS = 3


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have yet."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; the others get the predicted language."""
    source = table(spark, sf_dir, "documents")
    model = language_id.train(source.where(remainder(F.col("doc_id"), 3) != 1))
    own = _unused(docs, "language")
    found = cut(docs.withColumn(own, language_id.predicted(F.col("text"), model)).where(~F.col(own)["rejected"]), "languages", BATCH_ROWS)
    model.close()
    return found.withColumn("lang", F.col(own)["lang_pred"]).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    source, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(source, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return cut(docs.where(toxicity.scored(F.col("text"), model)["predicted"] == 0), "not-toxic", BATCH_ROWS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays; rows of one id go or stay together, those without an id stay."""
    found = simhash_dedup.near_duplicates(docs, prints=PRINTS)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; no document goes."""
    found = secret_scan.scan_history(docs, secret_scan.new_ledger(spark))
    blob, own = _unused(docs, "blob"), _unused(docs, "spans")
    spans = cut(found.where("spans <> ''").select(F.col("blob").alias(blob), F.col("spans").alias(own)).distinct(), "secrets")
    few = spans.limit(secret_scan.BROADCAST_ROWS + 1).count() <= secret_scan.BROADCAST_ROWS
    met = docs.join(F.broadcast(spans) if few else spans, F.sha2("text", 256) == F.col(blob), "left")
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(secret_scan.redacted(F.col("text"), F.col(own)))
    met = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return cut(met.select(docs.columns), "redacted", BATCH_ROWS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return bin_slack.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("bin_slack", pack),
]

#: Learnt models, hashes and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
