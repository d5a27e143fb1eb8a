"""Token counts: an exact histogram of encoded lengths with suffix sums.

The histogram answers totals, quantiles and truncated totals for every context
limit without another look at the texts. Null texts count as empty, of length 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm import byte_bpe
from recordloom.llm.common import BATCH_ROWS, cut, in_parts, table

#: Lengths in a block; suffix sums are made within blocks, and over blocks.
BLOCK = 4096


def n_tokens(text: Column, path: str | None = None) -> Column:
    path = path or byte_bpe.model_path()

    @F.pandas_udf("bigint")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids_of = byte_bpe.codec(path).ids
        for texts in in_parts(batches):
            yield pd.Series([len(ids_of(t)) // 4 for t in texts], dtype="int64")

    return lengths(F.coalesce(text, F.lit("")))


def length_histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per length that occurs.

    n_docs and n_tokens: documents of that length and their tokens; docs_ge and tokens_ge: those of
    that length or more; truncated_tokens: all documents' tokens if each is cut at that length;
    share_le: the part of the documents of that length or less.
    """
    counted = docs.select(n_tokens(F.col(text_col), path).alias("length")).groupBy("length").agg(F.count("*").alias("n_docs"))
    counted = cut(counted.withColumn("n_tokens", F.col("length") * F.col("n_docs")), "lengths", BATCH_ROWS)
    block = F.floor(F.col("length") / BLOCK).cast("bigint").alias("block")
    blocks = counted.groupBy(block).agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("docs", "tokens")), F.sum("docs").over(total).alias("all_docs"), F.sum("tokens").over(total).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    ge = counted.withColumn("block", F.floor(F.col("length") / BLOCK).cast("bigint")).join(blocks, "block")
    ge = ge.withColumns({"docs_ge": F.sum("n_docs").over(own) + F.col("docs_after"), "tokens_ge": F.sum("n_tokens").over(own) + F.col("tokens_after")})
    return ge.select(
        "length", "n_docs", "n_tokens", "docs_ge", "tokens_ge",
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("share_le"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: all tokens if each document is cut at limit; null over an empty histogram."""
    return histogram.agg(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")).alias("truncated_tokens"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least that share of the documents don't exceed; null over an empty histogram."""
    return histogram.where(F.col("share_le") >= share).agg(F.min("length").alias("length"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of all documents' encoded lengths; null texts have length 0."""
    return length_histogram(table(spark, sf_dir, "documents"))
