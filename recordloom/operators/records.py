"""Record operators: key checks, exclusions, cleaning, profiling, reshaping."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTINELS = ("NA", "null", "not available", "nan", "", "-")


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="recordloom-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a table in the folder of spark.checkpoint.dir, which outlives lost executors, and read back.

    Unlike checkpoint() it runs the plan once. Where no folder is named, one machine takes a temporary one, and a cluster is an error.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own_dir(spark.sparkContext.applicationId)
    path = f"{path}/recordloom/core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def assert_key(df: DataFrame, key: str) -> DataFrame:
    """df, if the key is unique and never null."""
    if df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).count():
        raise ValueError(f"{key} is no key")
    return df


def assert_reference(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """df, if each of its keys is one of other's."""
    if df.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti").limit(1).count():
        raise ValueError(f"{key} has values that {other_key} lacks")
    return df


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    several = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(several, keys, "left_semi")


def without_pairs(df: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(bad.select(*keys).distinct(), keys, "left_anti")


def nulled(df: DataFrame, columns: list[str], sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """In-band marks of missing values become null."""
    return df.withColumns({c: F.when(~F.trim(F.col(c)).isin(*sentinels), F.col(c)) for c in columns})


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: least, greatest, mean, population deviation, nulls; one pass over the data."""
    each = [F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_pop(F.col(c).cast("double")).alias("stddev"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns]
    return df.agg(F.array(*each).alias("p")).select(F.inline("p"))


def column_types(df: DataFrame, columns: list[str], many: int = 20) -> DataFrame:
    """(column, n_distinct, has_null, kind) of string columns: binary, numerical or categorical.

    Values are counted as (column, value) pairs, each once after a partial count, so rows are not copied for each distinct count.
    """
    found = distinct_values(df, columns)
    numbers = F.coalesce(F.bool_and(F.when(F.col("value").isNotNull(), F.col("value").try_cast("double").isNotNull())), F.lit(True))
    found = found.groupBy("column").agg(F.count("value").alias("n_distinct"), (F.count_if(F.col("value").isNull()) > 0).alias("has_null"), numbers.alias("numbers"))
    kind = F.when(F.col("n_distinct") == 2, "binary").when(F.col("numbers") & (F.col("n_distinct") > many), "numerical").otherwise("categorical")
    return found.select("column", "n_distinct", "has_null", kind.alias("kind"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each column has each value, null among them."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def binary_code(df: DataFrame, column: str, name: str) -> DataFrame:
    """The number, 0 or 1, of a column's value among its two values in order; more values are an error, null stays null."""
    values = sorted(r[0] for r in df.select(column).dropna().distinct().limit(3).collect())
    if len(values) > 2:
        raise ValueError(f"{column} has more than two values")
    code = F.lit(None).cast("int")
    for k, v in enumerate(values):
        code = F.when(F.col(column) == v, k).otherwise(code)
    return df.withColumn(name, code)


#: Values of a column that become columns, at most; a column of more is no category.
LEVELS = 2_000


def one_hot(df: DataFrame, column: str, values: list | None = None) -> DataFrame:
    """df with a 0/1 column `column_value` for each value, in order. Without values, they are read first, LEVELS at most."""
    if values is None:
        values = sorted(r[0] for r in df.select(column).dropna().distinct().limit(LEVELS + 1).collect())
        if len(values) > LEVELS:
            raise ValueError(f"{column} has over {LEVELS} values")
    return df.select("*", *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values))


def transposed(df: DataFrame, name: str, columns: list[str], key: str, names: list) -> DataFrame:
    """Rows become columns: one row per column of df in `key`, one column per value of `name`; of several the least value."""
    return df.unpivot([name], columns, key, "_v").groupBy(key).pivot(name, names).agg(F.min("_v"))


def collected(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """(keys, rows): the rows of each key as one ordered array of structs, for groups that are known to be small."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *(v for v in values if v not in order)))).alias("rows"))


def without_missing(df: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a null in columns that have any, and the keys of the others."""
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
    return df.where(~missing), df.where(missing).select(key)


def with_key(df: DataFrame, prefix: str, number: str, name: str = "id") -> DataFrame:
    """df with a key like a0, a1 made of a row number."""
    return df.select(F.concat(F.lit(prefix), F.col(number).cast("string")).alias(name), *(c for c in df.columns if c != number))


def bucket(value: Column, bounds: list[float]) -> Column:
    """0 below the first bound, 1 below the second, and so on; null for null."""
    out = F.lit(len(bounds))
    for k, b in reversed(list(enumerate(bounds))):
        out = F.when(value < b, F.lit(k)).otherwise(out)
    return F.when(value.isNotNull(), out)


def impute_mean(df: DataFrame, columns: list[str], by: DataFrame | None = None) -> DataFrame:
    """Nulls become the mean of df's own column, or of by's: a single row, so it is broadcast."""
    means = (df if by is None else by).agg(*(F.avg(c).alias(f"_mean_{c}") for c in columns))
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}")) for c in columns}).drop(*means.columns)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
