"""Files: delimited, text and parquet readers; overwriting and incremental writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.operators.records import assert_key, assert_reference, nulled
from recordloom.operators.split import ranked_by


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, separator: str = ",", header: bool = True) -> DataFrame:
    """Typed by the schema; without one, every column is a string."""
    reader = spark.read.options(header=header, sep=separator, quote='"', escape='"', multiLine=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_keyed(spark: SparkSession, path: str, key: str, schema: StructType | str | None = None, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """A CSV whose key is unique, and whose columns named in references are keys of other tables: {column: (table, its key)}."""
    rows = assert_key(read_csv(spark, path, schema), key)
    for column, (other, other_key) in (references or {}).items():
        assert_reference(rows, column, other, other_key)
    return rows


def read_tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All strings, with marks of missing values as nulls."""
    rows = read_csv(spark, path, separator="\t", header=header)
    return nulled(rows, rows.columns)


def read_gene_rows(spark: SparkSession, path: str, genes: list[str]) -> DataFrame:
    """Rows of a gene matrix whose symbol or id is wanted; the filter is part of the scan."""
    rows = read_csv(spark, path, separator="\t")
    return rows.where(F.col(rows.columns[0]).isin(genes) | F.col(rows.columns[1]).isin(genes))


def read_titles(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("movie", "short", "tvSeries")) -> DataFrame:
    """(word) of a TSV with a header: the third column where the second is one of kinds."""
    rows = read_csv(spark, path, separator="\t")
    return rows.where(F.col(rows.columns[1]).isin(*kinds)).select(F.col(rows.columns[2]).alias("word"))


def read_column(spark: SparkSession, path: str, numbers: tuple[int, ...] = (0,), separator: str = ",", header: bool = False) -> DataFrame:
    """(word): distinct values of some columns of a delimited file, a gazetteer of names."""
    rows = read_csv(spark, path, separator=separator, header=header)
    return rows.select(F.explode(F.array(*(F.col(rows.columns[n]) for n in numbers))).alias("word")).dropna().distinct()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(number, url) of lines like '12 https://...'."""
    parts = F.split("value", " ", 2)
    return read_lines(spark, path).select(F.get(parts, 0).try_cast("bigint").alias("number"), F.get(parts, 1).alias("url"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(filename, folder) of the files under a path, without their content."""
    whole = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.format("binaryFile").load(path).select(F.element_at(whole, -1).alias("filename"), F.element_at(whole, -2).alias("folder"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): trimmed lines that aren't empty."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_vectors(spark: SparkSession, path: str, width: int = 60) -> DataFrame:
    """(vector, label) of a CSV of that many numbers and a label."""
    rows = read_csv(spark, path)
    return rows.select(F.array(*(F.col(c).cast("double") for c in rows.columns[:width])).alias("vector"), F.col(rows.columns[width]).alias("label"))


def write_csv(df: DataFrame, path: str, index: list[str] | None = None) -> None:
    """index: columns by whose order rows get a number, from 0, as the first column."""
    if index:
        df = ranked_by(df, index, "index").select("index", *df.columns)
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_documents(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(text).write.mode("overwrite").text(path)


def materialised(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made first if it isn't there."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def new_rows(batch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key isn't done yet."""
    return batch.join(done.select(*keys).distinct(), keys, "left_anti")


def append_new(batch: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows of a batch whose keys the table at path lacks, and read the table; a second call changes nothing."""
    spark = batch.sparkSession
    done = materialised(spark, path, lambda: batch.limit(0))
    new_rows(batch, done, keys).write.mode("append").parquet(path)
    return spark.read.schema(done.schema).parquet(path)
