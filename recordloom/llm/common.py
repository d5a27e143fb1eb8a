"""What the operators of this subpackage share: tables, cuts of the lineage, batches.

Conventions that hold for every operator here:

* An operator selects the columns that it needs by name and ignores the others,
  so further columns, whatever their names, never clash with its own.
* A null text counts as an empty one unless the operator says otherwise.
* Repeated rows are kept: n equal input rows give n equal output rows.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from functools import cache, wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of texts that a Python worker is sent and looks at together; with texts of some MB they still fit in it.
BATCH_ROWS = 256
#: Bytes of a row group of the tables that cut the lineage; a task that writes holds about one.
ROW_GROUP = 16 << 20
#: Hint of joins whose sides grow with the input: Spark judges a table by its file, or by what it was made of, and would broadcast what the driver can't hold.
SHUFFLED = "merge"
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DECODED = "spark.sql.parquet.columnarReaderBatchSize"
_FOR_TASKS: list[tuple[Callable, dict[str, bool]]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, scans: bool = False) -> Iterator[None]:
    """While it lasts, what runs sends Python workers so many rows at a time; then the session's own setting holds again.

    Plans are lazy, so only what runs inside is bounded: operators that send texts to Python write their results inside, by cut().
    scans: scans of Parquet decode as many rows at a time too; with thousands of texts their buffers are what an executor's heap grows by.
    """
    before = {name: spark.conf.get(name) for name in (_BATCHES, *([_DECODED] if scans else []))}
    for name in before:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def for_tasks(make: Callable) -> Callable:
    """functools.cache for what a Python worker keeps from task to task, until in_parts() begins in a task that hasn't asked for it."""
    made, state = cache(make), {"used": False}

    @wraps(make)
    def of(*args):
        state["used"] = True
        return made(*args)

    _FOR_TASKS.append((made, state))
    return of


def in_parts(batches: Iterator[pd.Series | pd.DataFrame], rows: int = BATCH_ROWS) -> Iterator[pd.Series | pd.DataFrame]:
    """The batches in parts of few rows, so that what is made of them stays small where the session sends more; then freed memory goes back.

    What other tasks kept by for_tasks() goes first.
    """
    if idle := [made for made, state in _FOR_TASKS if not state["used"] and made.cache_info().currsize]:
        for made in idle:
            made.cache_clear()
        trim()
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]
    for _, state in _FOR_TASKS:
        state["used"] = False
    trim()


def trim() -> None:
    """Give memory that a worker has freed back to the system: workers live on, and the C library keeps much of it."""
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def local(df: DataFrame) -> pd.DataFrame:
    """The rows of a DataFrame of proven size in the driver, by Arrow whatever the session says: Row objects take many times the memory."""
    return df.toArrow().to_pandas()


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="recordloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, one machine takes a temporary folder, and a cluster is an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir(spark.sparkContext.applicationId)


def cut(df: DataFrame, what: str, rows: int | None = None, scans: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation. rows, scans: see small_batches()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordloom/{what}-{uuid.uuid4().hex}"
    with small_batches(spark, rows, scans) if rows else nullcontext():
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def remainder_of(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus
