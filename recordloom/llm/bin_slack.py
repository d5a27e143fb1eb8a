"""Best-fit packing by minimum bin slack.

Documents longer than a sequence are cut into full pieces, the first of which
may be shorter. All other lengths lie below the capacity, so a histogram of
lengths, bounded by the capacity, is all that packing needs: for each bin a
bitset subset-sum programme over the lengths still available finds the fullest
combination with the largest length left, and the combination is taken off as
often as the counts allow. Each step uses up a length but for a few, so the
number of steps is bounded by the capacity and not by the number of documents.

Pieces then find their bin by their rank among pieces of the same length. Ranks
are counted in salted groups of about RANKED pieces, so that a length that very
many documents have is never ranked in one task. Salts are of row numbers of the
written pieces, not of ids, so repeated or missing ids don't share one.

Null texts count as empty: one piece of one token, the separator. Repeated rows are
packed each; a null doc_id stays null. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm import byte_bpe
from recordloom.llm.common import BATCH_ROWS, cut, in_parts, table

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of one length that are ranked together, about.
RANKED = 1 << 14
#: Groups that a length of fewer pieces is spread over, if it has 256 for each.
SPREAD = 64


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, repeats included, of a combination with the greatest sum of at most room.

    Bit s of `sums` is set if sum s can be reached. Long lengths come first, and
    the programme stops once the room can be filled, so short ones are kept for later bins.
    """
    full, sums, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (sums | sums << length) & full
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
        if sums >> room & 1:
            break
    left, taken = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths in a bin), of the counts of each length of 1 to capacity."""
    counts, out = {n: c for n, c in histogram.items() if c > 0}, []
    while counts:
        top = max(counts)
        counts[top] -= 1
        taken = [top, *fullest(counts, capacity - top)]
        counts[top] += 1
        times = min(counts[n] // taken.count(n) for n in set(taken))
        for n in taken:
            counts[n] -= times
        counts = {n: c for n, c in counts.items() if c}
        out.append((times, taken))
    return out


def places(packed: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, of them in a bin, first bin, offset): where the ranks of a length go."""
    out, used, bins = [], {}, 0
    for times, taken in packed:
        offset = 0
        for length in sorted(set(taken), reverse=True):
            each = taken.count(length)
            out.append((length, used.get(length, 0), times * each, each, bins, offset))
            used[length] = used.get(length, 0) + times * each
            offset += each * length
        bins += times
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document."""
    path = path or byte_bpe.model_path()
    end = SEPARATOR.to_bytes(4, "little")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = byte_bpe.codec(path).ids
        for b in in_parts(batches):
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = ids_of(text) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    stop = first if not k else at + capacity
                    rows.append((doc_id, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(of, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """pieces() with the sequence and the offset in it of each piece."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, id_col, text_col, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces", BATCH_ROWS)
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = spark.createDataFrame([(length, max(-(-n // RANKED), min(SPREAD, -(-n // 256)))) for length, n in histogram.items()], "length bigint, salts int")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
    firsts, seen = [], {}
    for length, group, n in sorted(tuple(r) for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):  # a row for each RANKED pieces, and SPREAD for each length
        firsts.append((length, group, seen.get(length, 0)))
        seen[length] = seen.get(length, 0) + n
    first = spark.createDataFrame(firsts, "length bigint, salt int, first bigint")
    place = spark.createDataFrame(places(pack(histogram, capacity)), "length bigint, low bigint, n bigint, each bigint, bin bigint, base bigint")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")
    ranked = salted.withColumn("own", F.row_number().over(order)).join(F.broadcast(first), ["length", "salt"]).withColumn("rank", F.col("first") + F.col("own") - 1)
    where = (ranked["length"] == place["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n"))
    in_bin = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(place), where).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("bin") + F.floor(in_bin / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("base") + in_bin % F.col("each") * ranked["length"]).cast("bigint").alias("offset"),
    )


def op8_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; a null text is one piece, the separator."""
    return packed(table(spark, sf_dir, "documents"))
