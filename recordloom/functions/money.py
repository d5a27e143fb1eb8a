"""Amounts with a symbol, durations, and merging of two records' values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.similarity import levenshtein_similarity, smith_waterman
from recordloom.operators.split import ranked_by


def symbol(money: Column) -> Column:
    """What stands before the first digit."""
    return F.regexp_extract(money, r"^([^0-9]*)(.*)$", 1)


def number(money: Column) -> Column:
    return F.regexp_extract(money, r"^([^0-9]*)(.*)$", 2)


def merge_money(a: Column, b: Column) -> Column:
    """One of two amounts: the mean where symbols agree, dollars before others, a before b. A dash is no symbol."""
    own = lambda c: F.when(symbol(c) == "-", "").otherwise(symbol(c))
    bare = lambda c: F.concat(own(c), number(c))
    mean = F.bround((number(a).try_cast("double") + number(b).try_cast("double")) / 2, 0).cast("bigint").cast("string")
    same = F.when(mean.isNull(), bare(a)).otherwise(F.concat(own(a), mean))
    return F.when(a.isNull(), bare(b)).when(b.isNull(), bare(a)).when(own(a) == own(b), same).when(own(a) == "$", bare(a)).when(own(b) == "$", bare(b)).otherwise(bare(a))


def merge_values(a: Column, b: Column, similarity: Callable[[Column, Column], Column], least: float = 0.6) -> Column:
    """Values of a, then those of b that are like none of a's; null counts for nothing."""
    one, two = F.array_distinct(a), F.array_distinct(b)
    new = F.filter(two, lambda y: ~F.exists(one, lambda x: similarity(x, y) >= least))
    return F.when(a.isNull(), two).when(b.isNull(), one).otherwise(F.concat(one, new))


def merge_titles(title: Column, other: Column, known: Column, least: float = 0.8, similarity: Callable[[Column, Column], Column] = levenshtein_similarity) -> Column:
    """Known alternative titles, with the other title if it is like neither the title nor any of them."""
    titles = F.coalesce(known, F.array().cast("array<string>"))
    like = (similarity(title, other) >= least) | F.exists(titles, lambda x: similarity(x, other) >= least)
    return F.when(other.isNull() | F.coalesce(like, F.lit(False)), titles).otherwise(F.array_append(titles, other))


def merge_numbers(a: Column, b: Column) -> Column:
    """The mean rounded half to even, or whichever is there."""
    return F.coalesce(F.bround((a + b) / 2, 0), a, b)


def merge_ratings(ten: Column, hundred: Column) -> Column:
    """Of ratings out of ten and out of a hundred, to one decimal."""
    return F.when(ten.isNull(), hundred / 10).when(hundred.isNull(), ten).otherwise(F.bround((ten + hundred / 10) / 2, 1))


def minutes(duration: Column) -> Column:
    """Of durations like '1h 20min' or '45m'; null if there is neither part."""
    hours = F.regexp_extract(duration, r"(\d+)\s*h", 1).try_cast("int")
    rest = F.regexp_extract(duration, r"(\d+)\s*m", 1).try_cast("int")
    return F.when(hours.isNull() & rest.isNull(), None).otherwise(F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(rest, F.lit(0)))


MONEY = ("budget", "revenue", "opening_weekend_revenue")
SEVERAL = ("directors", "writers", "cast", "genres", "keywords", "languages", "production_companies", "production_countries")
#: The attributes of a record, in order; those of SEVERAL and alternative_titles are arrays.
ATTRIBUTES = (
    "title", "cast", "directors", "writers", "genres", "keywords", "content_rating", "run_time", "release_year", "languages", "rating", "budget", "revenue", "opening_weekend_revenue",
    "production_companies", "production_countries", "alternative_titles",
)


def merge_records(matches: DataFrame, a: DataFrame, b: DataFrame, id_col: str = "id", similarity: Callable[[Column, Column], Column] = smith_waterman) -> DataFrame:
    """The merged record of each match (l_id, r_id), with `id` from 0 in the order of l_id and r_id, and ATTRIBUTES.

    Title and year are a's; content_rating and run_time whichever is there, of two run times the mean; ratings of a are out of ten,
    those of b out of a hundred. Matches without a record on both sides give nothing.
    """
    left, right = (df.select(F.col(id_col).alias(key), *(F.col(c).alias(f"{key}_{c}") for c in ATTRIBUTES)) for df, key in ((a, "l_id"), (b, "r_id")))
    both = matches.select("l_id", "r_id").join(left, "l_id").join(right, "r_id")
    of = lambda c: (F.col(f"l_id_{c}"), F.col(f"r_id_{c}"))
    merged = {c: merge_money(*of(c)) for c in MONEY} | {c: merge_values(*of(c), similarity) for c in SEVERAL}
    merged |= {"title": of("title")[0], "release_year": of("release_year")[0], "content_rating": F.coalesce(*of("content_rating")), "run_time": merge_numbers(*of("run_time")), "rating": merge_ratings(*of("rating"))}
    merged["alternative_titles"] = merge_titles(*of("title"), of("alternative_titles")[0], similarity=similarity)
    numbered = ranked_by(both, ["l_id", "r_id"], "id")
    return numbered.select("id", *(merged[c].alias(c) for c in ATTRIBUTES))
