"""Quality rules: a learnt decision list over text statistics, all in DataFrame functions.

From labelled documents, sequential covering learns rules for bad ones. A rule
grows by the threshold condition of the greatest information gain, then loses
last conditions as long as that helps on rows it hasn't grown on, and is kept if
it is precise on both; what it covers is taken away, and the next rule follows. The
list becomes one conditional expression; a document that no rule meets is kept.

Learning works on statistics: the labelled rows, SAMPLE at most, are counted by
the bins of their features, and only these counts reach the driver.

Null texts count as empty: no words, so the base rule fails them. Ratios over
nothing are 0. Labels other than 0 and 1 and rows with a null id teach nothing; of
several labels of an id the least holds. Without labels there are no rules.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import cut, table

#: Labelled rows that rules are learnt from at most: those of the least hashes of their ids.
SAMPLE = 20_000
#: Thresholds of each feature at most: quantiles of the sample.
THRESHOLDS = 16
CONDITIONS, RULES = 4, 16
#: Bad rows that a rule covers at least, and their share of what it covers.
SUPPORT, PRECISION = 5, 0.9

SPACE = r"[ \t-\r]"
WINDOW = 8
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "stop_share", "distinct_share", "line_words")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts (long) and the FEATURES (double) of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = base.select(
        "doc_id",
        F.filter(F.split("text", SPACE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^ \t-\r]")).alias("lines"),
        _without(F.col("text"), SPACE + "+").cast("bigint").alias("word_chars"),
        _without(F.col("text"), r"[^#*$%&|<>]+").cast("bigint").alias("n_symbols"),
        _without(F.col("text"), r"[^\p{Lu}]+").alias("upper"),
        _without(F.col("text"), r"[^0-9]+").alias("digits"),
        _without(F.col("text"), r"[^.!?]+").alias("stops"),
    )
    # Each array is named once and used twice or more, so that it isn't made anew for each element of another.
    hashed = found.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    last = F.size("hashes") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice("hashes", i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    hashed = hashed.withColumn("windows", windows)
    several = F.size(F.array_distinct("windows")) < F.size("windows")
    hashed = hashed.withColumn("by_hash", F.when(several, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = lambda x, k: F.coalesce(F.get("by_hash", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("by_hash", k + 1)["h"] == x["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("by_hash", twice), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    repeated = F.aggregate(starts, start, lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    counted = hashed.select(
        "doc_id", "word_chars", "n_symbols", "upper", "digits", "stops",
        F.size("words").cast("bigint").alias("n_words"),
        F.size(F.array_distinct("hashes")).alias("n_distinct"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _ratio(chars, n).alias("mean_word"), _ratio(F.col("n_symbols"), chars).alias("symbol_share"), _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _ratio(F.col("n_repeat_words"), n).alias("repeat_share"), _ratio(F.col("upper"), chars).alias("upper_share"), _ratio(F.col("digits"), chars).alias("digit_share"),
        _ratio(F.col("stops"), n).alias("stop_share"), _ratio(F.col("n_distinct"), n).alias("distinct_share"), _ratio(n, F.col("n_lines")).alias("line_words"),
    )


@dataclass(frozen=True)
class Condition:
    """feature > threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float
    at: int  # the number of the threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]
#: Bins of the features, and the bad and good rows there.
Cell = tuple[tuple[int, ...], int, int]


def _covers(rule: Rule, bins: tuple[int, ...]) -> bool:
    return all((bins[FEATURES.index(c.feature)] > c.at) == c.above for c in rule)


def _score(rule: Rule, cells: list[Cell]) -> tuple[int, int]:
    got = [(bad, good) for bins, bad, good in cells if _covers(rule, bins)]
    return sum(b for b, _ in got), sum(g for _, g in got)


def _grown(cells: list[Cell], thresholds: dict[str, list[float]]) -> Rule:
    """Conditions are added by FOIL's information gain until none helps, or only bad rows are covered."""
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        bad, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
        if not bad or not good:
            break
        best, gain = None, 1e-9
        for k, name in enumerate(FEATURES):
            by = defaultdict(lambda: [0, 0])
            for bins, b, g in cells:
                by[bins[k]][0] += b
                by[bins[k]][1] += g
            b_below = g_below = 0
            for at, threshold in enumerate(thresholds[name]):
                b_below += by[at][0] if at in by else 0
                g_below += by[at][1] if at in by else 0
                for above, b, g in ((True, bad - b_below, good - g_below), (False, b_below, g_below)):
                    if b >= SUPPORT and (x := b * (math.log2(b / (b + g)) - math.log2(bad / (bad + good)))) > gain:
                        best, gain = Condition(name, above, threshold, at), x
        if best is None:
            break
        rule += (best,)
        cells = [c for c in cells if _covers((best,), c[0])]
    return rule


def _pruned(rule: Rule, cells: list[Cell]) -> Rule:
    def worth(r: Rule) -> float:
        bad, good = _score(r, cells)
        return (bad - good) / (bad + good) if bad + good else -1.0

    return max((rule[:n] for n in range(len(rule), 0, -1)), key=worth, default=())


def decision_list(grow: list[Cell], prune: list[Cell], thresholds: dict[str, list[float]]) -> list[Rule]:
    """Rules for bad rows, in order."""
    rules: list[Rule] = []
    while len(rules) < RULES:
        rule = _pruned(_grown(grow, thresholds), prune)
        if not rule:
            break
        (bad, good), (bad_2, good_2) = _score(rule, grow), _score(rule, prune)
        if bad < SUPPORT or bad < PRECISION * (bad + good) or bad_2 < PRECISION * (bad_2 + good_2):
            break
        rules.append(rule)
        grow = [c for c in grow if not _covers(rule, c[0])]
        prune = [c for c in prune if not _covers(rule, c[0])]
    return rules


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """The decision list of the labelled rows; labels: (id_col, label_col), 1 for good and 0 for bad."""
    own = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("good")).where("key is not null and good in (0, 1)")
    own = own.groupBy("key").agg(F.min("good").alias("good")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    labelled = docs.join(F.broadcast(own.select(F.col("key").alias(id_col), F.col("good").alias("the_label"))), id_col)
    of = statistics(labelled.select(F.struct(F.col(id_col).alias("key"), F.col("the_label").alias("good")).alias("doc_id"), F.col(text_col).alias("text")))
    rows = cut(of.select("doc_id.key", "doc_id.good", *(F.col(c).cast("double").alias(c) for c in FEATURES)), "labelled-statistics")
    shares = [k / THRESHOLDS for k in range(THRESHOLDS)]
    quantiles = rows.agg(*(F.percentile_approx(c, shares, 10_000).alias(c) for c in FEATURES)).first()
    if quantiles[0] is None:
        return []
    thresholds = {c: sorted(set(quantiles[c])) for c in FEATURES}
    bins = [reduce(lambda a, t, c=c: a + (F.col(c) > t).cast("int"), thresholds[c], F.lit(0)).alias(c) for c in FEATURES]
    fold = (F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(3)) == 0).alias("prune")
    cells = rows.select("good", fold, *bins).groupBy("prune", *FEATURES).agg(F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("good")).collect()  # SAMPLE rows at most
    split: dict[bool, list[Cell]] = {True: [], False: []}
    for r in sorted(map(tuple, cells)):
        split[r[0]].append((r[1:-2], r[-2], r[-1]))
    return decision_list(split[False], split[True], thresholds)


def fired(rules: list[Rule]) -> Column:
    """The number of the first rule that a row of statistics() meets, from 1; null if none."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(k)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """statistics() with base_failed, the rule met, and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = statistics(docs, id_col, text_col).withColumns({"base_failed": failed, "rule": fired(rules)})
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; null texts have no words, so the base rule fails them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judged(docs, learn(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
