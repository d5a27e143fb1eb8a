"""Language identification by interpolated Kneser-Ney character language models.

One model per language is learnt from the counts of character trigrams of all
training texts, with every trigram however rare. Its n-grams are kept in sorted
arrays with their probabilities, broadcast language by language, so the driver
holds a few languages at a time and a Python worker holds all; a text gets the
language of the lowest cross-entropy per character.

What follows is calibrated on all training texts, each as one that the models doing
so haven't seen: the texts are dealt to FOLDS by their ids, and models of the other folds
score each of them, whole and in windows of a few letters, so that short texts count too.
A scale and a power of the length, of the highest likelihood there, turn the gaps between
languages into a probability. And of each language it is measured how far its own texts'
cross-entropies spread, by length. A prediction is rejected if its probability lies below
`REJECT_BELOW`, or if its cross-entropy lies further above the language's mean than
all but one in a thousand of those texts. The models that predict are of all training texts.
Sums and counts are taken in Spark, so the driver holds none of the texts' figures.

Null texts and those without a letter are `und`, with score 0, and rejected. Rows
without language or text teach nothing. With nothing to learn from, every text
is `und`. Of equally likely languages the first by name is taken. Repeated rows
count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import BATCH_ROWS, cut, in_parts, local, remainder, table
from recordloom.llm.letters import letters, slices

UNKNOWN = "und"
REJECT_BELOW = 0.5
#: Trigrams that the driver makes models of at a time; a language of more is made alone. None is left out.
MODEL_TRIGRAMS = 1_000_000
#: Folds of the training texts: models of the others score each, to calibrate.
FOLDS = 5
#: Powers of the length and scales among which the likeliest are taken.
POWERS, SCALES = np.linspace(0, 1, 11), np.geomspace(0.001, 20, 45)
#: Characters of the windows of each of these texts.
WINDOWS = (2, 6, 20, 60)
#: Share of a language's own texts beyond whose cross-entropy a prediction is rejected, and deviations that are never too far.
STRANGE, LEAST_FAR = 0.001, 4.0
_MASK = (1 << 21) - 1
_SLOTS = 20
#: Whole texts of a language from which it has a spread of its own, and bins of a step towards a quantile.
_OWN, _BINS = 20, 1024


def _trigrams(chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of each text, the first of which begins with two spaces, and each text's number of them.

    The leading space of a text has no code; a text of n characters has n - 1.
    """
    c = chars.astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    one, two = np.empty_like(c), np.empty_like(c)
    one[1:], two[2:] = c[:-1], c[:-2]
    one[0] = two[0] = two[1:2] = 32
    second = starts[sizes > 1] + 1
    two[second] = 32
    codes = two << 42 | one << 21 | c
    keep = np.ones(len(c), dtype=bool)
    keep[starts] = False
    return codes[keep], sizes - 1


def trigram_counts(docs: DataFrame, text_col: str, lang_col: str, fold: Column) -> DataFrame:
    """(lang, code, n, n0, n1, ...) over all rows with text and language; n0, n1, ...: the count in each fold."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out() -> Iterator[pd.DataFrame]:
            for (lang, fold), parts in held.items():
                codes, n = merged(parts)
                yield pd.DataFrame({"lang": lang, "fold": fold, "code": codes, "n": n})
            held.clear()

        for b in in_parts(batches):
            for key, texts in b.groupby(["lang", "fold"])["text"]:
                for _, pieces in slices(texts.tolist()):
                    codes, _ = _trigrams(*letters(pieces))
                    parts = held.setdefault(key, [])
                    parts.append(np.unique(codes, return_counts=True))
                    if len(parts) > 20:
                        held[key] = [merged(parts)]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 4_000_000:
                yield from out()
        yield from out()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), fold.alias("fold")).dropna()
    of_fold = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS)]
    return rows.mapInPandas(of, "lang string, fold int, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"), *of_fold)


@dataclass
class Order:
    """Sorted contexts with the log2 weight of what they leave to the next order, and sorted n-grams with their probability."""

    contexts: np.ndarray
    left: np.ndarray
    grams: np.ndarray
    seen: np.ndarray

    def find(self, keys: np.ndarray, of: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
        if not len(of):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
        return np.where(of[at] == keys, values[at], default)

    def probability(self, contexts: np.ndarray, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return self.find(grams, self.grams, self.seen, 0.0) + self.find(contexts, self.contexts, self.left, 1.0) * lower


def _order(contexts: np.ndarray, grams: np.ndarray, n: np.ndarray, discount: float) -> Order:
    which, place = np.unique(contexts, return_inverse=True)
    total, kinds = np.bincount(place, weights=n), np.bincount(place)
    by = np.argsort(grams)
    return Order(which, discount * kinds / total, grams[by], (np.maximum(n - discount, 0) / total[place])[by])


def _discount(once: int, twice: int) -> float:
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney over trigram counts of one language."""

    codes: np.ndarray
    n: np.ndarray
    once: int
    twice: int
    alphabet: int
    orders: list[Order] = field(init=False)

    def __post_init__(self) -> None:
        d3 = _discount(self.once, self.twice)
        three = _order(self.codes >> 21, self.codes, self.n, d3)
        pairs, before = np.unique(self.codes & (1 << 42) - 1, return_counts=True)  # distinct characters before each pair
        two = _order(pairs >> 21, pairs, before, _discount((before == 1).sum(), (before == 2).sum()))
        chars, before = np.unique(pairs & _MASK, return_counts=True)
        one = _order(np.zeros(len(chars), np.int64), chars, before, _discount((before == 1).sum(), (before == 2).sum()))
        self.orders = [one, two, three]
        del self.codes, self.n

    def log2(self, codes: np.ndarray) -> np.ndarray:
        one, two, three = self.orders
        p = one.probability(np.zeros(len(codes), np.int64), codes & _MASK, np.full(len(codes), 1 / self.alphabet))
        p = two.probability(codes >> 21 & _MASK, codes & (1 << 42) - 1, p)
        return np.log2(three.probability(codes >> 21, codes, p))


class Languages:
    """The models of all languages, and what turns cross-entropies into a decision.

    A gap of g bits a character over n characters weighs g * n^power * scale; spread: of each language the mean
    cross-entropy, its variance in long texts and that of one character, and the deviations that are too far.
    """

    def __init__(self, names: list[str], models: list[KneserNey | Broadcast], alphabet: int):
        self.names, self.models, self.alphabet = names, models, alphabet
        self.scale, self.power, self.spread = 1.0, 1.0, np.tile([0.0, 0.0, 0.0, np.inf], (max(1, len(names)), 1))
        self.codes = self.values = None

    def close(self) -> None:
        """Take the broadcast models out of the executors' memory; nothing is predicted after."""
        for m in self.models:
            if isinstance(m, Broadcast):
                m.destroy()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"codes": None, "values": None}

    def _all(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([(m.value if isinstance(m, Broadcast) else m).log2(codes) for m in self.models], axis=1).astype(np.float32)

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """Rows of every language's log-probability of each code; those of frequent codes are remembered in a table of fixed size."""
        if self.codes is None:
            self.codes = np.full(1 << _SLOTS, -1, dtype=np.int64)
            self.values = np.zeros((1 << _SLOTS, len(self.models)), dtype=np.float32)
        slots = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).view(np.int64)
        if len(new := np.unique(codes[self.codes[slots] != codes])):
            at = (new.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).view(np.int64)
            # of new codes for one slot the last one stays, in both tables
            last = np.zeros(len(new), dtype=bool)
            last[len(new) - 1 - np.unique(at[::-1], return_index=True)[1]] = True
            self.codes[at[last]], self.values[at[last]] = new[last], self._all(new[last])
        out = self.values[slots]
        if (lost := self.codes[slots] != codes).any():
            some, place = np.unique(codes[lost], return_inverse=True)
            out[lost] = self._all(some)[place]
        return out

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character under each language, and the number of characters, 0 for texts without a letter."""
        bits, n = np.zeros((len(texts), len(self.models))), np.zeros(len(texts), dtype=np.int64)
        for owners, pieces in slices(texts):
            codes, sizes = _trigrams(*letters(pieces))
            if (some := sizes > 0).any():
                starts, values = (np.cumsum(sizes) - sizes)[some], self.log2(codes)
                np.add.at(n, owners[some], sizes[some])
                for k in range(len(self.models)):
                    np.add.at(bits[:, k], owners[some], -np.add.reduceat(values[:, k], starts, dtype=np.float64))
        return bits / np.maximum(n, 1)[:, None], n

    def probabilities(self, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -(bits - bits.min(axis=1, keepdims=True)) * (n[:, None].astype(np.float64) ** self.power * self.scale * np.log(2))
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.models:
            return pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "bits_per_char": np.nan, "rejected": True}, index=range(len(texts)))
        bits, n = self.cross_entropy(["" if t is None else t for t in texts])
        p = self.probabilities(bits, n)
        best = bits.argmin(axis=1)
        rows = np.arange(len(texts))
        score, least, some = p[rows, best], bits[rows, best], n > 0
        out = pd.DataFrame({"lang_pred": np.where(some, np.array(self.names, dtype=object)[best], UNKNOWN), "score": np.where(some, score, 0.0), "bits_per_char": np.where(some, least, np.nan)})
        out["rejected"] = ~some | (score < REJECT_BELOW) | self.strange(best, least, n)
        return out

    def strange(self, lang: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether cross-entropies lie too far above those of the languages' own texts, or above an even guess."""
        mean, long, one, far = self.spread[lang].T
        deviation = np.sqrt(long + one / np.maximum(n, 1))
        return (bits - mean > np.where(np.isinf(far), np.inf, np.where(deviation > 0, far, 0) * deviation)) | (bits > np.log2(self.alphabet))


def likelihoods(bits: np.ndarray, n: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """The log-likelihood of the true languages of some texts at each of POWERS and, within, SCALES."""
    gap = (bits - bits.min(axis=1, keepdims=True)) * np.log(2)
    out = []
    for power in POWERS:
        z = gap * (n.astype(np.float64) ** power)[:, None]
        own = z[np.arange(len(n)), truth]
        out += [np.maximum(-scale * own - np.log(np.exp(-scale * z).sum(axis=1)), np.log(1e-12)).sum() for scale in SCALES]
    return np.array(out)


def quantiles(values: DataFrame, share: float) -> dict[int, float]:
    """Of each key in (key, x) the exact quantile, between the values of the two ranks next to it.

    Bins are counted, then finer ones in the bin of a rank, until it holds a single value: no task or driver gathers a key's values.
    """
    spark, ends, parts = values.sparkSession, {}, {}
    for key, n, low, high in local(values.groupBy("key").agg(F.count("*").alias("n"), F.min("x"), F.max("x"))).itertuples(index=False):
        first, parts[key] = divmod((n - 1) * share, 1)
        for k in (0, 1):
            ends[key, k] = (min(int(first) + k, n - 1), low, high)
    names = list(ends)
    while wanted := [(k, names[k][0], float(low), float(high)) for k, (_, low, high) in enumerate(ends.values()) if low < high]:
        met = values.join(F.broadcast(spark.createDataFrame(wanted, "rank int, key int, low double, high double")), "key").where("x between low and high")
        bins = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * _BINS), F.lit(_BINS - 1)).alias("bin")
        found = local(met.groupBy("rank", bins).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
        for k, group in found.sort_values(["rank", "bin"]).groupby("rank"):
            below = group["n"].cumsum().to_numpy()
            rank = ends[names[k]][0]
            at = int(np.searchsorted(below, rank, side="right"))
            ends[names[k]] = (rank - (int(below[at - 1]) if at else 0), float(group["low"].iloc[at]), float(group["high"].iloc[at]))
    return {key: float(ends[key, 0][1] + (ends[key, 1][1] - ends[key, 0][1]) * part) for key, part in parts.items()}


def calibrate(model: Languages, scored: DataFrame) -> None:
    """Fit scale, power and spread to left_out()'s rows."""
    spark, known = scored.sparkSession, scored.where("lang is not null")
    gap2 = F.pow(F.col("own") - F.col("mean"), 2)
    by = local(known.groupBy("lang").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("own")) / F.sum("n")).alias("mean")))
    if by.empty:
        return
    fit = local(scored.select(F.posexplode("fit").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))).sort_values("at")["v"].to_numpy()
    power, scale = divmod(len(fit) - 1 - int(np.argmax(fit[::-1])), len(SCALES))
    model.power, model.scale = float(POWERS[power]), float(SCALES[scale])
    meant = known.join(F.broadcast(spark.createDataFrame([(r.lang, float(r.mean)) for r in by.itertuples()], "lang string, mean double")), "lang")
    sums = [F.count_if("whole").alias("texts"), F.count_if(~F.col("whole")).alias("windows"), F.sum(F.when(F.col("whole"), gap2).otherwise(0)).alias("long"), F.sum(F.when(~F.col("whole"), gap2 * F.col("n")).otherwise(0)).alias("one")]
    by = by.merge(local(meant.groupBy("lang").agg(*sums)), on="lang").set_index("lang")

    def variances(r: pd.Series) -> tuple[float, float]:
        return (max(r["long"] / r["texts"], 1e-4) if r["texts"] else 0.01), (r["one"] / r["windows"] if r["windows"] else 1.0)

    # all of them together, as number -1, for languages with few texts
    mean, (long, one) = float(np.average(by["mean"], weights=by["n"])), variances(by.sum())
    spread = {-1: [mean, long, one]}
    for k, name in enumerate(model.names):
        if name in by.index and by.loc[name, "texts"] >= _OWN:
            spread[k] = [float(by.loc[name, "mean"]), *variances(by.loc[name])]
    groups = [(k, name, *spread[k][1:]) for k in spread for name in (by.index if k < 0 else [model.names[k]])]
    met = meant.join(F.broadcast(spark.createDataFrame([(k, name, float(a), float(b)) for k, name, a, b in groups], "key int, lang string, long double, one double")), "lang")
    far = quantiles(met.select("key", ((F.col("own") - F.col("mean")) / F.sqrt(F.col("long") + F.col("one") / F.col("n"))).alias("x")), 1 - STRANGE)
    for k, name in enumerate(model.names):
        own = k if k in spread else -1
        model.spread[k] = [*spread[own], max(LEAST_FAR, far[own])]
        if name in by.index:
            model.spread[k, 0] = by.loc[name, "mean"]


def _windows(text: str) -> list[str]:
    """The whole text, and a stretch of each length of WINDOWS from some place in it."""
    at = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    return [text, *(text[at % max(1, len(text) - w + 1) :][:w] for w in WINDOWS)]


def _models(spark: SparkSession, counts: DataFrame, alphabet: int) -> Languages:
    """The models of (lang, code, n), made of a few languages at a time and broadcast each."""
    by_count = local(counts.groupBy("lang", F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("k")))
    groups, total = [], 0
    for lang, k in by_count.groupby("lang")["k"].sum().items():
        if not groups or total + k > MODEL_TRIGRAMS:
            groups.append([])
            total = 0
        groups[-1].append(lang)
        total += k
    names, models = [], []
    for group in groups:
        rows = local(counts.where(F.col("lang").isin(group)).select("lang", "code", "n")).sort_values(["lang", "code"])
        for lang, part in rows.groupby("lang"):
            of = by_count[by_count["lang"] == lang].set_index("n")["k"]
            names.append(lang)
            made = KneserNey(part["code"].to_numpy(np.int64), part["n"].to_numpy(np.int64), int(of.get(1, 0)), int(of.get(2, 0)), alphabet)
            models.append(spark.sparkContext.broadcast(made))
    return Languages(names, models, alphabet)


def left_out(rows: DataFrame, asker: Languages, names: list[str], alphabet: int) -> DataFrame:
    """Of (lang, text) the rows (lang, whole, n, own) of each text with a letter and a language that asker knows, and of each of its windows.

    own: bits per character under its language, n: characters. A row of no lang for each task has the likelihoods() of its texts in `fit`.
    """
    number, each = {name: k for k, name in enumerate(names)}, len(WINDOWS) + 1

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit = np.zeros(len(POWERS) * len(SCALES))
        place, met = [number[x] for x in asker.names], set(asker.names)
        for b in in_parts(batches):
            some_bits, n = asker.cross_entropy([w for t in b["text"] for w in _windows(t)])
            # a language that only these texts have is one that no text resembles
            bits = np.full((len(n), len(names)), np.log2(alphabet) + 20)
            bits[:, place] = some_bits
            langs = np.repeat(b["lang"].to_numpy(object), each)
            truth = np.array([number[x] if x in met else -1 for x in langs], dtype=int)
            some = (n > 0) & (truth >= 0)
            bits, n, langs, truth, whole = bits[some], n[some], langs[some], truth[some], np.tile(np.arange(each) == 0, len(b))[some]
            if len(n):
                fit += likelihoods(bits, n, truth)
                yield pd.DataFrame({"lang": langs, "whole": whole, "n": n, "own": bits[np.arange(len(n)), truth], "fit": None})
        yield pd.DataFrame({"lang": [None], "whole": [None], "n": [None], "own": [None], "fit": [fit.tolist()]})

    return cut(rows.mapInPandas(of, "lang string, whole boolean, n bigint, own double, fit array<double>"), "left-out", BATCH_ROWS)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Languages:
    """Models of every language in docs, of the counts of all their texts, calibrated on all of them."""
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit("left out")), F.lit(FOLDS)).cast("int")
    counts = cut(trigram_counts(docs, text_col, lang_col, fold), "trigrams", BATCH_ROWS)
    alphabet = counts.select(F.col("code").bitwiseAND(F.lit(_MASK))).distinct().count() + 1
    model = _models(spark, counts, alphabet)
    scored = []
    for k in range(FOLDS if model.models else 0):
        asker = _models(spark, counts.select("lang", "code", (F.col("n") - F.col(f"n{k}")).alias("n")).where("n > 0"), alphabet)
        if asker.models:
            rows = docs.where(fold == k).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
            scored.append(left_out(rows, asker, model.names, alphabet))
            asker.close()
    if scored:
        calibrate(model, reduce(DataFrame.union, scored))
    return model


def predicted(text: Column, model: Languages) -> Column:
    """Struct of lang_pred, score, bits_per_char and rejected."""

    @F.pandas_udf("lang_pred string, score double, bits_per_char double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in in_parts(batches):
            yield model.predict(texts.tolist())

    return of.asNondeterministic()(text)  # else a filter on the prediction and its use predict twice


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from those not held out; of null texts and those without a letter `und`."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = train(docs.where(~held_out))
    found = cut(docs.select("doc_id", held_out.alias("held_out"), predicted(F.col("text"), model).alias("r")).select("doc_id", "held_out", "r.*"), "languages", BATCH_ROWS)
    model.close()
    return found
