"""Language-model scoring by online logistic context mixing.

A text (A-Z in lower case) is a sequence of bytes and one end symbol, a byte a
path of eight bits. For the contexts of the last one to five bytes, it is
counted how often each bit was 0 and 1 behind each context and path. A mixer
adds up the log-odds of the five orders with weights that are chosen by a gate: how
far the word has come, and how often the longer contexts were seen. An adaptive
map over the path so far and the mixed odds refines the probability.

There are three mixers: one for text that the corpus doesn't hold, learnt with one
occurrence of each event left out of the counts; one for text that it holds, learnt
without; and one of the short contexts alone, for text unlike the corpus. Each text
is scored online: it starts with even odds for the mixers, and after every byte
their odds are multiplied by what they gave the byte. A byte's probability is the
mean over the mixers by the odds so far. The products telescope, so that a text's
probability comes from the sums of its bytes' log-probabilities by mixer, in
any order (online()); it depends on the text and the model alone.

An event is a byte with the five before it. What the corpus says is the count
of each event, over all training text; bit counts, weights and maps are all
made of these counts. Bit counts are exact and of every context, however many
there are. Contexts are hashed to shards of about SHARD events, with all counts of
the longer contexts that they need; counts of the last one and two bytes, 2^24
at most, are broadcast. Shards are cut by a hash of the context and the number of
events alone, and weights are learnt online over each shard's events in an order by
hash, then averaged, twice over; so the model doesn't depend on the partitions or
the cluster. A context of three bytes that many events share is dealt by four, each
part with a copy of the counts behind the three.

Scores of the most frequent events, EVENT_HEAD at most, are broadcast; the other
events of each text meet theirs in a join.

The base score is a unigram model over words with one added to each count.
Counts of the most frequent words, HEAD at most, are broadcast; the other words
of each text meet theirs in a join, and none of them is frequent.

Null texts count as empty: the end symbol alone. A null doc_id counts as the
empty text in the split. With no training text every bit is even odds. Repeated rows
are scored each, and count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import BATCH_ROWS, cut, in_parts, local, remainder, table

ORDERS = 5
#: Words whose counts are broadcast at most.
HEAD = 1 << 17
#: Events whose scores are broadcast at most.
EVENT_HEAD = 1 << 19
#: Bytes of a context whose counts are broadcast; one more and the counts stay in their shard.
SHORT = 2
#: Events of a shard, about; events of a context of three bytes from which it is dealt by four.
SHARD, HOT = 1 << 16, 1 << 12
#: Bytes since the last separator (up to five), and how often the two longest contexts were seen.
GATES = 6 * 5 * 5
#: Occurrences left out of the counts, and longest context, of each mixer.
MIXERS = ((1.0, 5), (0.0, 5), (1.0, 3))
BINS, LIMIT = 33, 8.0
STEP, BATCH, EPOCHS = 0.05, 4096, 2
_SLOTS = 21
#: Bytes that are looked at together; events whose counts a worker holds back before it merges them, and passes them on.
_BLOCK = 1 << 21
_RAW, _HELD = 1 << 22, 4_000_000


def _events(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the events of each text, the end symbol with it, and their number by text; no text sees another."""
    gap = b"\0" * ORDERS
    raw = np.frombuffer(gap + b"".join([d + b"\0" + gap for d in data]), dtype=np.uint8)
    code = np.zeros(len(raw) - ORDERS, dtype=np.uint64)
    for k in range(ORDERS + 1):
        code = code << np.uint64(8) | raw[k : len(raw) - ORDERS + k]
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    keep = np.ones(len(code), dtype=bool)
    ends = np.cumsum(sizes + ORDERS)
    for k in range(ORDERS):
        keep[ends - 1 - k] = False
    return code[keep], sizes


def _blocks(data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owners, codes) in bounded blocks; a longer text goes on in the next block with the context it had."""
    held, owners, total = [], [], 0
    for k, d in enumerate(data):
        if len(d) >= _BLOCK:
            raw = np.frombuffer(b"\0" * ORDERS + d + b"\0", dtype=np.uint8)
            for at in range(0, len(d) + 1, _BLOCK):
                part = raw[at : at + _BLOCK + ORDERS]
                code = np.zeros(len(part) - ORDERS, dtype=np.uint64)
                for j in range(ORDERS + 1):
                    code = code << np.uint64(8) | part[j : len(part) - ORDERS + j]
                yield np.array([k]), code, np.array([len(code)])
            continue
        if held and total + len(d) > _BLOCK:
            yield np.array(owners), *_events(held)
            held, owners, total = [], [], 0
        held.append(d)
        owners.append(k)
        total += len(d)
    if held:
        yield np.array(owners), *_events(held)


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def corpus_counts(docs: DataFrame, text_col: str, learn: Column) -> DataFrame:
    """(word, code, n): counts in the rows to learn from of words, of the end token as the empty word, and of events; one of word and code is null.

    Events of the other rows are there too, with count 0 if no row to learn from has them.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[bytes] = Counter()
        raw: dict[bool, list[np.ndarray]] = {True: [], False: []}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted(learnt: bool) -> None:
            if raw[learnt]:
                codes, n = np.unique(np.concatenate(raw[learnt]), return_counts=True)
                held.append((codes, n if learnt else np.zeros(len(codes), np.int64)))
                raw[learnt].clear()

        def out() -> Iterator[pd.DataFrame]:
            counted(True)
            counted(False)
            if words:
                yield pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in words], "code": pd.array([None] * len(words), dtype="Int64"), "n": list(words.values())})
            if held:
                codes, place = np.unique(np.concatenate([p[0] for p in held]), return_inverse=True)
                n = np.bincount(place, weights=np.concatenate([p[1] for p in held])).astype(np.int64)
                for at in range(0, len(codes), 100_000):
                    some = codes[at : at + 100_000].view(np.int64)
                    yield pd.DataFrame({"word": pd.Series([None] * len(some), dtype=object), "code": pd.array(some, dtype="Int64"), "n": n[at : at + 100_000]})
            words.clear()
            held.clear()

        for b in in_parts(batches, 1024):
            for learnt in (True, False):
                data = [_lower(t) for t in b["text"][b["learn"].to_numpy(bool) == learnt]]
                if learnt and data:
                    for d in data:
                        words.update(d.split())
                    words[b""] += len(data)
                for _, codes, _ in _blocks(data):
                    raw[learnt].append(codes)
                    if sum(map(len, raw[learnt])) > _RAW:
                        counted(learnt)
            if len(words) > 400_000 or sum(len(p[0]) for p in held) > _HELD:
                yield from out()
        yield from out()

    return docs.select(F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")).mapInPandas(of, "word string, code bigint, n bigint")


def _key(codes: np.ndarray, order: int) -> np.ndarray:
    """Each event's byte with the last `order` bytes before it."""
    return codes & np.uint64((1 << 8 * (order + 1)) - 1)


class Counts:
    """Sorted keys, each a context with its byte, and the sums of their counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, place = np.unique(keys, return_inverse=True)
        self.sums = np.concatenate([[0.0], np.cumsum(np.bincount(place, weights=n, minlength=len(self.keys)))])

    def totals(self, keys: np.ndarray) -> np.ndarray:
        """Rows of how often the context of each key was met with the first 0 to 8 bits of its byte."""
        own, place = np.unique(keys, return_inverse=True)
        out = np.empty((9, len(own)))
        for j in range(9):
            low = own >> np.uint64(8 - j) << np.uint64(8 - j)
            out[j] = self.sums[np.searchsorted(self.keys, low + np.uint64(1 << 8 - j))] - self.sums[np.searchsorted(self.keys, low)]
        return out[:, place]


class Nodes:
    """Exact bit counts of some events under every order's context.

    short: counts of short contexts; codes and n: all events of the others' longer contexts; third: counts behind
    contexts of three bytes of which not all events are here, as (keys, counts).
    """

    def __init__(self, short: list[Counts], codes: np.ndarray, n: np.ndarray, third: tuple[np.ndarray, np.ndarray] | None = None, of: np.ndarray | None = None):
        orders = list(short)
        for k in range(len(short) + 1, ORDERS + 1):
            keys, many = _key(codes, k), n
            if k == 3 and third is not None and len(third[0]):
                whole, first = np.unique(third[0], return_index=True)  # two parts of a context bring the same copies
                apart = np.isin(keys >> np.uint64(8), np.unique(whole >> np.uint64(8)), invert=True)
                keys, many = np.concatenate([whole, keys[apart]]), np.concatenate([third[1][first], n[apart]])
            orders.append(Counts(keys, many))
        self.codes = codes if of is None else of
        self.totals = np.stack([c.totals(_key(self.codes, k + 1)) for k, c in enumerate(orders)])

    def bits(self, some: np.ndarray | slice = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(the bit of each event, path before the bit, counts of 0 and 1 by order), for the eight bits of the events' bytes."""
        totals, byte = self.totals[:, :, some], (self.codes[some] & np.uint64(255)).astype(np.int64)
        path = np.ones(len(byte), dtype=np.int64)
        for j in range(8):
            bit = byte >> (7 - j) & 1
            own, other = totals[:, j + 1], totals[:, j] - totals[:, j + 1]
            yield bit, path, np.stack([np.where(bit == 1, other, own), np.where(bit == 1, own, other)], axis=2)
            path = path * 2 + bit


def _since(codes: np.ndarray) -> np.ndarray:
    """Bytes of the context behind its last separator."""
    out, open_ = np.zeros(len(codes), dtype=np.int64), np.ones(len(codes), dtype=bool)
    for k in range(1, ORDERS + 1):
        open_ &= (codes >> np.uint64(8 * k) & np.uint64(255)) > 32
        out += open_
    return out


def _level(total: np.ndarray) -> np.ndarray:
    return np.digitize(total, (0.5, 1.5, 3.5, 15.5))


class Mixer:
    """Predicts bits from counts: for each of MIXERS weights by gate, and the map that refines the mixed probability."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(MIXERS), GATES, ORDERS + 1))
        for w, (_, longest) in zip(self.weights, MIXERS):
            w[:, :longest] = 1 / longest
        centers = 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, BINS)))
        self.map = np.tile(centers, (len(MIXERS), 256, 1))

    @staticmethod
    def inputs(n: np.ndarray, bit: np.ndarray, since: np.ndarray, taken: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the orders with a constant, and gates; `taken` occurrences of the bit are left out of the counts n."""
        if taken:
            n = n.copy()
            n[..., 0] = np.maximum(n[..., 0] - taken * (1 - bit), 0)
            n[..., 1] = np.maximum(n[..., 1] - taken * bit, 0)
        x = np.empty((ORDERS + 1, n.shape[1]))
        x[:ORDERS] = np.log((n[..., 1] + 0.4) / (n[..., 0] + 0.4))
        x[ORDERS] = 0.3
        total = n.sum(axis=2)
        return x, (since * 5 + _level(total[4])) * 5 + _level(total[3])

    def mixed(self, m: int, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ni,in->n", self.weights[m][gate], x), -LIMIT, LIMIT)

    @staticmethod
    def bins(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (z + LIMIT) * ((BINS - 1) / (2 * LIMIT))
        low = np.minimum(at.astype(np.int64), BINS - 2)
        return low, at - low

    def refined(self, m: int, z: np.ndarray, path: np.ndarray) -> np.ndarray:
        low, part = self.bins(z)
        own = self.map[m, path, low] * (1 - part) + self.map[m, path, low + 1] * part
        return 0.5 * own + 0.5 / (1 + np.exp(-z))

    def learn(self, nodes: Nodes, n: np.ndarray) -> None:
        """One online pass over the events of nodes, which occurred n times each, in the order of a hash."""
        power = np.full_like(self.weights, 1e-4)
        order = np.argsort(nodes.codes * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            many, since = n[some], _since(nodes.codes[some])
            for bit, _, counts in nodes.bits(some):
                made = {taken: self.inputs(counts, bit, since, taken) for taken in {m[0] for m in MIXERS}}
                for m, (taken, longest) in enumerate(MIXERS):
                    x, gate = made[taken]
                    miss = many * (bit - 1 / (1 + np.exp(-self.mixed(m, x, gate))))
                    per = np.bincount(gate, weights=many, minlength=GATES)  # steps are means over a gate's events, whatever their counts
                    for i in [*range(longest), ORDERS]:
                        g = np.bincount(gate, weights=miss * x[i], minlength=GATES) / np.maximum(per, 1)
                        power[m, :, i] += g * g
                        self.weights[m, :, i] += STEP * g / np.sqrt(power[m, :, i])

    def map_counts(self, nodes: Nodes, n: np.ndarray) -> np.ndarray:
        """Weighted ones and all bits of each cell of the maps, over the events of nodes, which occurred n times each."""
        out, size = np.zeros((len(MIXERS), 2, 256 * BINS)), 256 * BINS
        for at in range(0, len(n), 1 << 16):
            some = slice(at, at + (1 << 16))
            since, own = _since(nodes.codes[some]), n[some]
            for bit, path, counts in nodes.bits(some):
                made = {taken: self.inputs(counts, bit, since, taken) for taken in {m[0] for m in MIXERS}}
                for m, (taken, _) in enumerate(MIXERS):
                    low, part = self.bins(self.mixed(m, *made[taken]))
                    cell = path * BINS + low
                    for c, w in ((cell, own * (1 - part)), (cell + 1, own * part)):
                        out[m, 0] += np.bincount(c, weights=w * bit, minlength=size)
                        out[m, 1] += np.bincount(c, weights=w, minlength=size)
        return out

    def log10(self, nodes: Nodes) -> np.ndarray:
        """Rows of every mixer's log-probability of each event's byte."""
        out = np.zeros((len(MIXERS), len(nodes.codes)))
        for at in range(0, len(nodes.codes), 1 << 16):
            some = slice(at, at + (1 << 16))
            since = _since(nodes.codes[some])
            for bit, path, counts in nodes.bits(some):
                x, gate = self.inputs(counts, bit, since)
                for m in range(len(MIXERS)):
                    p = self.refined(m, self.mixed(m, x, gate), path)
                    out[m, some] += np.log10(np.where(bit == 1, p, 1 - p))
        return out


class Known:
    """Scores of the most frequent events: of each code every mixer's log-probability."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, n: np.ndarray):
        by = np.argsort(codes)
        self.codes, self.often, self.slots = codes[by], np.argsort(n[by], kind="stable").astype(np.int32), None
        # one place more, for events that aren't known
        self.values = np.concatenate([values[:, by], np.zeros((len(MIXERS), 1))], axis=1).astype(np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"slots": None}

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).view(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for those not known; a slot names one code, the others of it are searched for."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        if self.slots is None:
            self.slots = np.zeros(1 << _SLOTS, dtype=np.int32)
            self.slots[self.slot(self.codes[self.often])] = self.often  # of events for one slot the most frequent has it
        at = self.slots[self.slot(codes)]
        if (lost := np.flatnonzero(self.codes[at] != codes)).size:
            new, place = np.unique(codes[lost], return_inverse=True)
            found = np.minimum(np.searchsorted(self.codes, new), len(self.codes) - 1)
            at[lost] = np.where(self.codes[found] == new, found, -1)[place]
        return at

    def scores(self, data: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Sums over the known events of each text, by mixer; its other events and how often it has them."""
        out = np.zeros((len(data), len(MIXERS)))
        rest: list[list[np.ndarray]] = [[] for _ in data]
        for owners, codes, sizes in _blocks(data):
            at, starts = self.find(codes), np.cumsum(sizes) - sizes
            for m in range(len(MIXERS)):
                np.add.at(out[:, m], owners, np.add.reduceat(self.values[m][at], starts, dtype=np.float64))
            lost = np.flatnonzero(at < 0)
            owner = np.searchsorted(starts, lost, side="right") - 1
            bounds = np.searchsorted(owner, np.arange(len(owners) + 1))
            for k, text in enumerate(owners):
                if bounds[k] < bounds[k + 1]:
                    rest[text].append(codes[lost[bounds[k] : bounds[k + 1]]])
        pairs = [np.unique(np.concatenate(r), return_counts=True) if r else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for r in rest]
        return out, [p[0].view(np.int64) for p in pairs], [p[1] for p in pairs]


def online(sums: list[Column]) -> Column:
    """The log-probability of a text under online mixing, from the sums of its bytes' log-probabilities by mixer."""
    most = F.greatest(*sums)
    return most + F.log10(sum((F.pow(F.lit(10.0), s - most) for s in sums), F.lit(0.0)) / len(sums))


def sharded(events: DataFrame) -> DataFrame:
    """(shard, codes, n, third, third_n): the events (code, n) in one row a shard, little-endian arrays sorted by code."""
    total = events.count()
    near, near_4 = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 24) - 1)), F.shiftright("code", 8).bitwiseAND(F.lit((1 << 32) - 1))
    # 2^16 rows at most
    hot = events.groupBy(near.alias("near")).agg(F.count("*").alias("m")).where(F.col("m") > max(HOT, total >> 16)).select("near", F.lit(True).alias("hot"))
    keyed = events.select("code", "n", near.alias("near")).join(F.broadcast(hot), "near", "left")
    keyed = keyed.withColumn("key", F.when(F.col("hot"), near_4 + (1 << 32)).otherwise(F.col("near")))
    heated = keyed.where("hot")
    third = heated.groupBy("near", F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("code")).agg(F.sum("n").alias("n"))
    copies = heated.select("near", "key").distinct().join(third, "near").select("key", "code", "n", F.lit(True).alias("copy"))
    shards = -(-total // SHARD) or 1
    rows = keyed.select("key", "code", "n", F.lit(False).alias("copy")).union(copies)
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "code", "n", "copy")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def row() -> pd.DataFrame:
            b = pd.concat(held).sort_values(["copy", "code"])
            own, third = b[~b["copy"]], b[b["copy"]]
            raw = lambda c, kind: c.to_numpy(kind).tobytes()
            return pd.DataFrame({"shard": [b["shard"].iloc[0]], "codes": [raw(own["code"], "<i8")], "n": [raw(own["n"], "<f8")], "third": [raw(third["code"], "<i8")], "third_n": [raw(third["n"], "<f8")]})

        for b in batches:
            for shard, some in b.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != shard:
                    yield row()
                    held.clear()
                held.append(some)
        if held:
            yield row()

    partitions = min(shards, max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 64))
    rows = rows.repartition(partitions, "shard").sortWithinPartitions("shard")
    return cut(rows.mapInPandas(packed, "shard bigint, codes binary, n binary, third binary, third_n binary"), "shards")


def _opened(batches: Iterator[pd.DataFrame], short: list[Counts]) -> Iterator[tuple[Nodes, np.ndarray]]:
    for b in batches:
        for codes, n, third, third_n in zip(b["codes"], b["n"], b["third"], b["third_n"]):
            codes, n = np.frombuffer(codes, "<u8"), np.frombuffer(n, "<f8")
            yield Nodes(short, codes, n, (np.frombuffer(third, "<u8"), np.frombuffer(third_n, "<f8"))), n


def train(events: DataFrame, shards: DataFrame) -> tuple[Mixer, list[Counts]]:
    """The mixers of (code, n) and of their shards, and the counts of short contexts."""
    spark = events.sparkSession
    # at most 2^24 counts
    last = local(events.where("n > 0").groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")))
    keys, n = last["key"].to_numpy(np.int64).view(np.uint64), last["n"].to_numpy(np.float64)
    short, mixer = [Counts(_key(keys, k), n) for k in range(1, SHORT + 1)], Mixer()
    for _ in range(EPOCHS):
        shared = spark.sparkContext.broadcast((short, mixer))

        def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            short, start = shared.value
            total, seen = np.zeros(start.weights.size), 0
            for nodes, n in _opened(batches, short):
                own = Mixer()
                own.weights = start.weights.copy()
                own.learn(nodes, n)
                many = np.count_nonzero(n)
                total, seen = total + many * own.weights.ravel(), seen + many
            if seen:
                yield pd.DataFrame({"cell": np.arange(len(total)), "w": total, "n": float(seen)})

        found = local(shards.mapInPandas(weights, "cell int, w double, n double").groupBy("cell").agg((F.sum("w") / F.sum("n")).alias("w")))
        shared.destroy()
        if len(found):
            mixer.weights = found.sort_values("cell")["w"].to_numpy().reshape(mixer.weights.shape)
    shared = spark.sparkContext.broadcast((short, mixer))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short, mixer = shared.value
        total = np.zeros((len(MIXERS), 2, 256 * BINS))
        for nodes, n in _opened(batches, short):
            total += mixer.map_counts(nodes, n)
        m, some = np.nonzero(total[:, 1])
        yield pd.DataFrame({"m": m, "cell": some, "ones": total[m, 0, some], "n": total[m, 1, some]})

    counted = shards.mapInPandas(cells, "m int, cell int, ones double, n double").groupBy("m", "cell").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).collect()
    shared.destroy()
    for r in counted:
        path, low = divmod(r["cell"], BINS)
        mixer.map[r["m"], path, low] = (r["ones"] + 20 * mixer.map[r["m"], path, low]) / (r["n"] + 20)
    mixer.map = np.clip(mixer.map, 1e-5, 1 - 1e-5)
    return mixer, short


_SCORES = [f"s{m}" for m in range(len(MIXERS))]


def event_scores(shards: DataFrame, mixer: Mixer, short: list[Counts]) -> DataFrame:
    """(code, n, s0, s1, ...): the log-probabilities of every event of the shards."""
    shared = shards.sparkSession.sparkContext.broadcast((mixer, short))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixer, short = shared.value
        for nodes, n in _opened(batches, short):
            s = mixer.log10(nodes).astype(np.float32)
            yield pd.DataFrame({"code": nodes.codes.view(np.int64), "n": n.astype(np.int64)} | dict(zip(_SCORES, s)))

    out = cut(shards.mapInPandas(of, "code bigint, n bigint, " + ", ".join(f"{s} float" for s in _SCORES)), "event-scores")
    shared.destroy()
    return out


def _head(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the greatest counts, `most` at most; rows of nearly one count are in or out together."""
    level = F.floor(F.log2(F.col(count) + 1) * 1024)  # some ten thousand levels at most
    ranked = rows.withColumn("level", level)
    least, total = None, 0
    for r in ranked.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    return ranked.where(F.col("level") >= least if least is not None else F.lit(False)).drop("level")


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of every text of docs under what those rows say where `learn` is true.

    Columns: doc_id, those of `keep`, n_tokens, n_known, train_tokens, base_score, score, total_bits, bits_per_byte.
    """
    spark = docs.sparkSession
    counts = cut(corpus_counts(docs, text_col, learn), "counts", 4 * BATCH_ROWS)
    words = cut(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words")
    events = cut(counts.where("code is not null").groupBy("code").agg(F.sum("n").alias("n")), "events")
    n_all, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = (words.where("word = ''").first() or {"c": 0})["c"]
    top = local(_head(words.where("word != ''"), "c", HEAD))
    shards = sharded(events)
    scores = event_scores(shards, *train(events, shards))
    common = local(_head(scores, "n", EVENT_HEAD))
    known = Known(common["code"].to_numpy(np.int64).view(np.uint64), common[_SCORES].to_numpy(np.float64).T, common["n"].to_numpy(np.int64))
    head = {w.encode("utf-8"): x for w, x in zip(top["word"], np.log10(top["c"].to_numpy(np.float64) + 1))}
    shared = spark.sparkContext.broadcast((head, known))  # HEAD words, EVENT_HEAD events

    @F.pandas_udf("n_words bigint, n_head bigint, head_log double, n_bytes bigint, sums array<double>, tail array<string>, tail_n array<bigint>, codes array<bigint>, codes_n array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        head, known = shared.value
        for texts in in_parts(batches):
            data, rows = [_lower(t) for t in texts], []
            for d in data:
                own, log, tail, tail_n = d.split(), 0.0, [], []
                for w, k in Counter(own).items():
                    x = head.get(w)
                    if x is None:
                        tail.append(w.decode("utf-8", "replace"))
                        tail_n.append(k)
                    else:
                        log += k * x
                rows.append((len(own), len(own) - sum(tail_n), log, len(d), tail, tail_n))
            out = pd.DataFrame(rows, columns=["n_words", "n_head", "head_log", "n_bytes", "tail", "tail_n"])
            sums, codes, codes_n = known.scores(data)
            out.insert(4, "sums", list(sums))
            out["codes"], out["codes_n"] = codes, codes_n
            yield out

    scored = docs.select(F.col(id_col).alias("doc_id"), *keep, F.monotonically_increasing_id().alias("row"), of(F.coalesce(F.col(text_col), F.lit(""))).alias("r"))
    scored = cut(scored.select("doc_id", *keep, "row", "r.*"), "scored", BATCH_ROWS)
    shared.destroy()
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("k"))
    met = rare.join(words, "word").groupBy("row").agg(F.sum("k").alias("n_tail"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("tail_log"))
    others = scored.select("row", F.explode(F.arrays_zip("codes", "codes_n")).alias("t")).select("row", F.col("t.codes").alias("code"), F.col("t.codes_n").alias("k"))
    rest = [F.sum(F.col("k") * F.col(s).cast("double")).alias(f"rest_{s}") for s in _SCORES]
    behind = others.join(scores.drop("n"), "code").groupBy("row").agg(*rest)
    n_tokens = F.col("n_words") + 1
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + float(np.log10(ends + 1)) - n_tokens * float(np.log10(n_all + v + 1))
    sums = [F.col("sums")[i] + F.coalesce(f"rest_{s}", F.lit(0.0)) for i, s in enumerate(_SCORES)]
    out = scored.join(met, "row", "left").join(behind, "row", "left").select(
        "doc_id", *keep, n_tokens.alias("n_tokens"), (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(int(n_all)).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), online(sums).alias("score"), "n_bytes",
    )
    bits = F.col("score") * float(-np.log2(10))
    return out.select(*out.columns[:-1], bits.alias("total_bits"), (bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learning from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    return score_texts(docs, ~F.col("held_out"), keep=("held_out",))
