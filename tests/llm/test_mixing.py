"""Context mixing against plain counting, plain mixing and plain online updates, and under any layout of the data."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import context_mixing as C

TEXTS = ["the house on the hill", "The house by the sea. " * 4, "a hill, a house and the sea", "", None, "zzz qqq", "the house on the hill", "Ünïcode \x00 and\nlines\n", "in the house " * 9]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t, k % 3 != 2) for k, t in enumerate(TEXTS)] + [(None, "null id", True), (3, "", True)], "doc_id bigint, text string, learn boolean").cache()


def events_of(texts):
    codes, _ = C._events([C._lower(t) for t in texts])
    return codes


def node_counts(codes, n):
    """Of every order, bytes of context, path before a bit and bit: how often."""
    out = Counter()
    for c, m in zip(codes.tolist(), n):
        byte, path = c & 255, 1
        for j in range(8):
            bit = byte >> (7 - j) & 1
            for k in range(1, C.ORDERS + 1):
                out[k, c >> 8 & (1 << 8 * k) - 1, path, bit] += m
            path = path * 2 + bit
    return out


def plain_log10(mixer, m, counts, code):
    """One mixer's log-probability of an event's byte, step by step."""
    byte, path, total = code & 255, 1, 0.0
    context = [code >> 8 * k & 255 for k in range(1, C.ORDERS + 1)]
    since = next((k for k, b in enumerate(context) if b <= 32), C.ORDERS)
    level = lambda x: sum(x >= e for e in (0.5, 1.5, 3.5, 15.5))
    for j in range(8):
        bit = byte >> (7 - j) & 1
        pairs = [(counts[k, code >> 8 & (1 << 8 * k) - 1, path, 0], counts[k, code >> 8 & (1 << 8 * k) - 1, path, 1]) for k in range(1, C.ORDERS + 1)]
        x = [np.log((one + 0.4) / (zero + 0.4)) for zero, one in pairs] + [0.3]
        gate = (since * 5 + level(sum(pairs[4]))) * 5 + level(sum(pairs[3]))
        z = float(np.clip(np.dot(mixer.weights[m, gate], x), -C.LIMIT, C.LIMIT))
        at = (z + C.LIMIT) * (C.BINS - 1) / (2 * C.LIMIT)
        low = min(int(at), C.BINS - 2)
        own = mixer.map[m, path, low] * (1 - at + low) + mixer.map[m, path, low + 1] * (at - low)
        p = 0.5 * own + 0.5 / (1 + np.exp(-z))
        total += np.log10(p if bit else 1 - p)
        path = path * 2 + bit
    return total


def trained(spark, codes, n):
    events = spark.createDataFrame([(int(c), int(m)) for c, m in zip(codes.view(np.int64), n)], "code bigint, n bigint")
    shards = C.sharded(events)
    return C.train(events, shards), shards


def test_scores_are_online_mixtures_of_plain_mixers(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "SHARD", 20)
    monkeypatch.setattr(C, "HOT", 6)
    learnt = [t for k, t in enumerate(TEXTS) if k % 3 != 2] + ["null id", ""]
    codes, n = np.unique(events_of(learnt), return_counts=True)
    everything = np.unique(np.concatenate([codes, events_of(TEXTS)]))
    (mixer, _), shards = trained(spark, everything, [dict(zip(codes.tolist(), n)).get(c, 0) for c in everything.tolist()])
    assert shards.count() > 2 and shards.where("length(third) > 0").count() > 0  # contexts of three bytes are dealt by four
    counts = node_counts(codes, n)
    got = {(r["doc_id"], r["n_tokens"]): r for r in C.score_texts(rows, F.col("learn")).collect()}
    for k, t in enumerate(TEXTS):
        odds, total = np.ones(len(C.MIXERS)) / len(C.MIXERS), 0.0
        for code in events_of([t]).tolist():
            each = np.array([10 ** plain_log10(mixer, m, counts, code) for m in range(len(C.MIXERS))])
            p = odds @ each
            total, odds = total + np.log10(p), odds * each / p  # the odds follow every byte
        r = got[k, len((t or "").encode().split()) + 1]
        assert abs(r["score"] - total) < 1e-4 * max(1, abs(total)), t
        assert abs(r["total_bits"] + r["score"] * np.log2(10)) < 1e-6


def test_mixers_sum_to_one_and_find_what_they_saw(spark):
    text = ["the house on the hill " * 50]
    codes, n = np.unique(events_of(text), return_counts=True)
    (mixer, short), _ = trained(spark, codes, n)
    context = np.uint64(int.from_bytes(b" hous", "big")) << np.uint64(8)
    p = 10 ** mixer.log10(C.Nodes(short, codes, n.astype(float), of=context | np.arange(256, dtype=np.uint64)))
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-6 and p[:, ord("e")].min() > 0.5


def test_long_texts_go_on_in_blocks(monkeypatch):
    monkeypatch.setattr(C, "_BLOCK", 64)
    data = [b"ab" * 100, b"", b"the", b"x" * 64]
    for k in range(len(data)):
        own = np.concatenate([codes for owners, codes, sizes in C._blocks(data) for codes, o in zip(np.split(codes, np.cumsum(sizes)[:-1]), owners) if o == k])
        assert (own == C._events([data[k]])[0]).all()


def test_counts_are_exact():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(1 << 40, 1 << 48, 3000).astype(np.uint64))
    n = rng.integers(1, 50, len(codes)).astype(float)
    short = [C.Counts(C._key(codes, k), n) for k in (1, 2)]
    some = np.concatenate([codes[:100], codes[:50] ^ np.uint64(5)])
    counts = node_counts(codes, n)
    for _, (bit, path, got) in enumerate(C.Nodes(short, codes, n, of=some).bits()):
        for k in range(1, 6):
            for i, c in enumerate(some.tolist()):
                assert tuple(got[k - 1, i]) == tuple(counts[k, c >> 8 & (1 << 8 * k) - 1, int(path[i]), b] for b in (0, 1))


def test_no_layout_shows_in_a_score(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "SHARD", 50)
    monkeypatch.setattr(C, "HOT", 10)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions, head in ((1, 1 << 18), (4, 30), (13, 0)):  # few or no events broadcast, the others joined
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            monkeypatch.setattr(C, "EVENT_HEAD", head)
            got = C.score_texts(rows.repartition(partitions), F.col("learn")).collect()
            found.append(sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in found[1:]:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(found[0], other))
    assert len(found[0]) == len(TEXTS) + 2
    same = [x for x in found[0] if x[0] in ("0", "6")]
    assert same[0][2] == same[1][2]  # equal texts have equal scores, learnt from or not


def test_nothing_to_learn_from(spark, rows):
    got = C.score_texts(rows, F.lit(False)).collect()
    assert len(got) == rows.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert all(abs(r["total_bits"] - 8 * (len((TEXTS[r["doc_id"]] or "").encode()) + 1)) < 0.1 * r["total_bits"] + 1 for r in got if r["doc_id"] is not None and r["doc_id"] != 3)
