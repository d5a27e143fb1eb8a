"""Each operator on rows with nulls, ties, repeats and clashing columns, and against brute force or its library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from recordloom.llm import bin_slack, byte_bpe, common, components, context_mixing, cover_tree, language_id, piece_bpe, quality_rules, secret_scan, simhash_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, fp bigint, row bigint, label int, found_ string"
SENTENCES = {"en": "the house on the hill is old and the garden near it", "de": "das haus auf dem hügel ist alt und der garten daneben", "fr": "la maison sur la colline est vieille et le jardin aussi"}


def make_texts():
    rng = random.Random(5)
    out = []
    for k in range(60):
        lang = list(SENTENCES)[k % 3]
        words = SENTENCES[lang].split()
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(8, 60)))
        if k % 5 == 0:
            text += ' api_key = "0b96a8c8d79c4a5085c9"' if k % 2 else " you stupid idiot scum"
        out.append((k, text, lang))
    edge = [(60, None, "en"), (61, "", None), (62, " \t\n", "en"), (63, "x", None), (64, "!!! ### 123", "de"), (None, "the house", "en"), (65, out[0][1], "en"), (65, out[0][1], "en")]
    edge += [(66, "the house " * 30_000, "en"), (67, "日本語 ﬁ 😀 x\x00y ▁", "en"), (68, "a\n\nb  c\t d\n", "en")]
    return out + edge


@pytest.fixture(scope="module")
def rows():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "w", 1, 2, 3, "f") for i, t, lang in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 7 != 0), int(k % 10 == 0)) for k in range(60)] + [(3, None, None), (None, 1, 1), (1000, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


def same(spark_rows, want):
    assert sorted(map(repr, spark_rows)) == sorted(map(repr, want))


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, covered, seen, dup = Counter(windows), set(), set(), 0
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_statistics(docs, rows):
    got = quality_rules.judged(docs, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for i, t, _ in rows:
        s = statistics(t)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want.append((i, *s, failed, not failed))
    same(map(tuple, got), want)


def test_quality_rules_are_learnt(spark):
    texts = [(k, ("word " * 9 + f"w{k} ") * 3 + ("%%% $$$ " * 12 if k % 4 == 0 else "")) for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(200)], "doc_id bigint, quality int")
    rules = quality_rules.learn(docs, labels)
    assert rules
    judged = quality_rules.judged(docs, rules).collect()
    assert all((r["rule"] is not None) == (r["doc_id"] % 4 == 0) for r in judged)
    assert quality_rules.learn(docs, labels.limit(0)) == []


def test_secret_spans_against_plain_patterns(spark, docs, rows):
    ledger = secret_scan.new_ledger(spark)
    got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.scan_history(docs, ledger).collect()]
    want = []
    for i, t, _ in rows:
        t = t or ""
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A) if len(m[2]) >= 12]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        kinds = [f[1] for f in found]
        want.append((i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(",".join(f[2] for f in sorted(found)).encode()).hexdigest()))
    same(got, want)


def test_ledger_scans_only_what_is_new(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "token: abcdefghijklmnop")], "doc_id bigint, text string")
    ledger = secret_scan.new_ledger(spark)
    secret_scan.scan_history(docs, ledger)
    assert spark.read.parquet(ledger).count() == 2
    more = docs.union(spark.createDataFrame([(1, "b"), (4, "b")], docs.schema))
    assert secret_scan.scan_history(more, ledger).count() == 5
    assert spark.read.parquet(ledger).count() == 3
    secret_scan.scan_history(docs, ledger, rule_version="2")
    assert spark.read.parquet(ledger).count() == 5


def test_redaction(spark):
    df = spark.createDataFrame([("a token: abcdefghijklmnop b", "assign:2:25"), ("x", ""), (None, None), ("abcdef", "hex:0:3,jwt:2:4")], "t string, s string")
    assert [r[0] for r in df.select(secret_scan.redacted(F.col("t"), F.col("s"))).collect()] == ["a [secret] b", "x", None, "[secret]ef"]


def test_golay_code_is_perfect():
    t = simhash_dedup.golay_table()
    assert (np.bincount(t, minlength=4096) == 2048).all()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 300)
    for shifts in ([0], [3], [5, 11]):
        y = x.copy()
        for s in shifts:
            y ^= 1 << s
        a, b = simhash_dedup._near(x, 23), simhash_dedup._near(y, 23)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def closure(prints, ids, limit=4):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k in range(len(prints)):
        groups.setdefault(find(k), []).append(k)
    least = {}
    for g in groups.values():
        known = [ids[k] for k in g if ids[k] is not None]
        for k in g:
            least[k] = min(known) if known else None
    return least


def test_simhash(docs, rows):
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    least = closure(prints, [r[0] for r in rows])
    got = simhash_dedup.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    same(map(tuple, got), [(r[0], f"{prints[k]:016x}", least[k]) for k, r in enumerate(rows)])


def test_golay_links_lose_nothing(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for n in range(1, 6):
            q = p
            for b in rng.sample(range(64), n):
                q ^= 1 << b
            prints.append(q)
    for a, b, c in ((0, 2, 2), (2, 2, 0), (2, 0, 2)):  # errors by segment
        q = prints[0] ^ (3 << 1) * (a > 0) ^ (5 << 30) * (b > 0) ^ (9 << 50) * (c > 0)
        prints.append(q)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p, p) for p in prints], "rep bigint, fp bigint")
    got = [tuple(sorted(r)) for r in simhash_dedup.links(df).collect()]
    want = [(p, q) for i, p in enumerate(prints) for q in prints[i + 1 :] if ((p ^ q) & (1 << 64) - 1).bit_count() <= 4]
    assert sorted(got) == sorted(want)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, j) for j in range(6, 30)] + [(200, 201), (201, 200), (7, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 5 for k in [*range(5, 30), 300]) and got[200] == got[201] == 200
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_piece_bpe_is_the_librarys(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = piece_bpe.round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    ids = [sp.encode(t or "") for _, t, _ in rows]
    same(map(tuple, got), [(r[0], len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for r, x in zip(rows, ids)])
    own = piece_bpe.codec(piece_bpe.model_path())
    rng = random.Random(4)
    letters = "abcdehinorstu   \n\t.,-'\"ABé▁😀中\x00<>/s"
    for _ in range(2000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert own.encode(s) == sp.encode(s) and own.decode(own.encode(s)) == sp.decode(sp.encode(s))


def test_piece_columns(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string").select(piece_bpe.encoded(F.col("t")).alias("ids"))
    assert [r[0] for r in df.select(piece_bpe.decoded(F.col("ids"))).collect()] == ["a b", ""]


def test_context_mixing(spark, docs, rows):
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r for r in context_mixing.score_texts(docs, F.col("doc_id") % 2 == 0, keep=("lang",)).collect()}
    lower = lambda t: (t or "").encode().lower()
    training = Counter()
    for i, t, _ in rows:
        if i is not None and i % 2 == 0:
            training.update([*lower(t).split(), b""])
    n, v = sum(training.values()), len(training)
    for i, t, _ in rows:
        tokens = [*lower(t).split(), b""]
        base = sum(np.log10((training[w] + 1) / (n + v + 1)) for w in tokens)
        r = got[i, len(tokens), round(base, 6)]
        assert r["n_known"] == sum(training[w] > 0 for w in tokens) and r["train_tokens"] == n and r["score"] < 0


def test_language(spark, docs, rows):
    model = language_id.train(docs)
    got = docs.select("doc_id", "text", language_id.predicted(F.col("text"), model).alias("r")).select("doc_id", "text", "r.*").collect()
    langs = {i: lang for i, _, lang in rows}
    for r in got:
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["lang_pred"] == langs[r["doc_id"]] and not r["rejected"] and 0 <= r["score"] <= 1
    empty = language_id.train(docs.limit(0))
    assert {x["r"]["lang_pred"] for x in docs.select(language_id.predicted(F.col("text"), empty).alias("r")).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    chars = np.array([language_id._trigrams(*__import__("recordloom.llm.letters", fromlist=["letters"]).letters(["abc abd bcd"]))[0]]).ravel()
    codes, n = np.unique(chars, return_counts=True)
    alphabet = np.unique(codes & language_id._MASK).size + 1
    model = language_id.KneserNey(codes, n, int((n == 1).sum()), int((n == 2).sum()), alphabet)
    known = np.unique(codes & language_id._MASK)
    for context in (codes[0] >> 21, ord("x") << 21 | ord("y")):
        p = 2 ** model.log2(np.append(known, 0x3000) | int(context) << 21)
        assert abs(p.sum() - 1) < 1e-9


def test_letters_and_slices():
    from recordloom.llm.letters import letters, slices

    chars, sizes = letters(["Ab, c1D", "", "--", "x"])
    assert "".join(map(chr, chars)) == " ab c d " + " " + " " + " x " and sizes.tolist() == [8, 1, 1, 3]
    parts = slices(["a" * 5, "b", "", "c" * 3], 4)
    assert [(o.tolist(), p) for o, p in parts] == [([0], ["aaaa"]), ([0, 1, 2], ["a", "b", ""]), ([3], ["ccc"])]


def test_toxicity(spark, docs, labels):
    model = toxicity.train(docs, labels)
    got = docs.select("doc_id", toxicity.scored(F.col("text"), model).alias("r")).select("doc_id", "r.*").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 10 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.train(docs, some).score(["x", None]).max() < 0.5


def test_packing(docs, rows):
    path = byte_bpe.model_path()
    got = bin_slack.packed(docs).toPandas()
    lengths = []
    for i, t, _ in rows:
        ids = byte_bpe.codec(path).ids(t or "") + b"\0\0\0\0"
        n = len(ids) // 4
        cuts = [0, *range((n - 1) % 2048 + 1, n, 2048), n]
        lengths += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    same([(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()], lengths)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == [0, *bin_["length"].cumsum().tolist()[:-1]] and bin_["length"].sum() <= 2048


def test_fullest_against_all_subsets():
    rng = random.Random(6)
    for _ in range(40):
        counts = Counter(rng.randrange(1, 40) for _ in range(8))
        room = rng.randrange(1, 80)
        sums = {0}
        for n in counts.elements():
            sums |= {s + n for s in sums if s + n <= room}
        taken = bin_slack.fullest(dict(counts), room)
        assert sum(taken) == max(sums) and not Counter(taken) - counts
    packed = bin_slack.pack({7: 1000, 5: 333, 100: 3}, 100)
    used = Counter()
    for times, taken in packed:
        assert sum(taken) <= 100
        for n in taken:
            used[n] += times
    assert used == {7: 1000, 5: 333, 100: 3}


def test_byte_ids_are_the_librarys():
    own, rng = byte_bpe.codec(byte_bpe.model_path()), random.Random(8)
    letters = "abcdehinorstu   \n\t.,-'s\"ABé▁😀中\x00²½ª<|endoftext|>012"
    for _ in range(2000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert np.frombuffer(own.ids(s), "<u4").tolist() == own.whole(s)


def test_length_histogram(docs, rows):
    n = [len(byte_bpe.codec(byte_bpe.model_path()).whole(t or "")) for _, t, _ in rows]
    histogram = token_counts.length_histogram(docs).cache()
    want = []
    for x in sorted(set(n)):
        want.append((x, n.count(x), x * n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x), sum(min(x, y) for y in n), sum(y <= x for y in n) / len(n)))
    same(map(tuple, histogram.collect()), want)
    assert token_counts.truncated_total(histogram, 50).first()[0] == sum(min(50, y) for y in n)
    assert token_counts.quantile(histogram, 0.5).first()[0] == sorted(n)[(len(n) - 1) // 2]


def test_cover_tree_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 8))
    rows = []
    for k in range(300):
        x = centers[k % 6] + rng.normal(size=8) * (0.15 if k % 2 else 0.02)
        rows.append((k, x.tolist(), k % 2, "e"))
    rows += [(300, rows[0][1], 0, "e"), (301, [2 * c for c in rows[0][1]], 0, "e"), (302, None, 0, "e"), (303, [0.0] * 8, 0, "e"), (304, [1.0, None], 0, "e"), (305, [float("nan")] * 8, 0, "e"), (306, rows[0][1], None, "e"), (307, [1.0, 2.0], 0, "e"), (307, [1.0, 2.0], 0, "e"), (None, [float("inf")], 1, "e")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, class string")
    got = cover_tree.near_duplicates(df).collect()
    ok = [(k, r) for k, r in enumerate(rows) if r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for a, (i, r) in enumerate(ok):
        for j, s in ok[:a]:
            if r[2] == s[2] and len(r[1]) == len(s[1]) and np.dot(r[1], s[1]) / np.linalg.norm(r[1]) / np.linalg.norm(s[1]) >= 0.98:
                links.update((i, j))
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = []
    for k, r in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if find(j) == find(k)]
        least = None if r[0] is None else min(known)
        want.append((r[0], links[k], least, r[0] is not None and r[0] == least))
    same(map(tuple, got), want)


def test_cover_tree_blocks_of_large_labels(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(5, 6))[rng.integers(0, 5, 200)] + rng.normal(size=(200, 6)) * 0.1, rng.normal(size=(100, 6))])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    whole = sorted(map(tuple, cover_tree.near_duplicates(df).collect()))
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    assert sorted(map(tuple, cover_tree.near_duplicates(df).collect())) == whole


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    assert quality_rules.judged(none, quality_rules.learn(none, labels)).count() == 0
    assert secret_scan.scan_history(none, secret_scan.new_ledger(spark)).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert piece_bpe.round_trip(none).count() == 0
    assert context_mixing.score_texts(none, F.lit(True)).count() == 0
    assert bin_slack.packed(none).count() == 0
    assert token_counts.length_histogram(none).count() == 0
    assert toxicity.train(none, labels).score([None]).max() < 0.5
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert cover_tree.near_duplicates(empty).count() == 0


def test_remainders():
    assert common.remainder_of(None, 7) == 0 and common.remainder_of(12, 5) == zlib.crc32(b"12") % 5


def test_language_keeps_rare_languages(spark, docs, monkeypatch):
    rare = spark.createDataFrame([(900, "ĝis revido amiko ĉiam ŝanĝiĝas", "eo")], "doc_id bigint, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(rare)
    predictions = lambda model: sorted(str(tuple(r)) for r in both.select("doc_id", language_id.predicted(F.col("text"), model).alias("r")).select("doc_id", "r.*").collect())
    whole = language_id.train(both)
    monkeypatch.setattr(language_id, "MODEL_TRIGRAMS", 50)  # fewer than there are
    model = language_id.train(both)
    assert model.names == ["de", "en", "eo", "fr"] and model.alphabet == whole.alphabet
    assert predictions(model) == predictions(whole) and any("'eo'" in r for r in predictions(model) if r.startswith("(900"))


def test_simhash_joins_are_shuffled(spark, docs):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "1g")
    try:
        reps = spark.createDataFrame([(p, p) for p in range(40)], "rep bigint, fp bigint")
        edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "u bigint, v bigint")
        made = [simhash_dedup.links(reps), components._large_star(edges), components._small_star(edges), *(simhash_dedup.near_duplicates(docs, prints=k) for k in (1, 3))]
        assert all("SortMergeJoin" in plan(df) and "Broadcast" not in plan(df) for df in made)
    finally:
        spark.conf.set(threshold, before)


def test_toxicity_steps_send_few_rows(spark, docs, labels, monkeypatch):
    rng = np.random.default_rng(1)
    own = [np.zeros(0, np.int32), *(rng.choice(1 << toxicity.HASH_BITS, n, replace=False).astype(np.int32) for n in (1, 3000, 2)), np.array([0, 255, 510, 511, (1 << toxicity.HASH_BITS) - 1], np.int32), np.zeros(0, np.int32)]
    for some in (own, own[:1]):
        codes, sizes = toxicity.of_gaps(toxicity.gaps(some), len(some))
        assert sizes.tolist() == [len(x) for x in some] and codes.tolist() == [c for x in some for c in sorted(x.tolist())]
    sent, local, size = [], toxicity.local, "spark.sql.files.maxPartitionBytes"
    monkeypatch.setattr(toxicity, "local", lambda df: sent.append(local(df)) or sent[-1])
    before = spark.conf.get(size)
    spark.conf.set(size, "1k")
    try:
        whole = toxicity.train(docs, labels)
    finally:
        spark.conf.set(size, before)
    steps = [x for x in sent if "g" in x]
    assert steps and all(0 < len(x) <= toxicity.PARTITIONS for x in steps)
    assert np.allclose(whole.weights, toxicity.train(docs, labels).weights, atol=1e-4)


def test_toxicity_counts_features_in_parts(spark, docs, labels, monkeypatch):
    sent, counted, local, ratios = [], [], toxicity.local, toxicity.log_ratios
    decoded, before = "spark.sql.parquet.columnarReaderBatchSize", spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    monkeypatch.setattr(toxicity, "local", lambda df: sent.append((int(spark.conf.get(decoded)), local(df))) or sent[-1][1])
    monkeypatch.setattr(toxicity, "log_ratios", lambda *a: counted.append(a) or ratios(*a))
    toxicity.train(docs, labels)
    assert sent and all(0 < len(x) <= toxicity.PARTITIONS and rows <= toxicity._PACK for rows, x in sent) and spark.conf.get(decoded) == before
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("doc_id").agg(F.max("text").alias("text")).join(own, "doc_id").collect()
    n = np.zeros((2, 1 << toxicity.HASH_BITS), np.int64)
    for r, codes in zip(rows, toxicity.distinct([r["text"] for r in rows])):
        n[r["y"], codes] += 1
    some = n.any(axis=0)
    n0, n1, *texts = counted[0]
    assert n0.tolist() == n[0, some].tolist() and n1.tolist() == n[1, some].tolist() and texts == [sum(r["y"] == y for r in rows) for y in (0, 1)]


def test_small_batches_of_scans_end_with_them(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    now = lambda: [spark.conf.get(x) for x in names]
    before = now()
    with pytest.raises(KeyError), common.small_batches(spark, 7, scans=True):
        assert now() == ["7", "7"]
        raise KeyError
    assert now() == before
    with common.small_batches(spark, 7):
        assert now() == ["7", before[1]]


def test_language_is_calibrated_on_all_training_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = {"en": "the house on hill is old and garden near".split(), "de": "das haus auf dem hügel ist alt und garten".split()}
    rows = [(k, " ".join(rng.choice(words[lang], 12)), lang) for k in range(2_600) for lang in [("en", "de")[k % 2]]]
    rows += [(3_000, None, "en"), (3_001, "12 34", "en"), (3_002, "the house", None)]
    docs, seen, calibrate = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), [], language_id.calibrate
    monkeypatch.setattr(language_id, "calibrate", lambda model, scored: seen.append(scored) or calibrate(model, scored))
    model = language_id.train(docs)
    found = seen[0].where("lang is not null").toPandas()
    assert found[found["whole"]].groupby("lang").size().to_dict() == {"en": 1_300, "de": 1_300}
    for k, name in enumerate(model.names):
        own = found[found["lang"] == name]
        mean = np.average(own["own"], weights=own["n"])
        gap, whole = own["own"] - mean, own["whole"].astype(bool)
        long, one = max((gap[whole] ** 2).mean(), 1e-4), (gap[~whole] ** 2 * own["n"][~whole]).mean()
        far = max(language_id.LEAST_FAR, np.quantile(gap / np.sqrt(long + one / own["n"]), 1 - language_id.STRANGE))
        assert np.allclose(model.spread[k], [mean, long, one, far])
    fits = np.sum([r["fit"] for r in seen[0].where("fit is not null").collect()], axis=0).reshape(len(language_id.POWERS), -1)
    power, scale = np.unravel_index(fits.argmax(), fits.shape)
    assert (model.power, model.scale) == (language_id.POWERS[power], language_id.SCALES[scale])


def test_quantiles(spark):
    rng = np.random.default_rng(6)
    values = {1: rng.normal(size=3_000), 2: np.repeat([0.25, 7.0], [5, 3]), 3: np.array([-4.0]), 4: np.append(rng.normal(size=50) * 1e-9, 1e9)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs], "key int, x double")
    for share in (0.999, 0.5, 0.0, 1.0):
        got = language_id.quantiles(df, share)
        assert all(np.isclose(got[k], np.quantile(xs, share), rtol=1e-9, atol=1e-15) for k, xs in values.items()) and len(got) == len(values)


def test_workers_drop_what_a_task_has_no_use_for(monkeypatch):
    import pandas as pd

    assert byte_bpe.codec.__wrapped__ in [f.__wrapped__ for f, _ in common._FOR_TASKS]
    monkeypatch.setattr(common, "_FOR_TASKS", [])
    made = []
    model = common.for_tasks(lambda k: made.append(k) or k)
    task = lambda: list(common.in_parts(iter([pd.DataFrame({"a": [1]})])))
    for _ in range(2):  # tasks that use it keep it
        assert model(7) == 7 and len(task()) == 1
    assert made == [7]
    task()  # one that doesn't
    assert model(7) == 7 and made == [7, 7]
