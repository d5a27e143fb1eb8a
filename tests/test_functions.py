"""Column functions and operators on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import money as M
from recordloom.functions import similarity as S
from recordloom.functions import text as T
from recordloom.operators import blocking as B
from recordloom.operators import mlp
from recordloom.operators import records as R
from recordloom.operators import split as P
from recordloom.operators import stats as A
from recordloom.sources import files, web
from recordloom.streaming.incremental import append_stream


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_tokens_stay_whole_or_split(spark):
    """By the ordered rules: a title, initial or U.S. stays whole only where it is all that is left of a word."""
    cases = {
        "Dr. Smith's dog ran, J. said.": ["Dr.", "Smith", "'s", "dog", "ran", ",", "J.", "said", "."],
        "U.S. (U.S.) (Dr.": ["U.S.", "(", "U", ".", "S", ".", ")", "(", "Dr."],
        "<pname>Ann Lee</pname>, too": ["<pname>Ann", "Lee</pname>", ",", "too"],
        "said.<pname>Bo</pname> (<pname>Al</pname>)": ["said", ".", "<pname>Bo</pname>", "(", "<pname>Al</pname>", ")"],
        "</pname>x <pname>open": ["x", "<pname>open"],
        "3.14 -2e5 1,000 a.5 .5": ["3.14", "-2e5", "1", ",", "000", "a", ".", "5", ".5"],
        "x-ray Billings-Ladson Jean-Luc-Paul Al-Hassan's": ["x", "-", "ray", "Billings-Ladson", "Jean", "-", "Luc-Paul", "Al-Hassan's"],
        "O'Neils O'Neil 's 'cats' don't": ["O", "'Neils", "O'Neil", "'s", "'cats'", "don't"],
        "Élodie's 第一章 …": ["Élodie", "'s", "第一章", "…"],
        "": [],
    }
    got = values(spark, T.split_tokens(F.col("t")), [(t,) for t in cases] + [(None,)], "t string")
    assert dict(zip(cases, got)) == cases and got[-1] is None


def test_tags(spark):
    rows = [("<pname>A</pname>",), ("<pname>A</pname> b</pname>",), ("x",)]
    assert values(spark, T.is_span(F.col("t")), rows, "t string") == [1, 0, 0]
    assert values(spark, T.tags_balanced(F.col("t")), rows, "t string") == [True, False, True]
    assert values(spark, T.without_tags(F.col("t")), rows, "t string") == ["A", "A b", "x"]


def test_capitalised(spark):
    rows = [("Ludwig van Beethoven",), ("ann Lee",), ("O'Neil",), ("deGrasse",)]
    assert values(spark, T.capitalised(F.col("t")), rows, "t string") == [True, False, True, True]


def test_maximal_spans(spark):
    rows = [(1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 5, 6), (1, 5, 8), (1, 7, 9), (2, 0, 1)]
    got = T.maximal_spans(spark.createDataFrame(rows, "key int, start int, end int"), "key").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2), (1, 5, 8), (1, 7, 9), (2, 0, 1)]


def test_neighbour_edges(spark):
    docs = spark.createDataFrame([(1, ["Ann", "Lee", "ran"]), (2, []), (3, None)], "doc_id int, words array<string>")
    assert [tuple(r) for r in T.neighbours(docs, "doc_id").orderBy("pos").collect()] == [(1, 0, "Ann", None, None, "Lee", "ran"), (1, 1, "Lee", None, "Ann", "ran", None), (1, 2, "ran", "Ann", "Lee", None, None)]


def test_candidates(spark):
    rows = [(1, "Said Director Ann Lee, and Bob O'Neil-Smith (NASA) in New York. The Rock was <pname>John</pname> Smith/Ann at Home Jr. too"), (2, ""), (3, None), (4, "by Ann, Lee")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    rows = T.candidates(docs, "doc_id", blacklist=("Lee",)).collect()
    found = {(r["doc_id"], r["string"], sum(x["string"] == r["string"] and x["doc_id"] == r["doc_id"] and x["start_index"] < r["start_index"] for x in rows)): r for r in rows}
    strings = {k[1] for k in found if k[0] == 1}
    assert {"The Rock", "Rock", "Bob O'Neil-Smith", "John", "Home Jr.", "Director Ann Lee"} <= strings  # spans with a common word inside stay
    assert not strings & {"NASA", "New York", "The", "Said", "Lee", "(", "Smith / Ann"}
    assert found[1, "John", 0]["class_label"] == 1 and sum(r["class_label"] for r in found.values()) == 1
    ann = found[1, "Ann", 0]
    assert ann["prefixed"] == 1 and ann["near_capitalized"] == 1 and ann["frequency"] == 2 and ann["is_proper_noun"] == 1
    assert found[1, "Rock", 0]["other_entity"] == 1 and found[1, "The Rock", 0]["other_entity"] == 0 and found[1, "Bob O'Neil-Smith", 0]["near_parentheses"] == 1
    assert found[1, "Smith", 0]["in_name_list"] == 1 and found[1, "Home Jr.", 0]["name_suffix"] == 1 and found[1, "The Rock", 0]["common_word"] == 1
    assert [r["string_id"] for r in rows if r["doc_id"] == 4] == [0] and not any(k[0] in (2, 3) for k in found)


def test_punctuation_prunes_in_order(spark):
    rows = [("Ann @ Lee",), ("Dr. Lee",), ("O'Neil @",), ("@ O'Neil",), ("Lee @ Jr.",), ("Ann-Lee",), ("J. Lee",)]
    assert values(spark, T.pruned_punctuation(F.col("t")), rows, "t string") == [True, True, False, False, False, False, False]


def test_gazetteers(spark):
    found = spark.createDataFrame([(1, 0, "Ann Lee", 0), (1, 1, "The Rock", 0), (2, 0, "Bo", 1)], "doc_id int, string_id int, string string, other_entity int")
    of = lambda *words: spark.createDataFrame([(w,) for w in words], "word string")
    got = T.gazetteer_flags(found, {"first": of("Ann", "Bo", None), "last": of("Lee")}, ["doc_id", "string_id"])
    assert sorted((r["string"], r["first"], r["last"]) for r in got.collect()) == [("Ann Lee", 2, 2), ("Bo", 2, 0), ("The Rock", 0, 0)]
    assert sorted((r["string"], r["other_entity"]) for r in T.title_flags(found, of("The Rock", "Rock")).collect()) == [("Ann Lee", 0), ("Bo", 1), ("The Rock", 1)]


@pytest.mark.parametrize("a,b,want", [(None, "-5", "5"), ("-7", None, "7"), (None, None, None), ("$10", "$13", "$12"), ("$11", "$14", "$12"), ("€5", "$9", "$9"), ("€5", "£9", "€5"), ("$4", "-9", "$4")])
def test_merge_money(spark, a, b, want):
    assert values(spark, M.merge_money(F.col("a"), F.col("b")), [(a, b)], "a string, b string") == [want]


def test_merge_values_titles_numbers(spark):
    got = values(spark, M.merge_values(F.col("a"), F.col("b"), S.levenshtein_similarity), [(["comedy", "war"], ["Comedy", "drama"]), (None, ["x", "x"]), (["y"], None), (None, None)], "a array<string>, b array<string>")
    assert got == [["comedy", "war", "drama"], ["x"], ["y"], None]
    got = values(spark, M.merge_titles(F.col("t"), F.col("o"), F.col("k")), [("Alien", "Alien", None), ("Alien", "The Thing", None), ("Alien", "The Thing", ["The Thing"]), ("Alien", None, ["x"])], "t string, o string, k array<string>")
    assert got == [[], ["The Thing"], ["The Thing"], ["x"]]
    assert values(spark, M.merge_numbers(F.col("a"), F.col("b")), [(2.0, 3.0), (None, 4.0), (5.0, None)], "a double, b double") == [2.0, 4.0, 5.0]
    assert values(spark, M.merge_ratings(F.col("a"), F.col("b")), [(7.0, 80.0), (None, 65.0), (8.1, None)], "a double, b double") == [7.5, 6.5, 8.1]


def test_minutes(spark):
    assert values(spark, M.minutes(F.col("t")), [("1h 20min",), ("45m",), ("2h",), ("soon",), (None,)], "t string") == [80, 45, 120, None, None]


def test_smith_waterman(spark):
    assert S.smith_waterman_score("cat", "xcaty") == 3.0
    assert values(spark, S.smith_waterman(F.col("a"), F.col("b")), [("cat", "xcaty"), ("", "a"), (None, "a")], "a string, b string") == [1.0, 0.0, None]


def test_jaccard_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.choice(60, 12, replace=False)] for _ in range(12)]
    rows = []
    for k in range(90):
        items = list(base[k % 12])
        for _ in range(int(rng.integers(0, 4))):
            items[int(rng.integers(0, 12))] = f"w{int(rng.integers(0, 60))}"
        rows.append((k, "ab"[k % 2], items))
    rows += [(90, "a", []), (91, "a", None), (92, None, ["w1"]), (93, "a", list(base[0])), (94, "a", list(base[0]))]
    got = {r["k"]: (r["class_id"], r["n_links"]) for r in B.jaccard_links(spark.createDataFrame(rows, "k int, block string, items array<string>"), "k", "block", "items").collect()}
    for k, block, items in rows:
        if not items or block is None:
            assert got[k] == (k, 0)
            continue
        own = set(items)
        other = [(j, set(y)) for j, b, y in rows if y and b == block]
        links = sum(len(own & y) >= 0.8 * len(own | y) - 1e-12 for j, y in other if j != k)
        assert got[k] == (min(j for j, y in other if y == own), links)


def test_names_match(spark):
    rows = [(["Ann Lee"], ["Lee Ann", "Bo"]), (["Ann"], ["Bo"]), (None, ["Bo"]), ([""], [""])]
    assert values(spark, B.names_match(F.col("a"), F.col("b")), rows, "a array<string>, b array<string>") == [True, False, False, False]


def test_keys_and_missing(spark):
    df = spark.createDataFrame([(1, "NA"), (2, "x"), (2, " ")], "k int, v string")
    with pytest.raises(ValueError):
        R.assert_key(df, "k")
    assert R.duplicated(df, ["k"]).count() == 2
    assert [r["v"] for r in R.nulled(df, ["v"]).orderBy("k", "v").collect()] == [None, None, "x"]


def test_one_hot_rows_sum_to_one(spark):
    got = R.one_hot(spark.createDataFrame([("a",), ("b",), (None,)], "v string"), "v").collect()
    assert sorted(r["v_a"] + r["v_b"] for r in got) == [0, 1, 1]


def test_bucket_bounds(spark):
    assert values(spark, R.bucket(F.col("m") / 12, [5, 10]), [(59.9,), (60.0,), (119.9,), (120.0,), (None,)], "m double") == [0, 1, 1, 2, None]


def test_folds_partition(spark):
    rows = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    sizes = sorted(r["count"] for r in P.k_fold(rows, "id", 5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    per = P.stratified_k_fold(rows, "id", "y", 5).groupBy("fold").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in per) == 103 and max(r["ones"] for r in per) - min(r["ones"] for r in per) <= 1
    assert P.k_fold(rows.limit(0), "id", 5).count() == 0


def test_quality_of_nothing(spark):
    row = A.quality(spark.createDataFrame([], "y int, p int"), "y", "p").first()
    assert tuple(row) == (None, None, None, None)


def test_fold_parallel_training_equals_serial(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    y = (x[:, 0] > 0).astype(int)
    rows = [(k, x[k].tolist(), int(y[k]), k % 4) for k in range(40)]
    got = mlp.fold_predictions(spark.createDataFrame(rows, "id int, v array<double>, y int, f int"), "id", "v", "y", "f", 4, epochs=5, hidden=8, seed=None).collect()
    assert len(got) == 40
    folds = np.arange(40) % 4
    for f in range(4):
        net = mlp.Network(6, 8, None).fit(x[folds != f].astype(np.float32), y[folds != f].astype(np.float32), 5, 0.1)
        want = dict(zip(np.flatnonzero(folds == f).tolist(), net.forward(x[folds == f].astype(np.float32))[1]))
        assert all(abs(r["score"] - want[r["id"]]) < 1e-6 for r in got if r["fold"] == f)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "k int, t string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/csv", "k int, t string").collect())) == [(1, 'a "quoted", text'), (2, None)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/one.txt").write_text("two\nlines")
    assert [tuple(r) for r in files.read_documents(spark, f"{tmp_path}/docs").collect()] == [("one.txt", "two\nlines")]
    (tmp_path / "genes.tsv").write_text("Hugo\tEntrez\tP1\nTP53\t7157\t1.5\nABC\t1\t2\n")
    assert files.read_gene_rows(spark, f"{tmp_path}/genes.tsv", ["TP53"]).count() == 1
    for _ in range(2):
        assert files.append_new(df, f"{tmp_path}/grown", ["k"]).count() == 2


def test_append_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, t string")
    df.write.parquet(f"{tmp_path}/source")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/source")
    append_stream(stream, f"{tmp_path}/sink", ["k"], f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 2


def test_article():
    page = "<html><nav>menu</nav><article><h1>Head</h1><div class='ad'><div>buy</div></div><p>One<br><p>two</article><p>after"
    assert web.article(page) == ("Head", "Head One two", 3)
    assert web.article(None) == (None, None, 0) and web.article("") == (None, None, 0)


PAGE = """<html><head><meta property="og:title" content="Alien"><meta itemprop="contentRating" content="R"></head><body><div id="ratingWidget"><p><strong>Alien</strong> (1979)</p></div>
<span itemprop="ratingValue">8.5</span><span itemprop="keywords">space</span><span itemprop="keywords">cat</span><time itemprop="duration">1h 57min</time>
<a href="/genre/x?ref=tt_stry_gnr"> Horror</a><div class="credit_summary_item"><span itemprop="director"><a><span>R. Scott</span></a></span></div>
<table><tr>""" + "".join(f'<td class="itemprop"><a><span class="itemprop">Actor {k}</span></a></td>' for k in range(7)) + """</tr></table>
<div class="txt-block"><h4>Country:</h4><a itemprop="url">UK</a> <a itemprop="url">USA</a></div><div class="txt-block">none</div><div class="txt-block"><h4>Budget:</h4> $11,000,000 <br></div>
<div class="user_score_chart" data-percent="81"></div><li class="profile"><p>Ann</p><p>Director, Writer</p></li><li class="profile"><p>Bo</p></li><li class="card"><p>Cy</p><p>as X</p></li>
<section class="facts left_column"><p>Runtime 1h 57m
Budget $11,000</p></section><section class="genres right_column"><ul><li>War</li></ul></section></body></html>"""


def test_page_records_and_selectors(spark):
    from recordloom.sources import fields

    page = fields.tree(PAGE)
    one, two = fields.first_site(page), fields.second_site(page)
    assert (one["title"], one["release_year"], one["rating"], one["run_time"], one["content_rating"], one["genres"], one["directors"]) == ("Alien", "1979", "8.5", "117", "R", "Horror", "R. Scott")
    assert one["cast"] == "Actor 0;Actor 1;Actor 2;Actor 3;Actor 4" and one["keywords"] == "space;cat" and one["production_countries"] == "UK;USA" and one["budget"] == "$11000000" and one["writers"] == ""
    assert (two["title"], two["rating"], two["directors"], two["writers"], two["cast"], two["run_time"], two["budget"], two["genres"]) == ("Alien", "81", "Ann", "Ann", "Cy", "117", "$11000", "War")
    assert fields.selected(page, "body li.profile p") == ["Ann", "Director, Writer", "Bo"] and fields.selected(page, "p li") == [] and fields.selected(page, "[data-percent]@data-percent") == ["81"]
    df = spark.createDataFrame([(PAGE,), ("",), (None,), ("<p>un<b>closed",)], "html string")
    got = df.select(fields.records(F.col("html")).alias("r")).select("r.*").collect()
    assert got[0]["title"] == "Alien" and all(v is None for r in got[1:] for v in r)
    assert [r[0] for r in df.select(F.get(fields.fields(F.col("html"), {"x": "b"})["x"], 0)).collect()] == [None, None, None, "closed"]


def test_article_chain(spark):
    from recordloom.sources import fields

    pages = {
        '<section id="article-section-1"><aside>ad</aside>one<aside>two</aside></section>': "onetwo",
        '<div class="article-content wide"><div>ad</div>text<aside>x</aside></div>': "text",
        '<article itemprop="articleBody"><div>ad</div>post</article>': "post",
        '<article class="node-article">hill<a class="more">m</a><a class="name">n</a><a>k</a></article>': "hillk",
        '<div id="article-body"><p>lead</p><p>rest</p></div>': "rest",
        "<div>nothing</div>": None,
    }
    got = spark.createDataFrame([(h,) for h in pages], "html string").select(fields.article_texts(F.col("html"))).collect()
    assert [r[0] for r in got] == list(pages.values())


def test_more_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\ttype\ttitle\n1\tmovie\tAlien\n2\tgame\tDoom\n")
    (tmp_path / "n.csv").write_text("last,first\nLee,Ann\nLee,Bo\n")
    (tmp_path / "i.txt").write_text("1 http://a\n\n22 http://b c\n")
    assert [r[0] for r in files.read_titles(spark, str(tmp_path / "t.tsv")).collect()] == ["Alien"]
    assert sorted(r[0] for r in files.read_column(spark, str(tmp_path / "n.csv"), (0, 1), header=True).collect()) == ["Ann", "Bo", "Lee"]
    assert [tuple(r) for r in files.read_index(spark, str(tmp_path / "i.txt")).collect()] == [(1, "http://a"), (22, "http://b c")]
    assert sorted(r["filename"] for r in files.read_names(spark, str(tmp_path)).collect()) == ["i.txt", "n.csv", "t.tsv"]
    files.write_csv(spark.createDataFrame([("b",), ("a",)], "x string"), str(tmp_path / "out"), index=["x"])
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out")).collect())) == [("0", "a"), ("1", "b")]


def test_reshaping_and_ranks(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "x")], "k int, v string")
    assert sorted((r["k"], r["c"]) for r in R.binary_code(df, "v", "c").collect()) == [(1, 0), (2, None), (3, 1), (4, 0)]
    with pytest.raises(ValueError):
        R.binary_code(df.withColumn("v", F.col("k").cast("string")), "v", "c")
    assert sorted((r["k"], r["n"]) for r in P.ranked_by(df.repartition(3), ["k"], "n").collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    kept, dropped = R.without_missing(df, ["v"], "k")
    assert kept.count() == 3 and [r[0] for r in dropped.collect()] == [2]
    assert [[x["k"] for x in r["rows"]] for r in R.collected(df.where("v = 'x'"), ["v"], ["v"], ["k"]).collect()] == [[1, 4]]
    twice = spark.createDataFrame([("g", 2.0, 5.0), ("g", 1.0, 7.0)], "gene string, p1 double, p2 double")
    assert sorted(map(tuple, R.transposed(twice, "gene", ["p1", "p2"], "patient", ["g"]).collect())) == [("p1", 1.0), ("p2", 5.0)]
    empty = R.column_types(df.limit(0), ["v"]).collect()
    assert empty == []


def test_missed_pairs_fall_back_to_common_items(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "z"]), (3, [])], "id int, w array<string>")
    right = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["a", "q", "r", "s"]), (9, ["n"])], "id int, w array<string>")
    candidates = spark.createDataFrame([(1, 7)], "l_id int, r_id int")
    got = [tuple(r) for r in B.missed_pairs(left, right, candidates, "id", "id", "w").collect()]
    assert [g[:2] for g in got] == [(2, 7), (2, 8), (1, 8)] and abs(got[0][2] - 0.25) < 1e-9 and abs(got[1][2] - 0.2) < 1e-9


def test_pair_features_by_type(spark):
    df = spark.createDataFrame([("Alien", 1979, ["a"], "Alien 3", 1992, ["a", "b"]), (None, 1, None, "x", 1, [])], "l_title string, l_year int, l_cast array<string>, r_title string, r_year int, r_cast array<string>")
    schema = spark.createDataFrame([], "title string, year int, cast array<string>, id string").schema
    made = S.pair_features(schema, without=("id",))
    assert set(made) == {"title_lev", "title_words", "title_grams", "title_same", "year_near", "year_same", "cast_set"}
    got = df.select(*(c.alias(n) for n, c in made.items())).collect()
    assert got[0]["title_words"] == 0.5 and got[0]["cast_set"] == 0.5 and got[0]["year_same"] == 0 and got[1]["title_lev"] is None and got[1]["year_near"] == 1.0 and got[1]["cast_set"] is None


def test_keys_and_references(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,l_id\n1,a0\n2,a1\n")
    a = spark.createDataFrame([("a0",), ("a1",)], "id string")
    assert files.read_keyed(spark, str(tmp_path / "c.csv"), "id", references={"l_id": (a, "id")}).count() == 2
    with pytest.raises(ValueError):
        files.read_keyed(spark, str(tmp_path / "c.csv"), "id", references={"l_id": (a.limit(1), "id")})
    assert values(spark, T.first_mark(F.col("t")), [("ab-c",), ("abc",), ("'s",)], "t string") == [2, None, 0]
    assert values(spark, S.dot(F.col("a"), F.col("b")), [([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>") == [11.0]


def test_pages_are_read_one_at_a_time(spark):
    """However many pages a batch has, a tree is gone before the next is made, and no cycle keeps it."""
    import gc

    from recordloom.sources import fields

    before = sum(isinstance(x, fields.Node) for x in gc.get_objects())
    gc.disable()
    try:
        for _ in range(20):
            assert fields._read("<div><p>a<b>c</b></p></div>", lambda page: {"p": fields.selected(page, "p")}) == {"p": ["ac"]}
        assert sum(isinstance(x, fields.Node) for x in gc.get_objects()) <= before
    finally:
        gc.enable()
    page = fields.tree("<p>a &amp; b &lt</p><script>x && '&amp;'</script>", raw=True)
    assert fields.selected(page, "p") == ["a &amp; b &lt"] and page.first("script").text() == "x && '&amp;'"
    sent = spark.range(1000).coalesce(1).select(fields.fields(F.concat(F.lit("<b>"), F.col("id").cast("string"), F.lit("</b>")), {"x": "b"})["x"][0].alias("x")).collect()
    assert [r["x"] for r in sent] == [str(k) for k in range(1000)]


def test_large_blocks_are_dealt_out(spark, monkeypatch):
    """Blocks of more pairs than a task's are cut into cells: the same pairs, no task with all of a block's."""
    monkeypatch.setattr(B, "CELL", 5)
    monkeypatch.setattr(B, "TASK_PAIRS", 50)
    left = spark.createDataFrame([(i, "a" if i < 60 else ["b", None, "c"][i % 3], i % 2) for i in range(80)], "id int, k string, n int")
    right = spark.createDataFrame([(i, "a" if i < 30 else ["b", None, "d"][i % 3], i % 2) for i in range(50)], "id int, k string, n int")
    for keys in (["k"], ["k", "n"]):
        pairs = B.block_pairs(left, right, keys, keys, "id", "id").select("l_id", "r_id", F.spark_partition_id().alias("task")).collect()
        wanted = [(a["id"], b["id"]) for a in left.collect() for b in right.collect() if a["k"] is not None and all(a[c] == b[c] for c in keys)]
        assert sorted((p["l_id"], p["r_id"]) for p in pairs) == sorted(wanted)
        assert max(sum(p["task"] == t for p in pairs) for t in {p["task"] for p in pairs}) < len(wanted) / 4
    where = B.block_where(left, right, lambda l, r: l("id") < r("id"), ["k"]).select("l_id", "r_id").collect()  # noqa: E741
    assert len(where) == sum(a["id"] < b["id"] for a in left.collect() for b in right.collect() if a["k"] is not None and a["k"] == b["k"])


def test_similar_pairs_compare_values_once(spark):
    names = ["Ann Lee", "Lee Ann", "Bo", None, "a b c d e", "a b c d"]
    rows = [(i, "x" if i % 5 else ("y" if i % 2 else None), [names[i % 6]] if i % 6 != 3 else None, [names[(i // 6) % 6]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, block string, a array<string>, b array<string>")
    slow = B.keep_similar(B.block_pairs(df, df, "block", "block", "id", "id"), ["a", "b"]).select("l_id", "r_id")
    got = B.similar_pairs(df, df, "block", "id", "id", ["a", "b"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, slow.collect())) and got.count() > 100


def test_missed_pairs_of_blocks_named_by_a_column(spark):
    """As with the pairs of the blocks spelt out, ties by the ids among them."""
    sets = [["p", "q", "r"], ["p", "q"], ["p", "q", "s"], ["t"], [], ["q", "r", "s"]]
    side = lambda k: spark.createDataFrame([(i, ["m", "n", "o", None][(i * k) % 4], sets[(i + k) % 6]) for i in range(40)], "id int, block string, w array<string>")
    left, right = side(1), side(3)
    found = B.block_pairs(left, right, "block", "block", "id", "id").select("l_id", "r_id")
    for top in (1, 7, 60, 5000):
        one, other = (B.missed_pairs(left, right, c, "id", "id", "w", top).orderBy(F.desc("similarity"), "l_id", "r_id").collect() for c in (found, "block"))
        assert one == other and len(one) > 0


def test_smith_waterman_of_batches(spark):
    """Together, one by one and as an expression the same, whatever the lengths."""
    r = np.random.default_rng(1)
    word = lambda most: "".join(r.choice(list("abcé𝒳"), r.integers(0, most)))
    pairs = [(word(9), word(14)) for _ in range(300)] + [(word(90), word(40)) for _ in range(20)] + [("abc", "abc")] * 3
    for weights in ((1.0, 0.0, 1.0), (2.0, -0.5, 0.25), (1.0, 0.5, 2.0)):
        assert S.smith_waterman_scores(pairs, *weights) == [S.smith_waterman_score(a, b, *weights) for a, b in pairs]
    rows = [*pairs[:40], ("", "a"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    assert [tuple(x) for x in df.select(S.smith_waterman_of(F.col("a"), F.col("b")), S.smith_waterman(F.col("a"), F.col("b"))).collect() if x[0] != x[1]] == []
    assert "Python" not in df.select(S.smith_waterman(F.col("a"), F.col("b")))._jdf.queryExecution().toString()


def test_counted_shuffles_keys_that_come_again(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["a"]), (3, ["a", "c"]), (None, ["x"]), (None, ["x"]), (4, None)]
    got = T.counted(spark.createDataFrame(rows, "id int, words array<string>"), "id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "a", 1), (1, "b", 2), (3, "a", 2), (3, "c", 1), (None, "x", 2)]))
    once = T.counted(spark.createDataFrame(rows[:3], "id int, words array<string>"), "id")
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 3


def test_gazetteer_flags_held_or_joined(spark, monkeypatch):
    """The same where workers hold the words and where they are joined, and no join in the first."""
    found = spark.createDataFrame([(1, 0, "Ann Lee"), (1, 1, "Bo"), (2, 0, "Lee Ann Bo"), (2, 1, "x"), (3, 0, None)], "doc_id int, string_id int, string string")
    lists = {"one": ["Ann", None, "x"], "two": ["Lee", "Ann"], "none": []}
    of = {k: spark.createDataFrame([(w,) for w in v], "word string") for k, v in lists.items()}
    held = T.gazetteer_flags(found, of, ["doc_id", "string_id"])
    assert "Join" not in held._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(map(repr, held.collect()))
    monkeypatch.setattr(T, "LISTED", 1)
    assert got == sorted(map(repr, T.gazetteer_flags(found, of, ["doc_id", "string_id"]).select(held.columns).collect()))
    assert [tuple(r)[3:] for r in sorted(held.collect())][:2] == [(2, 2, 0), (0, 0, 0)]


def test_candidates_of_few_features(spark):
    """Only what is asked for is computed: the same spans, without Python where no frequency is wanted."""
    docs = spark.createDataFrame([(1, "Dr. Ann Lee said Bo, and Ann Lee ran."), (2, "nothing here"), (3, None), (4, "")], "doc_id int, text string")
    whole, few = T.candidates(docs, "doc_id"), T.candidates(docs, "doc_id", features=("prefixed",))
    assert few.columns == ["doc_id", "string_id", "string", "start_index", "end_index", "prefixed"]
    assert sorted(few.collect()) == sorted(whole.select(few.columns).collect()) and few.count() > 3
    assert "Python" not in few._jdf.queryExecution().executedPlan().toString()
