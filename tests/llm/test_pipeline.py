"""The pipeline's stages keep clean documents and do what they say."""

import corpus_pipeline

from recordloom.llm import components, simhash_dedup
from recordloom.llm.common import cut

#: In the manner of the tables' English.
PROSE = "Is and retitioning the of, by this and with ineaer therean the. Ores the that the, and hath of ering onheed, with the erenst thaner ing tionha and, the by this rely onnting."


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir), name)
        assert after.columns == columns
        assert 0.8 * before <= after.count() <= before
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs, before = after, after.count()
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == before
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len([n for n in __spark_entry__.queries() if n.startswith("op")]) == 10


def test_clashing_columns_and_nulls(spark, sf_dir):
    rows = [(1, PROSE[:120], "en", "a", 1, 1, 2, 3), (None, None, None, None, None, None, None, None), (2, "token: abcdefghijklmnop " + PROSE, "en", "b", 5, 1, 2, 3), (3, "", "en", "b", 0, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, language int, blob int, spans int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.dtypes == docs.dtypes
        kept = {r["doc_id"]: r for r in got.collect()}
        assert 1 in kept and 2 in kept and kept[1]["blob"] == 2
        if name == "secret_scan":
            assert kept[2]["text"] == "[secret] " + PROSE and kept[2]["n_chars"] == len(kept[2]["text"]) and kept[None]["text"] is None


def test_near_duplicates_stay_off_the_driver(spark, sf_dir, monkeypatch):
    """Whatever Spark takes for small, the tables of the near-duplicate stage are never sent through the driver."""
    docs, plans = spark.read.parquet(f"{sf_dir}/documents.parquet"), []

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *args)

    for module in (corpus_pipeline, components, simhash_dedup):
        monkeypatch.setattr(module, "cut", noted)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "1g")
    try:
        corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    finally:
        spark.conf.set(threshold, before)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
