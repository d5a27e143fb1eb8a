"""Queries: profiles, grouped statistics, cleaning, coding, reshaping, splits and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import similarity as S
from recordloom.operators import records as R
from recordloom.operators import split as P
from recordloom.operators import stats as A
from recordloom.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS stddev, count_if({c} IS NULL)::BIGINT AS nulls FROM lineitem" for c in _PROFILED))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.profile(table(spark, sf_dir, "lineitem"), list(_PROFILED))
    return out.select("column", "min", "max", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "nulls")


@query("""
SELECT year(l_shipdate)::INTEGER AS ship_year, round(avg(l_extendedprice), 4) AS avg_price, round(stddev_pop(l_extendedprice), 4) AS std_price, round(avg(l_quantity), 4) AS avg_qty, round(stddev_pop(l_quantity), 4) AS std_qty
FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND year(l_shipdate) >= 1996 AND year(l_shipdate) < 2001 GROUP BY 1 ORDER BY 1
""")
def group_stats_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("ship_year"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    kept = rows.where("price IS NOT NULL AND qty IS NOT NULL AND ship_year >= 1996 AND ship_year < 2001")
    out = A.group_stats(kept, ["ship_year"], ["price", "qty"])
    return out.select("ship_year", *(F.round(c, 4).alias(c) for c in out.columns[1:])).orderBy("ship_year")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def pearson_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("corr", 6).alias("corr"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def argmax_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_row(table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1997), "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


_TYPED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS n_distinct, count_if({c} IS NULL) > 0 AS has_null, CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' WHEN bool_and(try_cast({c}::VARCHAR AS DOUBLE) IS NOT NULL OR {c} IS NULL) AND count(DISTINCT {c}) > 20 THEN 'numerical' ELSE 'categorical' END AS kind FROM customer" for c in _TYPED))
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(*(F.col(c).cast("string").alias(c) for c in _TYPED))
    return R.column_types(rows, list(_TYPED))


@query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_custkey % 7 = 0) AND NOT (c_custkey % 11 = 0) AND c_mktsegment IS NOT NULL
""")
def dropna_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "NA").when(F.col("c_custkey") % 11 == 0, "not available").otherwise("x").alias("status"))
    return R.nulled(rows, ["c_mktsegment", "status"]).dropna("any").select("c_custkey", "c_mktsegment")


@query("""
SELECT CASE WHEN o_totalprice / 12 / 1000 < 5 THEN 0 WHEN o_totalprice / 12 / 1000 < 10 THEN 1 ELSE 2 END::INTEGER AS survival, count(*) AS n
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1
""")
def survival_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(R.bucket(F.col("o_totalprice") / 12 / 1000, [5, 10]).alias("survival")).dropna()
    return rows.groupBy("survival").agg(F.count("*").alias("n"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT o_orderkey, " + ", ".join(f"coalesce((o_orderpriority = '{p}')::INTEGER, 0) AS \"o_orderpriority_{p}\"" for p in _PRIORITIES) + " FROM orders")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", list(_PRIORITIES)).drop("o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, (dense_rank() OVER (ORDER BY l_linestatus) - 1)::INTEGER AS code FROM lineitem WHERE l_linestatus IS NOT NULL")
def binary_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.binary_code(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), "l_linestatus", "code").select("l_orderkey", "l_linenumber", "code")


@query("SELECT quality, toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY 1, 2")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("share", F.round("share", 6))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS product FROM embeddings")
def dot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.dot(F.col("embedding"), F.reverse("embedding")), 5).alias("product"))


@query("SELECT 'c' || (row_number() OVER (ORDER BY c_custkey) - 1) AS id, c_custkey, c_name FROM customer")
def generated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_key(P.ranked_by(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], "n"), "c", "n")


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ' ') AS orders, count(*) AS n FROM orders GROUP BY o_custkey")
def grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.collected(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_totalprice"], ["o_orderkey"])
    return found.select("o_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), " ").alias("orders"), F.size("rows").cast("bigint").alias("n"))


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS dropped FROM orders")
def dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a missing value, whose keys are kept apart from the others."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    kept, dropped = R.without_missing(rows, ["price"], "o_orderkey")
    return kept.select("o_orderkey", F.lit(False).alias("dropped")).union(dropped.select("o_orderkey", F.lit(True)))


@query("SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_NATIONS = tuple(range(25))


@query("SELECT c_mktsegment AS segment, " + ", ".join(f"count_if(c_nationkey = {n})::BIGINT AS \"{n}\"" for n in _NATIONS) + " FROM customer GROUP BY c_mktsegment")
def transpose_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", list(_SEGMENTS)).count().fillna(0)
    out = R.transposed(counts, "c_nationkey", list(_SEGMENTS), "segment", list(_NATIONS))
    return out.select("segment", *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias(str(n)) for n in _NATIONS))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber <> 3 THEN l_quantity END, (SELECT avg(CASE WHEN l_linenumber <> 3 THEN l_quantity END) FROM lineitem)), 4) AS qty FROM lineitem")
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("qty"))
    return R.impute_mean(rows, ["qty"]).select("l_orderkey", "l_linenumber", F.round("qty", 4).alias("qty"))


_ORDER = "md5('0:' || o_orderkey)"


@query(f"SELECT o_orderkey, (ntile(5) OVER (ORDER BY {_ORDER}, o_orderkey) - 1)::INTEGER AS fold FROM orders")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.k_fold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(f"SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ORDER}, o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders")
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stratified_k_fold(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5).select("o_orderkey", "o_orderstatus", "fold")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_ORDER}, o_orderkey) - 1 >= ceil((SELECT count(*) FROM orders) * 0.75) AS is_test FROM orders")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.train_test(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.25)


@query(f"SELECT fold, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, (ntile(5) OVER (ORDER BY {_ORDER}, o_orderkey) - 1)::INTEGER AS fold FROM orders) GROUP BY fold")
def union_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = kfold(spark, sf_dir)
    whole = R.union_all([folds.where(F.col("fold") == k) for k in range(5)])
    return whole.groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 800).cast("int").alias("by_length"), (F.regexp_count("text", F.lit("[%#$*&|]")) == 0).cast("int").alias("by_symbols"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


_JUDGED_SQL = "(SELECT l.doc_id, quality, (length(text) >= 800)::INTEGER AS by_length, (NOT regexp_matches(text, '[%#$*&|]'))::INTEGER AS by_symbols FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query(f"SELECT quality, by_length, count(*) AS n FROM {_JUDGED_SQL} GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(_judged(spark, sf_dir), "quality", "by_length")


def _quality_sql(name: str, p: str) -> str:
    return f"""SELECT '{name}' AS model, round(count_if(quality = {p}) / count(*), 6) AS accuracy, round(count_if(quality = 1 AND {p} = 1) / count_if({p} = 1), 6) AS precision,
    round(count_if(quality = 1 AND {p} = 1) / count_if(quality = 1), 6) AS recall, round(2 * count_if(quality = 1 AND {p} = 1) / (count_if(quality = 1) + count_if({p} = 1)), 6) AS f1 FROM {_JUDGED_SQL}"""


@query(f"{_quality_sql('by_length', 'by_length')} UNION ALL {_quality_sql('by_symbols', 'by_symbols')}")
def prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    out = R.union_all([A.quality(rows, "quality", m).select(F.lit(m).alias("model"), "*") for m in ("by_length", "by_symbols")])
    return out.select("model", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(f"SELECT * FROM ({_quality_sql('by_length', 'by_length')} UNION ALL {_quality_sql('by_symbols', 'by_symbols')}) ORDER BY f1 DESC, model LIMIT 1")
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_row(prf1(spark, sf_dir), "f1", "model")


@query(f"SELECT doc_id, quality, by_length, by_symbols FROM {_JUDGED_SQL} WHERE quality <> by_length OR quality <> by_symbols")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("quality <> by_length OR quality <> by_symbols").select("doc_id", "quality", "by_length", "by_symbols")
