"""Each query of the core library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from recordloom.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(values):
    one = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return sorted(repr(tuple(map(one, r))) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.select(*[f"`{c}`" for c in columns]).collect()) == rows(found.fetchall())


@pytest.mark.parametrize("name", ["smith_waterman_titles", "html_article_udf", "page_records", "mlp_sgd_folds"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_page_fields_spells_as_sql(spark, tmp_path):
    """References without a semicolon, others than the three of markup, and those in links stay as they are."""
    page = '<html lang="en"><nav><li><a href="/a?x=1&amp;y=2">a</a></li></nav><div class="ad">R&amp;D</div><article><h1>{}</h1><p>x</p><script>if (a &amp;&amp; b) "&"</script></article></html>'
    headings = ["cut &amp", "a &quot;b&quot; &lt;c&gt;", "&amp;lt; &#65; & &nbsp;", "plain"]
    spark.createDataFrame([(k, page.format(h)) for k, h in enumerate(headings)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL["page_fields"])
    got = QUERIES["page_fields"](spark, str(tmp_path)).select([c[0] for c in found.description]).collect()
    assert rows(got) == rows(found.fetchall()) and "&amp" in {r["heading"].split()[-1] for r in got}
