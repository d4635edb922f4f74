"""Every graph query that SQL can express, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tesserae import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df, columns):
    blank = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>") else x
    plain = lambda x: int(x) if isinstance(x, float) and x == int(x) else x  # noqa: E731  pandas turns whole numbers beside nulls into floats
    return sorted((tuple(str(plain(blank(x))) for x in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_question_hints_reads_every_text(spark):
    texts = sorted(r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").select("text").collect())
    assert sorted(r.question for r in queries.queries()["question_hints"](spark, SF).collect()) == texts


def test_by_name_answers_however_many_bear_the_name(spark, tmp_path):
    names = spark.range(2500).selectExpr("id as p_partkey", "if(id = 2400, 'red plate', 'Red plate') as p_name")
    for table, key in {"region": "r", "nation": "n", "customer": "c", "supplier": "s"}.items():
        spark.sql(f"select 1L as {key}_{table if table in ('region', 'nation') else dict(customer='cust', supplier='supp')[table]}key, 'x' as {key}_name").write.parquet(f"{tmp_path}/{table}.parquet")
    names.write.parquet(f"{tmp_path}/part.parquet")
    got = queries.queries()["by_name"](spark, str(tmp_path)).orderBy("rank").collect()
    assert len(got) == 20 and (got[0].entity_id, got[0].exact) == ("acme.shop.erp.supply.part.p2400", True)


def test_answer_text_counts_all_matches_and_groups(spark, tmp_path):
    spark.range(130).selectExpr("id as doc_id", "if(id < 120, 'therst anoned', 'other words') as text", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(30).selectExpr("id as page_id", "'x' as url", "concat('<p>anoned ', repeat('filler ', 40), '</p>') as html").write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(8).selectExpr("id as conv_id", "0 as turn", "'user' as role", "concat('therst ', repeat('more filler ', 40)) as text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.answer for r in queries.queries()["answer_text"](spark, str(tmp_path)).collect()] == ["Found 158 matching entities in 3 groups"]
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert con.sql(queries.oracle_sql()["answer_text"]).fetchall() == [("Found 158 matching entities in 3 groups",)]
