"""The driver's contract: every query runs, and those with SQL give its rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from prosemetrics import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    of = lambda v: f"{v:.9g}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)
    return sorted(tuple(of(v) for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["sentence_split", "word_counts", "text_shape", "gate_decision", "ratchet", "route_first_match", "double_fire", "sign_test", "fix_prose", "vocabulary_join", "check_negative_listing", "check_swallowed_exception", "compare_quality", "html_paragraphs"])
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    want = [tuple(r[columns.index(c)] for c in names) for r in rel.fetchall()]
    assert sorted(columns) == names and plain(df.select(*names).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = catalogue.queries()[name](spark, SF).collect()
    if name == "calibration_whole":  # one row a check on which all controls agree, and in documents read as procedure there may be none
        agreed = catalogue.queries()["consensus_quality_whole"](spark, SF).filter("verdict = 'discriminates'").collect()
        assert {r["check_id"] for r in rows} == {r["check_id"] for r in agreed}
    else:
        assert rows


def test_manifest_gives_the_rows_of_its_sql_beyond_one_range(spark, tmp_path):
    """A source of more documents than one range holds, with ids that repeat, and texts and sources that are null."""
    sql = """SELECT least(i, 10010) AS doc_id, CASE WHEN i % 7 > 0 THEN 'text ' || i END AS text, CASE WHEN i < 10020 THEN 'a' WHEN i < 10030 THEN 'b' END AS source FROM range(10040) t(i)"""
    con = duckdb.connect()
    con.execute(f"create table documents as {sql}")
    con.execute(f"copy documents to '{tmp_path}/documents.parquet'")
    want = con.execute(catalogue.oracle_sql()["manifest"]).fetchall()
    got = catalogue.queries()["manifest"](spark, str(tmp_path)).select("source", "documents", "words", "sha256").collect()
    assert len(want) == 3 and plain(got) == plain(want)
