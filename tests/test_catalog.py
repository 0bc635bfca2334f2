"""Every registered query against its SQL on the smallest tables, where they are at hand."""

import os

import pandas as pd
import pytest

import __spark_entry__
from scriptorium.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(df):
    cell = lambda x: "-" if pd.isna(x) else repr(round(float(x), 9)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0 or name == "search_gated"


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_todo_whole_loses_no_row(spark):
    got = catalog.QUERIES["todo_anti"](spark, SF)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert got.count() == docs.join(labels, "doc_id", "left_anti").count() > 50


def test_phrase_tiles_wants_the_whole_text(spark, tmp_path):
    opening = "the opening that both of the passages share, "
    spark.createDataFrame([(opening + "then one",), (opening + "then two",), ("a short passage",)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, opening, 99), (2, f"so {opening}then one more", 9), (3, "it has a short passage too", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.phrase: r.key for r in catalog.QUERIES["phrase_tiles"](spark, str(tmp_path)).collect()}
    assert got == {opening + "then one": 2, "a short passage": 3}


def test_caption_names_have_the_whole_number(spark, tmp_path):
    spark.createDataFrame([(7, "en"), (12345, "de"), (987654321, "fr")], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.stem, r.lang, r.seq, r.video_id) for r in catalog.QUERIES["caption_names"](spark, str(tmp_path)).collect()}
    assert got == {
        7: ("0007_A_Title_xxxxxx7_-aB", "en", 7, "xxxxxx7_-aB"), 12345: ("1234_A_Title_xx12345_-aB", "de", 12345, "xx12345_-aB"),
        987654321: ("9876_A_Title_9876543_-aB", "fr", 987654321, "9876543_-aB"),
    }
