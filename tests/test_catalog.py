"""Each query of the library against its SQL on the same tables."""

import os

import duckdb
import pytest

from quarry.plans import catalog, extended

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents lineitem labels events".split()


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 6) if not isinstance(x, str) and hasattr(x, "__float__") else str(x)


QUERIES, ORACLES = catalog.QUERIES | extended.QUERIES, catalog.ORACLES | extended.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()], key=str)
    got = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=str)
    assert got == want and (got or name == "version_diff")


def test_every_query_has_sql_or_a_model():
    assert set(QUERIES) - set(ORACLES) == {"title_similarity", "sample_plan"}


def test_roman_words_are_whole(spark, monkeypatch):
    titles = ["viii", "XXIV mdcc", "mmmdccclxxxviii", "viiix", "", "some title"]
    monkeypatch.setattr(catalog, "_tree", lambda spark, d: spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "doc_id long, pos int, title string"))
    got = {(r.pos, r.word): r.value for r in catalog.roman_words(spark, DIR).collect()}
    assert got == {(0, 0): 8, (1, 0): 24, (1, 1): 1700, (2, 0): 3888, (3, 0): None, (4, 0): None, (5, 0): None, (5, 1): None}


def test_row_boxes_are_all_rows(spark):
    """One box for each row, not for each of 997 pages and 7 numbers."""
    n = catalog.C.read(spark, DIR, "lineitem").count()
    assert catalog._row_boxes(spark, DIR, 0.0).select("page", "id").distinct().count() == n
    pages = catalog.iou_match_rows(spark, DIR).select("page").distinct().count()
    assert pages > 997
