"""Every query with SQL gives the rows of that SQL, and every query runs, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quire.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == wanted


def test_nothing_outside_llm_imports_it():
    for path in glob.glob(os.path.join(os.path.dirname(registry.__file__), "..", "**", "*.py"), recursive=True):
        if "/llm/" not in os.path.normpath(path):
            assert "quire.llm" not in open(path, encoding="utf-8").read()


def test_equal_names_of_a_site_have_places_by_page(spark, tmp_path):
    # the SQL leaves their order open, so it is fixed here: the same on every run
    rows = [(n, f"http://a.example/{n % 17}/7.html", "") for n in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(23).write.parquet(f"{tmp_path}/pages.parquet")
    found = registry.queries()["chapter_places"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.place) for r in found) == [(n, n + 1) for n in range(400)]


def test_numbers_of_any_length_have_the_places_of_the_sql(spark, tmp_path):
    import duckdb

    most = (1 << 127) - 1
    names = ["7.html", "007.html", "0.html", "12.html", "0" * 60 + "5.html", f"{10 ** 38}.html", f"{10 ** 38 - 1}.html", f"{most}.html", f"{most + 1}.html", "9" * 39, "1" * 45, "none.html"]
    rows = [(n, f"https://a.example/{name}", "") for n, name in enumerate(names)] + [(90, None, ""), (91, "3", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    own = duckdb.connect()
    own.execute(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    wanted = own.execute(f"select page_id, url, place, error from ({registry.oracle_sql()['chapter_places']})").fetchall()
    found = registry.queries()["chapter_places"](spark, str(tmp_path)).select("page_id", "url", "place", "error").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
