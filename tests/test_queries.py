"""Every query against its oracle, and every query without one for rows."""

import compare
import duckdb
import pytest

from rollspark.plans import catalog

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    if name in ORACLES:
        assert compare.differ(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_cost_rollup_of_several_files(spark, tmp_path):
    """Sums that end in about a half round as in the SQL on one thread, which adds in the order of the rows."""
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE l AS SELECT *, row_number() OVER () - 1 AS n FROM '/root/testdata/sf0.1/lineitem.parquet'")
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for i, (start, end) in enumerate([(0, 30_000), (30_000, 210_000), (210_000, 300_000), (300_000, 600_000)]):
        con.execute(f"COPY (SELECT * EXCLUDE (n) FROM l WHERE n >= {start} AND n < {end} ORDER BY n) TO '{folder}/part-{i}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    assert compare.differ(QUERIES["m33_cost_rollup"](spark, str(tmp_path)), con, ORACLES["m33_cost_rollup"]) is None


def test_entry_without_corpus_operators():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
