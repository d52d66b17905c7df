"""The driver's queries on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__
from codeloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    # pandas turns whole numbers beside nulls into floats
    plain = lambda x: int(x) if isinstance(x, float) and x == int(x) else x
    rows = lambda df: sorted(str(tuple(map(plain, r))) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_synthetic_repository_counts(spark):
    from codeloom.sources.synth import expected

    want, got = expected(200), {r["kind"]: r["n"] for r in queries.go_synth_index(spark, SF).collect()}
    assert got == {"import_out": want["import_out"], "ref_def": want["ref_def"]}
    assert sum(r["n"] for r in queries.go_symbols(spark, SF).collect()) == want["symbols"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
