"""Every registered core query against its SQL, on a small scale; queries without SQL must at least run."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from arcwarden.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def answers(spark):
    """All queries, some at a time; an exception stands for an answer."""

    def ask(name):
        try:
            return registry.QUERIES[name](spark, SF).toPandas()
        except Exception as e:
            return e

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(registry.QUERIES, pool.map(ask, registry.QUERIES), strict=True))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    missing = lambda v: v is None or not hasattr(v, "__len__") and pd.isna(v)
    number = lambda v: isinstance(v, float) or hasattr(v, "dtype")
    return sorted(tuple("" if missing(v) else f"{float(v):.9g}" if number(v) and not isinstance(v, (bool, str)) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(answers, duck, name):
    got = answers[name]
    if isinstance(got, Exception):
        raise got
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
        assert len(want), "nothing is asked of this query here"
