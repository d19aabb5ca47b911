"""Every registered query with SQL against that SQL, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    clean = [tuple(None if pd.isna(x) else round(float(x), 6) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False, name=None)]
    return sorted(df.columns), sorted(clean, key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert rows(got) == rows(duck.execute(sql).df())
