"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from quadloom.plans.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else str(x) if isinstance(x, (str, bool)) or not hasattr(x, "__round__") else round(float(x), 5)
    return Counter(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_prompt_budget_of_short_texts(spark, tmp_path):
    texts = [None if i % 7 == 0 else "x" * (i % 90) for i in range(3_000)]
    docs = pd.DataFrame({"doc_id": range(3_000), "text": texts, "n_chars": pd.array([None if t is None else len(t) for t in texts], "Int64")})
    docs.sample(frac=1, random_state=1).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(ORACLE_SQL["q_prompt_budget"]).df()
    assert len(want) > 1_000
    assert rows(QUERIES["q_prompt_budget"](spark, str(tmp_path)).toPandas()) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
