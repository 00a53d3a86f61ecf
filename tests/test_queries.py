"""Every query with SQL gives the rows that DuckDB gives for it."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tomelight.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "tolist"):
            return plain(v.tolist())
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(plain(x) for x in v) + "]"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return f"{float(v):.6g}" if abs(v) < 1 << 20 else str(v)
        return str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) == len(wanted)
    assert canonical(found) == canonical(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
