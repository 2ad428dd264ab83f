"""The registered queries that SQL can express, against their SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from curvora.llm.queries import ORACLES, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = rows(QUERIES[name](spark, sf).toPandas()), rows(con.sql(ORACLES[name]).df())
    assert ours == theirs and len(ours[1])
