"""Every SQL query against the oracle engine, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from curvora.queries import ORACLES, QUERIES

TABLES = "documents labels pages embeddings lineitem events".split()


def canonical(frame):
    """Rows as sorted tuples of text; numbers to five significant decimals."""
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "" if v is None or v != v else f"{float(v):.5f}".replace("-0.00000", "0.00000") if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, sf, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = canonical(ours), canonical(theirs)
    assert len(a) == len(b)
    differing = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not differing, (len(differing), differing[:3])
