"""Columns that don't vary."""

from __future__ import annotations

import numpy as np

from curvora.functions.dialect import SPARK
from curvora.operators import modelling as P


def test_correlation_with_what_does_not_vary(spark):
    rows = [("1.0D", "2.0D", "2.0D", "3.0D", "0.5D"), ("1.0D", "3.0D", "4.0D", "1.0D", "0.25D")]
    values = ", ".join(f"({', '.join(r)})" for r in rows)
    spark.sql(f"select * from values {values} t({', '.join(P.FEATURES)})").createOrReplaceTempView("constant_plots")
    got = {(r.feature_1, r.feature_2): r.r for r in spark.sql(P.pearson("constant_plots")[1](SPARK)).collect()}
    assert all(np.isnan(got["f_mean", f]) for f in P.FEATURES[1:])
    assert got["f_std", "f_range"] == 1.0 and got["f_std", "f_median"] == -1.0
