"""Scalar helpers: inverse normal CDF, formatting, significant-digit rounding."""

import math

import pytest
from pyspark.sql import functions as F

from sparkprep.functions import scalar as S


def test_norm_ppf_known_values(spark):
    df = spark.createDataFrame([(p,) for p in (0.001, 0.025, 0.5, 0.8413447460685429, 0.975, 0.999)], "p double")
    got = [r[0] for r in df.select(S.norm_ppf(F.col("p"))).collect()]
    exp = [-3.090232306167813, -1.959963984540054, 0.0, 1.0, 1.959963984540054, 3.090232306167813]
    assert all(math.isclose(g, e, abs_tol=1e-8) for g, e in zip(got, exp))


def test_text_helpers(spark):
    df = spark.createDataFrame([(0.8766, "proj_1753263084_642d62b1_model_x")], "x double, s string")
    r = df.select(S.percent_text(F.col("x")).alias("p"), S.fixed_text(F.col("x")).alias("f"),
                  S.truncate_id(F.col("s")).alias("t"), S.sig_round(F.lit(36588192589.245964), 9).alias("g")).first()
    assert r["p"] == "87.7%" and r["f"] == "0.877"
    sid = "proj_1753263084_642d62b1_model_x"
    assert r["t"] == sid[:15] + "..." + sid[-10:]
    assert r["g"] == pytest.approx(36588192600.0)
