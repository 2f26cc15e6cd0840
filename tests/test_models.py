import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from studygrid.operators import models, regression


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    x, z = r.normal(size=60), r.normal(size=60)
    y = 2 * x - z + r.normal(size=60)
    y[0] += 30
    data = [(float(a), float(b), float(c), i % 7) for i, (a, b, c) in enumerate(zip(x, y, z))]
    return spark.createDataFrame(data + [(None, 1.0, 1.0, 1), (1.0, None, 1.0, 1)], "x double, y double, z double, g int"), x, y, z


def test_partial_slope_is_that_of_two_predictors(rows):
    df = rows[0]
    two = regression.fit_two(df, "y", "x", "z").first()
    assert models.partial_slope(df, "y", "x", "z").first()["slope"] == pytest.approx(two["slope_a"])


def test_refit_and_residuals(rows):
    df, x, y, _ = rows
    design = np.column_stack([np.ones(60), x])
    beta, h = np.linalg.lstsq(design, y, rcond=None)[0], np.diag(design @ np.linalg.inv(design.T @ design) @ design.T)
    e = y - design @ beta
    s2 = e @ e / 58
    keep = e**2 * h / (2 * s2 * (1 - h) ** 2) <= 4 / 60
    r = models.refit(df, "y", "x").first()
    assert r["slope"] == pytest.approx(beta[1]) and r["n_after"] == keep.sum() and r["n_influential"] == 60 - keep.sum()
    assert r["slope_after"] == pytest.approx(np.linalg.lstsq(design[keep], y[keep], rcond=None)[0][1])
    got = sorted(t["studentized"] for t in models.studentized(df, "y", "x").collect())
    assert got == pytest.approx(sorted(e / np.sqrt(s2 * (1 - h))))


def test_clusters(rows):
    df, x, y, _ = rows
    design = np.column_stack([np.ones(60), x])
    bread = np.linalg.inv(design.T @ design)
    e = y - design @ (bread @ design.T @ y)
    meat = sum(np.outer(s, s) for s in (design[np.arange(60) % 7 == g].T @ e[np.arange(60) % 7 == g] for g in range(7)))
    se = math.sqrt((bread @ meat @ bread)[1, 1] * 7 / 6 * 59 / 58)
    r = models.with_normal_p(models.fit_clustered(df, "y", "x", "g")).first()
    assert r["clusters"] == 7 and r["se"] == pytest.approx(se) and r["p"] == pytest.approx(2 * (1 - statistics.NormalDist().cdf(abs(r["z"]))))
    assert models.fit_clustered(df.where("x > 99"), "y", "x", "g").first()["se"] is None


def test_normal_points(spark, rows):
    p = [0.0, 1e-6, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = [r["q"] for r in spark.createDataFrame([(v,) for v in p], "p double").select(models.normal_quantile(F.col("p")).alias("q")).collect()]
    assert got[0] is None and got[1:] == pytest.approx([statistics.NormalDist().inv_cdf(v) for v in p[1:]], abs=1e-8)
    points = sorted((r["value"], r["theoretical"]) for r in models.normal_points(rows[0].where("x is not null"), "x").collect())
    assert points[1][1] == pytest.approx(statistics.NormalDist().inv_cdf((2 - 0.3175) / 61.365), abs=1e-8)


def test_smoothing_keeps_a_line_and_resists_one_outlier(spark):
    line = [(float(i), 3.0 * i + 1 + (0.1 if i % 2 else -0.1)) for i in range(50)]
    df = spark.createDataFrame(line + [(25.0, 900.0)], "x double, y double")
    got = {r["x"]: r["y"] for r in models.smoothed(df, "y", "x", [0, 25, 49]).collect()}
    assert got == {0.0: pytest.approx(1, abs=0.5), 25.0: pytest.approx(76, abs=0.5), 49.0: pytest.approx(148, abs=0.5)}
    assert models.smoothed(df.where("x < 0"), "y", "x", [1.0]).first()["y"] is None


def test_cohorts(spark):
    means = spark.createDataFrame([("age", 70.0, 8.0, 1.0), ("bmi", None, 1.0, 1.0), ("female", 40.0, None, 2.0)], "variable string, mean double, sd double, se double")
    cohorts = spark.createDataFrame([("A", "age", 65.0, 6.0), ("B", "age", 65.0, None), ("A", "bmi", 25.0, 2.0)], "cohort string, variable string, mean double, sd double")
    r = models.against_cohorts(means, cohorts).collect()
    assert len(r) == 1 and r[0]["smd"] == pytest.approx(5 / math.sqrt(50)) and r[0]["high"] == pytest.approx(r[0]["smd"] + 1.96 / math.sqrt(50))
    assert models.against_cohorts(means, cohorts, glass=True).first()["smd"] == pytest.approx(5 / 6)
    h = models.share_against_cohorts(means, spark.createDataFrame([("A", "female", 50.0)], "cohort string, variable string, mean double")).first()
    assert h["smd"] == pytest.approx(2 * math.asin(math.sqrt(0.4)) - 2 * math.asin(math.sqrt(0.5)))
    named = spark.createDataFrame([(0.05,), (-0.1,), (0.3,), (-2.0,), (None,)], "s double").select(models.bands(F.col("s")).alias("b"))
    assert [x["b"] for x in named.collect()] == ["none", "small", "medium", "large", None]
    both = models.weighted_and_simple(spark.createDataFrame([(1.0, 10, 1), (3.0, 30, None), (None, 10, 1)], "a double, w int, b int"), ["a", "b"], "w")
    assert {x["field"]: (x["n"], x["difference"]) for x in both.collect()} == {"a": (2, 0.5), "b": (2, 0.0)}
