"""Inference against numpy, and against published figures of 59 trials."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from studygrid.operators import groups, inference, models, regression

# Fixed values: (participants, mean age, year of publication) of the trials behind the published figures.
TRIALS = [
    (53, 66.58792452830188, 2014), (375, 69.00637866666666, 2022), (146, 68.94383561643835, 2021), (112, 70.5, 2018), (87, 67.58045977011494, 2019), (90, 69.76444444444444, 2017),
    (60, 69.83500000000001, 2018), (155, 71.16129032258064, 2006), (54, 69.95, 2022), (103, 66.24854368932039, 2017), (142, 67.5, 2022), (60, 66.15833333333333, 2020),
    (71, 72.47887323943662, 2013), (343, 66.50145772594752, 2017), (4141, 71.97101424776625, 2015), (166, 69.8, 2017), (94, 62.65744680851063, 2021), (90, 69.86555555555555, 2017),
    (134, 68.30000000000001, 2020), (106, 80.2, 2016), (30, 67.0, 2015), (62, 66.51935483870967, 2013), (319, 66.94451410658307, 2018), (40, 65.8, 2009),
    (198, 69.48989898989899, 2023), (116, 69.85862068965517, 2016), (150, 65.43333333333334, 2022), (1225, 69.96971428571428, 2017), (48, 72.10000000000001, 2008), (73, 64.02739726027397, 2023),
    (116, 69.0, 2020), (238, 66.78823529411765, 2016), (125, 68.664, 2013), (39, 69.48717948717949, 2008), (17, 68.23529411764706, 2009), (22, 64.5, 2012),
    (83, 67.89156626506023, 2019), (120, 68.2, 2013), (42, 67.88333333333334, 2020), (256, 68.9, 2013), (132, 63.596969696969694, 2016), (578, 71.79816608996539, 2017),
    (153, 69.81176470588235, 2021), (173, 68.57080924855491, 2023), (44, 70.5, 2014), (229, 71.40043668122271, 2018), (122, 72.16836065573771, 2020), (24, 63.44999999999999, 2014),
    (30, 66.64000000000001, 2014), (36, 73.94444444444444, 2017), (1225, 69.96196734693878, 2017), (147, 65.8455782312925, 2017), (157, 62.46496815286624, 2016), (26, 71.66923076923078, 2014),
    (78, 63.800000000000004, 2021), (86, 69.48837209302326, 2019), (95, 69.51578947368421, 2018), (240, 65.03500000000001, 2018), (120, 64.13333333333334, 2023),
]


@pytest.fixture(scope="module")
def trials(spark):
    return spark.createDataFrame([*TRIALS, (10, None, 2020), (10, math.nan, 2020)], "n int, age double, year int")


def test_published_weighted_mean_and_interval(trials):
    r = groups.weighted_mean_across_groups(trials, "age", "n").first()
    assert (r["n"], r["mean"], r["ci_low"], r["ci_high"]) == (59, pytest.approx(69.7873022947926), pytest.approx(68.3510624635494), pytest.approx(71.2235421260358))


def test_published_slope_p_and_influential_trial(trials):
    known = trials.where("age IS NOT NULL AND NOT isnan(age)")
    r = regression.with_inference(regression.fit_one(known, "age", "year")).first()
    assert (r["n"], r["slope"], r["p"]) == (59, pytest.approx(-0.12517184945866539), pytest.approx(0.216799179106416))
    many = {x["term"]: x for x in inference.fit_many(trials, "age", ["year"]).collect()}
    assert (many["year"]["n"], many["year"]["estimate"], many["year"]["p"]) == (59, pytest.approx(-0.12517184945866539), pytest.approx(0.216799179106416))
    assert (r["ci_low"], r["ci_high"]) == pytest.approx((many["year"]["ci_low"], many["year"]["ci_high"]))
    assert [(x["n"], x["age"]) for x in regression.cooks_distance(known, "age", "year").where("influential").collect()] == [(106, 80.2)]
    assert models.refit(known, "age", "year").first()["n_after"] == 58


def test_two_and_three_predictors_against_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 3)) * [1, 50, 0.01] + [0, 1000, 3]
    y = x @ [2, 0.1, -40] + 5 + r.normal(size=80)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, math.nan)], "a double, b double, c double, y double")
    for k in (1, 2, 3):
        names = ["a", "b", "c"][:k]
        design = np.column_stack([np.ones(80), x[:, :k]])
        beta = np.linalg.lstsq(design, y, rcond=None)[0]
        s2 = ((y - design @ beta) ** 2).sum() / (80 - k - 1)
        se = np.sqrt(s2 * np.diag(np.linalg.inv(design.T @ design)))
        got = inference.fit_many(df, "y", names).collect()
        assert [g["term"] for g in got] == ["Intercept", *names]
        assert [g["estimate"] for g in got] == pytest.approx(list(beta), rel=1e-6)
        assert [g["se"] for g in got] == pytest.approx(list(se), rel=1e-6)
        assert all(g["ci_low"] < g["estimate"] < g["ci_high"] and 0 <= g["p"] <= 1 for g in got)
    two = regression.fit_two(df.where("a IS NOT NULL AND NOT isnan(y)"), "y", "a", "b").first()
    assert two["slope_b"] == pytest.approx(inference.fit_many(df, "y", ["a", "b"]).collect()[2]["estimate"])


def test_models_without_an_answer(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 2.0), (3.0, 6.0, 5.0)], "a double, b double, y double")
    assert {(r["n"], r["estimate"]) for r in inference.fit_many(df, "y", ["a", "b"]).collect()} == {(3, None)}
    tight = inference.fit_many(df.limit(2), "y", ["a"]).collect()
    assert tight[1]["estimate"] == pytest.approx(1.0) and tight[1]["se"] is None and tight[1]["p"] is None
    assert [r["n"] for r in inference.fit_many(df.limit(0), "y", ["a"]).collect()] == [0, 0]


def test_inflation_about_zero(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 4)) + [1, 2, 0, 5]
    x[:, 3] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    want = []
    for j in range(4):
        rest = np.delete(x, j, axis=1)
        left = x[:, j] - rest @ np.linalg.lstsq(rest, x[:, j], rcond=None)[0]
        want.append((x[:, j] ** 2).sum() / (left**2).sum())
    assert [v["vif"] for v in inference.vif(df, ["a", "b", "c", "d"]).collect()] == pytest.approx(want)
    pair = inference.vif(df.where("a IS NOT NULL"), ["a", "b"]).collect()
    assert [v["vif"] for v in pair] == pytest.approx([regression.vif_pair(df.where("a IS NOT NULL"), "a", "b").first()["vif"]] * 2)
    twins = inference.vif(df.withColumn("e", 2 * F.col("a")), ["a", "b", "e"]).collect()
    assert twins[0]["vif"] == twins[2]["vif"] == math.inf and 1 <= twins[1]["vif"] < 10


def test_correlations_leave_nan_out_and_have_p(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, math.nan), (None, 4.0), (5.0, 9.0), (6.0, 4.0)], "a double, b double")
    r, s = regression.pearson(df, "a", "b").first(), regression.spearman(df, "a", "b").first()
    x, y = [1, 2, 3, 5, 6], [1, 3, 2, 9, 4]
    assert (r["n"], r["r"]) == (5, pytest.approx(np.corrcoef(x, y)[0, 1])) and (s["n"], s["rho"]) == (5, pytest.approx(0.8))
    assert s["p"] == pytest.approx(0.10408803866182788) and r["p"] == pytest.approx(regression.with_inference(regression.fit_one(df.where("a IS NOT NULL AND NOT isnan(b)"), "b", "a")).first()["p"])
