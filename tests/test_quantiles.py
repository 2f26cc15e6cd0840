import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from studygrid.operators import groups, quantiles, tables


def plain(values, probs):
    known = [v for v in values if v is not None and not math.isnan(v)]
    return [float(np.quantile(known, p)) if known else None for p in probs]


@pytest.mark.parametrize("small", [100_000, 300])
def test_selection_equals_the_plain_quantile(spark, small):
    """Ranges are narrowed for the small bounds; ties, infinities, nulls, NaN, outliers and a null group."""
    rng = random.Random(3)
    by = {
        "even": [rng.random() for _ in range(4000)], "ties": [float(rng.randint(0, 3)) for _ in range(3000)], "one value": [7.0] * 2000,
        "outliers": [rng.lognormvariate(0, 40) for _ in range(3001)], "few": [2.0, 1.0], "single": [5.5], "none": [None, math.nan],
        "mixed": [*([None, math.nan] * 500), *(float(i) for i in range(1500))], None: [-1.0, -3.0, -2.0, 1e300, -1e300],
    }
    rows = [(k, v) for k, some in by.items() for v in some]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.3, 0.999]
    got = {r["g"]: (list(r)[1:-1], r["n"]) for r in quantiles.exact_quantiles(df, "v", probs, ["g"], small).collect()}
    assert set(got) == set(by)
    for k, some in by.items():
        want = plain(some, probs)
        assert got[k][0] == (want if want[0] is None else pytest.approx(want, rel=1e-12)), k
        assert got[k][1] == sum(v is not None and not math.isnan(v) for v in some)


def test_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert tuple(quantiles.exact_quantiles(df, "v", [0.5, 0.75]).first()) == (2.0, 3.0, 3)
    assert tuple(quantiles.exact_quantiles(df.limit(0), "v", [0.5]).first()) == (None, 0)
    assert quantiles.exact_quantiles(df.limit(0).withColumn("g", F.lit(1)), "v", [0.5], ["g"]).count() == 0


def test_ten_million_rows_of_one_group_in_small_ranges(spark):
    """Nothing in a task holds more than a grid or ``small`` values of the group."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("hot").alias("g"), ((F.col("id") * 7_368_787) % n).cast("double").alias("v"))
    began = time.time()
    got = quantiles.exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["g"], small=50_000).first()
    assert tuple(got) == ("hot", 2_499_999.75, 4_999_999.5, 7_499_999.25, n)
    assert time.time() - began < 120
    plan = groups.quartiles(df.limit(10), "v", "g")._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_report_tables_use_the_selection(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, False), ("b", None, True), (None, 3.0, None)], "bucket string, value double, flagged boolean")
    assert sorted(map(tuple, tables.bucket_summary(df).collect()), key=str) == [("a", 2, 1, 1.5), ("b", 1, 1, None), (None, 1, 0, 3.0)]
    got = {r["characteristic"]: r["value"] for r in tables.characteristics(df, ["value"], ["bucket"]).collect()}
    assert got == {"n": "4", "value": "2.00 (1.00 to 3.00)", "bucket": "a (2), b (1)"}
