"""Least squares from sufficient statistics, influence, ranks and proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studygrid.functions.tdist import t_p_value, t_ppf
from studygrid.scratch import written


def fit_one(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row ``(n, slope, intercept, se, t)`` of y on x, in one pass; null where it is not defined."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = rows.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    left = F.col("syy") - F.col("slope") * F.col("sxy")
    se = F.sqrt(F.try_divide(F.greatest(left, F.lit(0.0)), (F.col("n") - 2) * F.col("sxx")))
    return sums.withColumn("se", F.when(F.col("n") > 2, se)).select("n", "slope", "intercept", "se", F.try_divide("slope", "se").alias("t"))


def with_inference(fit: DataFrame, parameters: int = 2, alpha: float = 0.05) -> DataFrame:
    df = (F.col("n") - parameters).cast("double")
    return fit.withColumn("p", t_p_value("t", df)).withColumn("reach", t_ppf(F.lit(1 - alpha / 2), df) * F.col("se")).withColumn("ci_low", F.col("slope") - F.col("reach")).withColumn("ci_high", F.col("slope") + F.col("reach")).drop("reach")


def fit_two(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row ``(n, intercept, slope_a, slope_b)`` from centred cross-products."""
    rows = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    s = rows.agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    one = F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det)
    two = F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det)
    return s.select("n", (F.col("my") - one * F.col("ma") - two * F.col("mb")).alias("intercept"), one.alias("slope_a"), two.alias("slope_b"))


def cooks_distance(df: DataFrame, y: str, x: str) -> DataFrame:
    """Rows of ``df`` with ``leverage``, ``residual``, ``cooks`` and ``influential`` (above 4 / n); one row of sums is broadcast."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    s = rows.agg(F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_sxx(y, x).alias("_sxx"), (F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)).alias("_left"))
    out = rows.crossJoin(F.broadcast(s)).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x))
    out = out.withColumn("leverage", 1 / F.col("_n") + F.try_divide(F.pow(F.col(x) - F.col("_mx"), F.lit(2)), F.col("_sxx")))
    d = F.try_divide(F.pow("residual", F.lit(2)) * F.col("leverage"), 2 * F.col("_left") / (F.col("_n") - 2) * F.pow(1 - F.col("leverage"), F.lit(2)))
    return out.withColumn("cooks", d).withColumn("influential", F.coalesce(d > 4 / F.col("_n"), F.lit(False))).drop("_n", "_mx", "_b", "_a", "_sxx", "_left")


def vif_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Variance inflation of two columns in a design without a constant: 1 / (1 - (sum ab)^2 / (sum a^2 sum b^2))."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r2 = F.try_divide(F.pow(F.sum(F.col(a) * F.col(b)), F.lit(2)), F.sum(F.col(a) * F.col(a)) * F.sum(F.col(b) * F.col(b)))
    return rows.agg(F.try_divide(F.lit(1.0), 1 - r2).alias("vif"))


def _ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average ranks, from counts of distinct values in ranges.

    The counts are written once with the number of their range, so that every
    reader sees the same ranges; the only order over all of them is of one row a
    range.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("c")).repartitionByRange(column)
    cut = written(counts.select(column, "c", F.spark_partition_id().alias("part")), "ranks")
    sums = cut.groupBy("part").agg(F.sum("c").alias("s"))
    base = sums.select(F.col("part").alias("part_"), F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = cut.withColumn("below", below).join(F.broadcast(base), F.col("part") == F.col("part_"))
    return df.join(ranks.select(F.col(column).alias("_v"), (F.col("base") + F.col("below") + (F.col("c") + 1) / 2).alias(out)), F.col(column) == F.col("_v")).drop("_v")


def _both(df: DataFrame, a: str, b: str) -> DataFrame:
    """The two columns as doubles, without rows that have a null or NaN."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return rows.where("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)")


def _tested(found: DataFrame, r: str) -> DataFrame:
    """With ``t`` and its two-sided ``p``."""
    t = F.col(r) * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col(r) * F.col(r)))
    return found.withColumn("t", t).withColumn("p", t_p_value("t", (F.col("n") - 2).cast("double")))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, rho, t, p)`` with tied values at their mean rank; nulls and NaN are left out."""
    both = _ranked(_ranked(_both(df, a, b), "a", "ra"), "b", "rb")
    return _tested(both.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho")), "rho")


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, r, t, p)``; nulls and NaN are left out."""
    return _tested(_both(df, a, b).agg(F.count("*").alias("n"), F.corr("a", "b").alias("r")), "r")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """(share, low, high) of k in n; nulls where n is zero."""
    p, n = k / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(p.alias("share"), F.greatest(mid - half, F.lit(0.0)).alias("low"), F.least(mid + half, F.lit(1.0)).alias("high"))


def standardized_difference(mean: Column, sd: Column, ref_mean: Column, ref_sd: Column) -> Column:
    return F.try_divide(mean - ref_mean, F.sqrt((sd * sd + ref_sd * ref_sd) / 2))


def cohens_h(p: Column, ref: Column) -> Column:
    clamp = lambda x: F.asin(F.sqrt(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))))
    return 2 * (clamp(p) - clamp(ref))
