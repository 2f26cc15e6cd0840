"""Agreement of two raters, by field, in grouped aggregations over long pairs (field, a, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def categorical(pairs: DataFrame, field: str = "field", a: str = "a", b: str = "b") -> DataFrame:
    """``(field, n, percent_agreement, ac1, kappa)``; pairs with a null are left out.

    Marginals of both raters are counted per (field, category) first, so the
    second step sees a row for each category only. One category gives 1.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(field).alias("field"), F.col(a).alias("a"), F.col(b).alias("b"))
    grid = rows.groupBy("field", "a", "b").agg(F.count("*").alias("n"))
    sides = grid.select("field", "n", (F.col("a") == F.col("b")).alias("same"), F.explode(F.array(F.struct(F.col("a").alias("cat"), F.lit(1).alias("ra")), F.struct(F.col("b").alias("cat"), F.lit(0).alias("ra")))).alias("s"))
    by_cat = sides.groupBy("field", F.col("s.cat").alias("cat")).agg(
        F.sum(F.col("n") * F.col("s.ra")).alias("na"), F.sum(F.col("n") * (1 - F.col("s.ra"))).alias("nb"), F.sum(F.when(F.col("same"), F.col("n") * F.col("s.ra")).otherwise(0)).alias("agree")
    )
    n, k = F.sum("na"), F.count("*")
    sums = by_cat.groupBy("field").agg(
        n.alias("n"),
        k.alias("k"),
        F.sum("agree").alias("agree"),
        F.sum((F.col("na") + F.col("nb")).cast("double")).alias("both"),
        F.sum(F.pow((F.col("na") + F.col("nb")).cast("double"), F.lit(2))).alias("squares"),
        F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"),
    )
    po = F.col("agree") / F.col("n")
    # sum p (1 - p) = 1 - sum p^2 with p the mean of both raters' shares.
    chance = F.try_divide(1 - F.col("squares") / F.pow(2 * F.col("n"), F.lit(2)), F.col("k") - 1)
    by_chance = F.col("products") / F.pow(F.col("n"), F.lit(2))
    return sums.select(
        "field",
        "n",
        po.alias("percent_agreement"),
        F.when(F.col("k") <= 1, 1.0).otherwise(F.try_divide(po - chance, 1 - chance)).alias("ac1"),
        F.when(F.col("k") <= 1, 1.0).otherwise(F.try_divide(po - by_chance, 1 - by_chance)).alias("kappa"),
    )


def numerical(pairs: DataFrame, field: str = "field", a: str = "a", b: str = "b") -> DataFrame:
    """``(field, n, icc, na_concordance, mean_diff, sd_diff, lower, upper)``.

    ICC(2,1) of the complete pairs; concordance of missing values over all pairs,
    1 where none is missing; limits of agreement at 1.96 deviations.
    """
    x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    rows = pairs.select(F.col(field).alias("field"), x.alias("x"), y.alias("y"), F.col(a).isNull().alias("na"), F.col(b).isNull().alias("nb"))
    sums = rows.groupBy("field").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.var_samp("x").alias("vx"),
        F.var_samp("y").alias("vy"),
        F.covar_samp("x", "y").alias("cxy"),
        F.least(F.min("x"), F.min("y")).alias("low"),
        F.greatest(F.max("x"), F.max("y")).alias("high"),
        F.coalesce(F.try_divide(F.count_if(F.col("na") & F.col("nb")), F.count_if(F.col("na") | F.col("nb"))), F.lit(1.0)).alias("na_concordance"),
        F.avg(F.col("x") - F.col("y")).alias("mean_diff"),
        F.stddev_samp(F.col("x") - F.col("y")).alias("sd"),
    )
    n, gap = F.col("n"), F.col("mx") - F.col("my")
    subjects = (F.col("vx") + F.col("vy")) / 2 + F.col("cxy")
    error = (F.col("vx") + F.col("vy")) / 2 - F.col("cxy")
    raters = n * gap * gap / 2
    icc = F.when(n < 2, None).when(F.col("low") == F.col("high"), 1.0)
    icc = icc.when(subjects == 0, F.when((raters == 0) & (error == 0), 1.0).otherwise(0.0)).otherwise(F.try_divide(subjects - error, subjects + error + 2 * (raters - error) / n))
    sd = F.when(n == 1, 0.0).otherwise(F.col("sd"))
    return sums.select("field", "n", icc.alias("icc"), "na_concordance", "mean_diff", sd.alias("sd_diff"), (F.col("mean_diff") - 1.96 * sd).alias("lower"), (F.col("mean_diff") + 1.96 * sd).alias("upper"))


def values_match(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equal as numbers within the tolerance if both are numbers (comma and % allowed), else equal texts but for case."""
    number = lambda c: F.rtrim(F.replace(F.trim(c), F.lit(","), F.lit(".")), F.lit("%")).try_cast("double")
    x, y = number(a), number(b)
    near = F.abs(x - y) <= F.greatest(F.lit(tolerance + 1e-9), 1e-9 * F.greatest(F.abs(x), F.abs(y)))
    return F.when(x.isNotNull() & y.isNotNull(), near).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two key arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of white-space tokens; 1 if both are empty, 0 if one is."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.coalesce(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)), F.lit(0.0)))


def structured(pairs: DataFrame, field: str = "field", a: str = "a", b: str = "b") -> DataFrame:
    """``(field, key_jaccard, value_agreement)`` of (key, value) arrays; the last of repeated keys counts.

    Jaccard is the mean over pairs with any key; values agree as a share of all
    keys that both sides have.
    """
    last = lambda c: F.aggregate(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(field).alias("field"), last(F.col(a)).alias("x"), last(F.col(b)).alias("y"))
    common = F.array_intersect(F.map_keys("x"), F.map_keys("y"))
    rows = rows.select("field", jaccard(F.map_keys("x"), F.map_keys("y")).alias("j"), F.size(common).alias("n"), F.size(F.filter(common, lambda k: values_match(F.col("x")[k], F.col("y")[k]))).alias("ok"))
    return rows.groupBy("field").agg(F.avg("j").alias("key_jaccard"), F.try_divide(F.sum("ok"), F.sum("n")).alias("value_agreement"))


def flagged(result: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Adds ``flagged`` and ``reason``: below the threshold, or undefined."""
    m = F.col(metric)
    reason = F.when(m.isNull() | F.isnan(m), F.lit(f"{metric} undefined")).when(m < threshold, F.format_string(f"{metric}=%.3f < {threshold}", m))
    return result.withColumn("reason", reason).withColumn("flagged", F.col("reason").isNotNull())
