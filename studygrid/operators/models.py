"""More on fitted lines: refits, clustered errors, partial slopes, residual points, smoothing, and effects against cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studygrid.functions.tdist import normal_p_value
from studygrid.operators.quantiles import exact_quantiles
from studygrid.operators.regression import _ranked, cohens_h, cooks_distance, standardized_difference


def _known(df: DataFrame, *names: str) -> DataFrame:
    test = F.lit(True)
    for n in names:
        test = test & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
    return df.where(test)


def partial_slope(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """One row ``(n, slope)``: of y on x, both freed of z. It equals the slope of residuals on residuals, in one pass."""
    s = _known(df, y, x, z).agg(F.count("*").alias("n"), F.var_pop(z).alias("zz"), F.var_pop(x).alias("xx"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"), F.covar_pop(x, y).alias("xy"))
    left = lambda a, b, c: F.col(a) - F.try_divide(F.col(b) * F.col(c), F.col("zz"))
    return s.select("n", F.try_divide(left("xy", "xz", "yz"), left("xx", "xz", "xz")).alias("slope"))


def refit(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row of the line through all rows and through those that are not influential.

    ``(n, slope, n_influential, n_after, slope_after, intercept_after)``. The rows
    themselves are ``cooks_distance(...).where("influential")``.
    """
    rows = cooks_distance(df, y, x)
    keep = F.when(~F.col("influential"), F.col(y))
    return rows.agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.count_if("influential").alias("n_influential"),
        F.count(keep).alias("n_after"), F.regr_slope(keep, F.col(x)).alias("slope_after"), F.regr_intercept(keep, F.col(x)).alias("intercept_after"),
    )


def fit_clustered(df: DataFrame, y: str, x: str, cluster: str) -> DataFrame:
    """One row ``(n, clusters, slope, se, z)``: the slope with errors that may go together within clusters.

    Sandwich estimate with the factor G/(G-1) (n-1)/(n-2). Each cluster is summed
    up before the second step; the line is one broadcast row.
    """
    rows = _known(df, y, x).where(F.col(cluster).isNotNull())
    line = rows.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("a"), F.regr_sxx(y, x).alias("sxx"))
    pull = (F.col(x) - F.col("mx")) * (F.col(y) - F.col("a") - F.col("slope") * F.col(x))
    each = rows.crossJoin(F.broadcast(line)).groupBy(cluster).agg(F.sum(pull).alias("u"))
    meat = each.agg(F.count("*").alias("clusters"), F.sum(F.col("u") * F.col("u")).alias("meat"))
    g, n = F.col("clusters"), F.col("n")
    factor = F.try_divide(g * (n - 1), (g - 1) * (n - 2))
    se = F.sqrt(factor * F.col("meat")) / F.nullif(F.col("sxx"), F.lit(0.0))
    return line.crossJoin(meat).withColumn("se", se).select("n", "clusters", "slope", "se", F.try_divide("slope", "se").alias("z"))


def with_normal_p(fit: DataFrame, z: str = "z") -> DataFrame:
    return fit.withColumn("p", normal_p_value(z))


def studentized(df: DataFrame, y: str, x: str) -> DataFrame:
    """Rows of ``cooks_distance`` with ``studentized``: the residual over its own standard error."""
    rows = cooks_distance(df, y, x)
    size = F.sqrt(F.try_divide(2 * F.col("cooks") * (1 - F.col("leverage")), F.col("leverage")))
    return rows.withColumn("studentized", F.signum("residual") * size)


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal by a rational approximation of relative error below 1.2e-9; null outside of (0, 1)."""
    # Coefficients of Acklam's published approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(coefficients, t):
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * t + k
        return out

    tail = lambda q: poly(c, F.sqrt(-2 * F.ln(q))) / poly(d, F.sqrt(-2 * F.ln(q)))
    q = p - 0.5
    middle = q * poly(a, q * q) / poly(b, q * q)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)


def normal_points(df: DataFrame, value: str) -> DataFrame:
    """``(value, theoretical)``: each value against the normal quantile of the median of its rank; ties share their mean rank."""
    rows = _known(df, value).select(F.col(value).cast("double").alias("value"))
    n = rows.agg(F.count("*").cast("double").alias("n"))
    ranked = _ranked(rows, "value", "rank").crossJoin(F.broadcast(n))
    end = F.pow(F.lit(0.5), 1 / F.col("n"))
    place = F.when(F.col("rank") == F.col("n"), end).when(F.col("rank") == 1, 1 - end).otherwise((F.col("rank") - 0.3175) / (F.col("n") + 0.365))
    return ranked.select("value", normal_quantile(place).alias("theoretical"))


def smoothed(df: DataFrame, y: str, x: str, at: list[float], share: float = 0.6, rounds: int = 3) -> DataFrame:
    """``(x, y)``: local lines with tricube weights over the nearest ``share`` of rows, at the given places, then ``rounds`` robust rounds.

    For each place the rows are summed up where they lie; only a row for each
    place comes to the driver, so their number is meant to be in the hundreds.
    Between places, residuals for the robust weights are taken from straight lines.
    """
    spark = df.sparkSession
    rows = _known(df, y, x).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    places = sorted(set(map(float, at)))
    if not places:
        return spark.createDataFrame([], "x double, y double")
    # One long table of distances, so that all places share each scan of the selection.
    away = rows.select(F.explode(F.transform(F.lit(places), lambda p: F.struct(p.alias("place"), F.abs(F.col("x") - p).alias("away")))).alias("d")).select("d.*")
    reach = {r["place"]: r["q0"] for r in exact_quantiles(away, "away", [share], ["place"]).collect()}
    if not reach:
        return spark.createDataFrame([(p, None) for p in places], "x double, y double")
    far = [reach[p] for p in places]
    robust, found = F.lit(1.0), []
    for done in range(rounds + 1):
        sums = []
        for i, p in enumerate(places):
            h = max(far[i] * (1 + 1e-9), 1e-12)
            dist = F.abs(F.col("x") - p) / h
            w = F.when(dist < 1, F.pow(1 - F.pow(dist, F.lit(3)), F.lit(3))).otherwise(0.0) * robust
            u = F.col("x") - p
            sums += [F.struct(F.sum(w).alias("w"), F.sum(w * u).alias("u"), F.sum(w * u * u).alias("uu"), F.sum(w * F.col("y")).alias("y"), F.sum(w * u * F.col("y")).alias("uy")).alias(f"s{i}")]
        one = rows.agg(*sums).first()
        found = []
        for s in one:
            det = s["w"] * s["uu"] - s["u"] ** 2 if s["w"] else 0.0
            found.append((s["uu"] * s["y"] - s["u"] * s["uy"]) / det if det > 1e-12 * max(s["w"] * s["uu"], 1e-300) else (s["y"] / s["w"] if s["w"] else None))
        if done == rounds:
            break
        off = F.abs(F.col("y") - _along(F.col("x"), places, found))
        middle = exact_quantiles(rows, off, [0.5]).first()["q0"]
        if not middle:
            break
        robust = F.when(off < 6 * middle, F.pow(1 - F.pow(off / (6 * middle), F.lit(2)), F.lit(2))).otherwise(0.0)
    return spark.createDataFrame(list(zip(places, found, strict=True)), "x double, y double")


def _along(x: Column, places: list[float], values: list[float | None]) -> Column:
    """The broken line through the points, level beyond its ends."""
    known = [(p, v) for p, v in zip(places, values, strict=True) if v is not None]
    if not known:
        return F.lit(None).cast("double")
    out = F.when(x <= known[0][0], F.lit(known[0][1]))
    for (p, v), (q, w) in zip(known, known[1:]):
        out = out.when(x <= q, v + (w - v) / (q - p) * (x - p))
    return out.otherwise(F.lit(known[-1][1]))


def against_cohorts(means: DataFrame, cohorts: DataFrame, glass: bool = False) -> DataFrame:
    """``(cohort, variable, smd, se, low, high)`` of ``means(variable, mean, sd, se)`` against ``cohorts(cohort, variable, mean, sd)``.

    The standardised difference by the pooled deviation, or by the cohort's
    (``glass``); pairs without a mean or a positive deviation are left out.
    """
    m, c = means.alias("m"), F.broadcast(cohorts).alias("c") if _few(cohorts) else cohorts.alias("c")
    pairs = m.join(c, F.col("m.variable") == F.col("c.variable")).where("m.mean is not null and c.mean is not null")
    by = F.col("c.sd") if glass else F.sqrt((F.col("m.sd") * F.col("m.sd") + F.col("c.sd") * F.col("c.sd")) / 2)
    smd = (F.col("m.mean") - F.col("c.mean")) / by if glass else standardized_difference(F.col("m.mean"), F.col("m.sd"), F.col("c.mean"), F.col("c.sd"))
    rows = pairs.where(by > 0).select("c.cohort", "m.variable", smd.alias("smd"), (F.col("m.se") / by).alias("se"))
    return rows.withColumn("low", F.col("smd") - 1.96 * F.col("se")).withColumn("high", F.col("smd") + 1.96 * F.col("se"))


def share_against_cohorts(means: DataFrame, cohorts: DataFrame) -> DataFrame:
    """The same for percentages, by Cohen's h: ``means(variable, mean, se)`` and ``cohorts(cohort, variable, mean)`` in percent."""
    pairs = means.alias("m").join(cohorts.alias("c"), F.col("m.variable") == F.col("c.variable")).where("m.mean is not null and c.mean is not null")
    p = F.greatest(F.least(F.col("m.mean") / 100, F.lit(1.0)), F.lit(0.0))
    rows = pairs.select("c.cohort", "m.variable", cohens_h(F.col("m.mean") / 100, F.col("c.mean") / 100).alias("smd"), (F.col("m.se") / 100 / F.sqrt(p * (1 - p) + 1e-10)).alias("se"))
    return rows.withColumn("low", F.col("smd") - 1.96 * F.col("se")).withColumn("high", F.col("smd") + 1.96 * F.col("se"))


def _few(df: DataFrame, most: int = 10_000) -> bool:
    return df.limit(most + 1).count() <= most


def bands(smd: Column, edges: tuple[float, ...] = (0.1, 0.25, 0.5), names: tuple[str, ...] = ("none", "small", "medium", "large")) -> Column:
    """The band of an absolute effect; an edge belongs to the band above it."""
    out = F
    for edge, name in zip(edges, names):
        out = out.when(F.abs(smd) < edge, name)
    return out.when(smd.isNotNull(), names[-1])


def weighted_and_simple(df: DataFrame, values: list[str], weight: str) -> DataFrame:
    """``(field, n, weighted, simple, difference)`` of all columns in one grouped pass."""
    rows = df.select(F.col(weight).cast("double").alias("w"), *[F.col(c).cast("double").alias(c) for c in values]).unpivot(["w"], values, "field", "x")
    g = _known(rows, "x", "w").groupBy("field").agg(F.count("*").alias("n"), F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("weighted"), F.avg("x").alias("simple"))
    return g.withColumn("difference", F.abs(F.col("weighted") - F.col("simple")))


def cohort_bands(cohorts: DataFrame, z: float = 1.96) -> DataFrame:
    """``cohorts(cohort, variable, mean, sd, n)`` with ``se`` and the ends of mean -+ ``z`` errors and deviations; null where n or sd is not known, or n is 0."""
    mean, sd = F.col("mean"), F.col("sd")
    se = F.try_divide(sd, F.sqrt(F.nullif(F.col("n"), F.lit(0))))
    return cohorts.withColumn("se", se).withColumns({"se_low": mean - z * F.col("se"), "se_high": mean + z * F.col("se"), "sd_low": mean - z * sd, "sd_high": mean + z * sd})
