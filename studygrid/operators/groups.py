"""Rolling members up to groups, and pooling groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studygrid.functions.tdist import t_ppf
from studygrid.operators.quantiles import exact_quantiles


def _fine(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
    return out


def weighted_mean_per_group(df: DataFrame, value: str, weight: str, group: str) -> DataFrame:
    """``(group, value)``: sum(xw) / sum(w) over rows without nulls; groups of zero weight are left out."""
    mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
    return df.where(F.col(group).isNotNull() & _fine(value, weight)).groupBy(group).agg(mean.alias(value)).where(F.col(value).isNotNull())


def weighted_mean_across_groups(df: DataFrame, value: str, weight: str, alpha: float = 0.05, interval: bool = True) -> DataFrame:
    """One row ``(mean, se, ci_low, ci_high, n)`` with Cochran's standard error; all null but n if there are no rows."""
    rows = df.where(_fine(value, weight)).select(F.col(value).cast("double").alias("x"), F.col(weight).cast("double").alias("w"))
    mean = rows.agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    n, w = F.count("x"), F.sum("w")
    spread = F.sum(F.pow("w", F.lit(2)) * F.pow(F.col("x") - F.col("m"), F.lit(2)))
    se = F.when(n > 1, F.sqrt(F.try_divide(spread, (n - 1) / n * w * w)))
    out = rows.crossJoin(F.broadcast(mean)).agg(F.max("m").alias("mean"), se.alias("se"), n.alias("n"))
    return _with_interval(out, alpha) if interval else out


def _with_interval(out: DataFrame, alpha: float) -> DataFrame:
    reach = t_ppf(F.lit(1 - alpha / 2), (F.col("n") - 1).cast("double")) * F.col("se")
    return out.withColumn("reach", reach).select("mean", "se", (F.col("mean") - F.col("reach")).alias("ci_low"), (F.col("mean") + F.col("reach")).alias("ci_high"), "n")


def simple_mean_across_groups(df: DataFrame, value: str, alpha: float = 0.05, interval: bool = True) -> DataFrame:
    rows = df.where(_fine(value))
    out = rows.agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))
    return _with_interval(out, alpha) if interval else out


def pooled_sd(df: DataFrame, sd: str, n: str, group: str) -> DataFrame:
    """sqrt(sum (n-1) sd^2 / sum (n-1)) over members with n > 1; with fewer than two members null and no groups."""
    rows = df.where(_fine(sd, n) & (F.col(n) > 1))
    k = F.count(sd)
    sd_value = F.sqrt(F.try_divide(F.sum((F.col(n) - 1) * F.col(sd) * F.col(sd)), F.sum(F.col(n) - 1)))
    return rows.agg(F.when(k >= 2, sd_value).alias("pooled_sd"), k.alias("n_members"), F.when(k >= 2, F.count_distinct(group)).otherwise(0).alias("n_groups"))


def any_true(flag: str) -> Column:
    return F.coalesce(F.bool_or(F.col(flag)), F.lit(False))


def modal(flag: str) -> Column:
    """Majority of the known values, true on a tie, null without any."""
    return F.when(F.count(flag) > 0, F.sum(F.col(flag).cast("int")) * 2 >= F.count(flag))


def boolean_per_group(df: DataFrame, flag: str, group: str, method: str = "any_true") -> DataFrame:
    found = {"any_true": any_true, "modal": modal}
    if method not in found:
        raise ValueError(f"no method {method!r}")
    return df.groupBy(group).agg(found[method](flag).alias(flag))


#: What a field must be to count as reported; of all others it must be known.
REPORTED = {"health_literacy": 2, "digital_literacy": True}


def is_reported(field: str, values: dict = REPORTED) -> Column:
    """True where the field says something: it has its value of ``values``, or is known if there is none for it."""
    x = F.col(f"`{field}`")
    if field not in values:
        return x.isNotNull()
    return F.coalesce(x == values[field], F.lit(False))


def reporting_reach(df: DataFrame, group: str, weight: str, fields: dict[str, list[str]], weights: DataFrame) -> DataFrame:
    """``(domain, groups, members, groups_pct, members_pct)``: groups of ``weights(group, weight)`` with a member that reports any field of the domain, and their weight.

    Members of groups that ``weights`` lacks do not count. All domains come from
    one aggregation by group.
    """
    any_ = lambda cols: F.bool_or(F.greatest(*map(is_reported, cols)) if len(cols) > 1 else is_reported(cols[0]))
    per = df.groupBy(F.col(group).alias("_g")).agg(*[any_(cols).alias(f"_d{i}") for i, cols in enumerate(fields.values())])
    rows = weights.select(F.col(group), F.col(weight).alias("_w")).join(per, F.col(group) == F.col("_g"), "left")
    hit = lambda i: F.coalesce(F.col(f"_d{i}"), F.lit(False))
    one = rows.agg(F.count("*").alias("_n"), F.sum("_w").alias("_t"), *[f for i in range(len(fields)) for f in (F.count_if(hit(i)).alias(f"_n{i}"), F.coalesce(F.sum(F.when(hit(i), F.col("_w"))), F.lit(0)).alias(f"_w{i}"))])
    items = F.array(*[F.struct(F.lit(name).alias("domain"), F.col(f"_n{i}").alias("groups"), F.col(f"_w{i}").cast("double").alias("members")) for i, name in enumerate(fields)])
    out = one.select("_n", "_t", F.inline(items))
    return out.select("domain", "groups", "members", F.try_divide(100.0 * F.col("groups"), F.col("_n")).alias("groups_pct"), F.try_divide(100.0 * F.col("members"), F.col("_t").cast("double")).alias("members_pct"))


def reporting_class(df: DataFrame, field: str, group: str, unclear: DataFrame) -> DataFrame:
    """``(group, status)``: reported if any member has the field; groups listed in ``unclear`` are ambiguous whatever they have."""
    found = df.groupBy(group).agg(F.max(is_reported(field)).alias("any"))
    marked = unclear.select(F.col(group)).distinct().withColumn("unclear", F.lit(True))
    status = F.when(F.col("unclear"), "ambiguous").when(F.col("any"), "reported").otherwise("not_reported")
    return found.join(marked, group, "left").select(group, status.alias("status"))


def composite_score(df: DataFrame, group: str, categories: dict[str, list[str]]) -> DataFrame:
    """``(group, score)``: a point for each category of which any field is known in any member."""
    points = [F.coalesce(F.bool_or(F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in cols], F.lit(False))), F.lit(False)).cast("int") for cols in categories.values()]
    return df.groupBy(group).agg(sum(points[1:], points[0]).alias("score"))


def roll_up(df: DataFrame, group: str, weight: str, values: list[str], code: str, labels: dict[int, str]) -> DataFrame:
    """One row a group: members, total weight, weighted means, members without each value, and a label.

    One code gives its label; several give ``Mixed: A / B`` in order of code and
    a null code; none gives nulls.
    """
    means = [F.try_divide(F.sum(F.when(F.col(weight).isNotNull(), F.col(v) * F.col(weight))), F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))).alias(v) for v in values]
    missing = [F.count_if(F.col(v).isNull()).alias(f"{v}_n_missing") for v in values]
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    name = lambda c: F.coalesce(F.try_element_at(table, c), F.concat(F.lit("code "), c.cast("string")))
    out = df.groupBy(group).agg(F.count("*").alias("n_members"), F.sum(weight).alias("total_weight"), *means, *missing, F.array_sort(F.collect_set(F.col(code).cast("int"))).alias("codes"))
    one = F.when(F.size("codes") == 1, F.try_element_at("codes", F.lit(1)))
    label = F.when(F.size("codes") == 1, name(one)).when(F.size("codes") > 1, F.concat(F.lit("Mixed: "), F.array_join(F.transform("codes", name), " / ")))
    return out.withColumn(code, one).withColumn("label", label).drop("codes")


def crosstab(df: DataFrame, row: str, column: str, values: list[str], weight: str | None = None, percent: bool = False) -> DataFrame:
    """Counts, or sums of ``weight``, of ``row`` by the given values of ``column``; zero where there are none."""
    measure = F.sum(weight) if weight else F.count(F.lit(1))
    out = df.groupBy(row).pivot(column, values).agg(measure).na.fill(0, values)
    if percent:
        total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
        out = out.select(row, *[F.try_divide(100 * F.col(f"`{v}`"), total).alias(v) for v in values])
    return out


def dense_distribution(df: DataFrame, score: str, weight: str, top: int) -> DataFrame:
    """``(score, n, share)`` for every score from 0 to ``top``, share of the weight in percent."""
    counted = df.groupBy(F.col(score).cast("long").alias("score")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    total = counted.agg(F.sum("w").alias("total"))
    every = df.sparkSession.range(top + 1).withColumnRenamed("id", "score")
    return every.join(counted, "score", "left").crossJoin(F.broadcast(total)).select("score", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide(100 * F.col("w"), F.col("total")), F.lit(0.0)).alias("share"))


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, n_null, pct_null)`` of all columns in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    return one.select("n", F.explode(items).alias("x")).select("x.column", "x.n_null", F.try_divide(100.0 * F.col("x.n_null"), F.col("n")).alias("pct_null"))


def quartiles(df: DataFrame, value: str, group: str) -> DataFrame:
    """``(group, q1, median, q3)`` by linear interpolation; no task gathers a group."""
    return exact_quantiles(df, value, [0.25, 0.5, 0.75], [group]).select(group, *[F.col(f"q{i}").alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def top_groups(df: DataFrame, group: str, score: Column, k: int) -> DataFrame:
    """The ``k`` groups of highest summed score, ties by group."""
    return df.groupBy(group).agg(F.sum(score).alias("score")).orderBy(F.col("score").desc(), group).limit(k)


def key_audit(df: DataFrame, pairs: str, group: str) -> DataFrame:
    """Per group: values that are known, and the sorted distinct keys of their (key, value) arrays."""
    rows = df.select(group, pairs, F.explode_outer(pairs).alias("p"))
    keys = F.array_sort(F.collect_set("p.key"))
    known = df.groupBy(group).agg(F.count(pairs).alias("n_known"))
    return rows.groupBy(group).agg(F.array_join(keys, "; ").alias("keys"), F.size(keys).alias("n_keys")).join(known, group)


def key_audit_by_side(df: DataFrame, group: str, sides: dict[str, str]) -> DataFrame:
    """``(group, side, keys, n_keys, n_known)``: ``key_audit`` of several columns of (key, value) arrays, by the side each is named for."""
    return reduce(DataFrame.unionByName, [key_audit(df, column, group).withColumn("side", F.lit(side)) for side, column in sides.items()]).select(group, "side", "keys", "n_keys", "n_known")


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(position).alias("first")).orderBy("first")


def running_number(df: DataFrame, group: str, position: str, candidate: Column, base: Column) -> DataFrame:
    """Numbers candidates of a group in order, above the group's greatest ``base``; others get null."""
    w = Window.partitionBy(group)
    n = F.sum(candidate.cast("int")).over(w.orderBy(position))
    return df.withColumn("number", F.when(candidate, F.coalesce(F.max(base).over(w), F.lit(0)) + n))
