"""Report tables: shares by domain, prevalence, scores of strategies, errors, tiers, costs and histograms."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studygrid.operators.quantiles import exact_quantiles

#: Kinds of error in reviewed sheets.
ERROR_NAMES = {"none": "no_error", "rule_misapplication": "minor_error", "hallucinated_value": "major_error"}
STATUSES = ("reported", "not_reported", "ambiguous")


def domain_table(statuses: DataFrame, domain: str = "domain", status: str = "status") -> DataFrame:
    """``(domain, reported, not_reported, ambiguous, proportion)``, proportion of all rows of the domain."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in STATUSES]
    return statuses.groupBy(F.col(domain).alias("domain")).agg(*counts, F.try_divide(F.count_if(F.col(status) == "reported"), F.count("*")).alias("proportion"))


def combined_status(a: Column, b: Column) -> Column:
    """One status of two: reported if either is, else ambiguous if either is, else not reported."""
    return F.when((a == "reported") | (b == "reported"), "reported").when((a == "ambiguous") | (b == "ambiguous"), "ambiguous").otherwise("not_reported")


def prevalence(df: DataFrame, flags: list[str]) -> DataFrame:
    """``(flag, n_yes, n_no, proportion)`` of boolean columns, nulls left out, in one pass."""
    one = df.agg(*[f for i, c in enumerate(flags) for f in (F.count_if(F.col(c)).alias(f"y{i}"), F.count_if(~F.col(c)).alias(f"n{i}"))])
    items = F.array(*[F.struct(F.lit(c).alias("flag"), F.col(f"y{i}").alias("n_yes"), F.col(f"n{i}").alias("n_no")) for i, c in enumerate(flags)])
    return one.select(F.inline(items)).withColumn("proportion", F.try_divide(F.col("n_yes"), F.col("n_yes") + F.col("n_no")))


def inclusiveness(excludes: Column, equipment: Column, training: Column, support: Column) -> Column:
    """0 to 5: two points for not excluding, one each for equipment, and for training and support where someone has access."""
    path = ~excludes | equipment
    return 2 * (~excludes).cast("int") + equipment.cast("int") + (training & path).cast("int") + (support & path).cast("int")


def combinations(df: DataFrame, flags: list[str]) -> DataFrame:
    """``(flags, n)`` of all combinations of boolean columns, those without rows too.

    The grid of 2^k literal rows is the outer side; counts are aggregated before
    they meet it.
    """
    counted = df.groupBy(*[F.col(c).cast("int").alias(c) for c in flags]).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame(list(itertools.product((0, 1), repeat=len(flags))), ", ".join(f"{c} int" for c in flags))
    return grid.join(counted, flags, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def error_summary(df: DataFrame, columns: list[str], names: dict[str, str] = ERROR_NAMES) -> DataFrame:
    """``(error_type, count, pct, rows_with_type, n_rows)`` of wide error columns, and a row ``any_error``.

    ``rows_with_type`` of no_error counts rows without an error. Each row adds up its own
    columns first, so nothing is unpivoted before the one aggregation.
    """
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    cells = F.transform(F.filter(F.array(*map(F.col, columns)), lambda x: x.isNotNull()), lambda x: F.coalesce(F.try_element_at(table, x), x))
    fine = ~F.exists("cells", lambda x: x.isin(*[v for k, v in names.items() if k != "none"]))
    rows = df.select(cells.alias("cells")).withColumn("fine", fine)
    total = rows.agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"), F.count_if(~F.col("fine")).alias("bad"))
    each = rows.select("cells", F.explode(F.array_distinct("cells")).alias("error_type"))
    within = F.size(F.filter("cells", lambda x: x == F.col("error_type")))
    by_type = each.groupBy("error_type").agg(F.sum(within).alias("count"), F.count("*").alias("has"))
    with_type = F.when(F.col("error_type") == names.get("none", "none"), F.col("n_rows") - F.col("bad")).otherwise(F.col("has"))
    typed = by_type.crossJoin(F.broadcast(total)).select("error_type", "count", F.try_divide(100.0 * F.col("count"), F.col("n_cells")).alias("pct"), with_type.alias("rows_with_type"), "n_rows")
    any_ = total.select(F.lit("any_error").alias("error_type"), F.col("bad").alias("count"), F.try_divide(100.0 * F.col("bad"), F.col("n_rows")).alias("pct"), F.col("bad").alias("rows_with_type"), "n_rows")
    return typed.unionByName(any_)


def error_fields(df: DataFrame, columns: list[str], names: dict[str, str] = ERROR_NAMES) -> DataFrame:
    """``(field, none, minor, major, any_error, reported)`` of each error column, in one pass."""
    none, minor, major = list(names)
    aggs = [F.count_if(F.col(c) == kind).alias(f"{tag}{i}") for i, c in enumerate(columns) for tag, kind in (("a", none), ("b", minor), ("c", major))]
    one = df.agg(*aggs, *[F.count(c).alias(f"r{i}") for i, c in enumerate(columns)])
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a{i}").alias("none"), F.col(f"b{i}").alias("minor"), F.col(f"c{i}").alias("major"), (F.col(f"b{i}") + F.col(f"c{i}")).alias("any_error"), F.col(f"r{i}").alias("reported")) for i, c in enumerate(columns)])
    return one.select(F.inline(items))


def bucket_summary(report: DataFrame, bucket: str = "bucket", value: str = "value", flagged: str = "flagged") -> DataFrame:
    """``(bucket, fields, flagged, median)`` of an agreement report."""
    counts = report.groupBy(F.col(bucket).alias("_b")).agg(F.count("*").alias("fields"), F.count_if(flagged).alias("flagged"))
    medians = exact_quantiles(report, value, [0.5], [bucket]).select(bucket, F.col("q0").alias("median"))
    return medians.join(counts, F.col(bucket).eqNullSafe(F.col("_b"))).select(bucket, "fields", "flagged", "median")


def tiers(reports: dict[str, DataFrame], flagged: str = "flagged") -> DataFrame:
    """``(tier, fields, flagged, pct)``: one row for each report."""
    rows = [df.agg(F.count("*").alias("fields"), F.count_if(flagged).alias("flagged")).select(F.lit(name).alias("tier"), "fields", "flagged", F.try_divide(100.0 * F.col("flagged"), F.col("fields")).alias("pct")) for name, df in reports.items()]
    return reduce(DataFrame.unionByName, rows)


def costs(calls: DataFrame, prices: DataFrame, by: list[str], key: str = "model") -> DataFrame:
    """``(by, calls, tokens_in, tokens_out, cost)``: tokens at ``prices(key, price_in, price_out)`` a million; unknown models cost nothing.

    Tokens are added up by model before the prices are joined.
    """
    sums = calls.groupBy(*dict.fromkeys([*by, key])).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    price = F.coalesce((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6, F.lit(0.0))
    priced = sums.join(prices, key, "left").withColumn("cost", price)
    return priced.groupBy(*by).agg(F.sum("calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))


def run_totals(calls: DataFrame, prices: DataFrame, key: str = "model") -> DataFrame:
    """One row ``(calls, done, skipped, errors, elapsed_s, tokens_in, tokens_out, cost)`` of ``calls(key, skipped, ok, elapsed_s, tokens_in, tokens_out, cache_read, cache_write)``.

    Skipped calls count as skipped alone. Errors are those that are not skipped
    and not ok, null included; they cost what they took. Prices are for a million
    tokens of each kind, null is none; a model without prices costs nothing, and
    one that repeats in ``prices`` is an error.
    """
    kinds = ("tokens_in", "tokens_out", "cache_read", "cache_write")
    skipped = F.coalesce(F.col("skipped"), F.lit(False))
    made = lambda c: F.coalesce(F.sum(F.when(~skipped, F.col(c))), F.lit(0)).alias(c)
    sums = calls.groupBy(key).agg(F.count("*").alias("calls"), F.count_if(~skipped).alias("done"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & ~F.coalesce(F.col("ok"), F.lit(False))).alias("errors"), made("elapsed_s"), *map(made, kinds))
    known = prices.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), *[F.max(f"price_{c.removeprefix('tokens_')}").alias(f"_{c}") for c in kinds])
    cost = sum((F.col(c) * F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in kinds[1:]), F.col(kinds[0]) * F.coalesce(F.col(f"_{kinds[0]}"), F.lit(0))) / 1e6
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("prices repeat for "), "_k"))).otherwise(cost)
    priced = sums.join(known, F.col(key) == F.col("_k"), "left").withColumn("cost", one)
    return priced.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "done", "skipped", "errors", "elapsed_s", "tokens_in", "tokens_out", "cost")])


def run_health(papers: DataFrame, outputs: DataFrame, findings: DataFrame, least: int = 5) -> DataFrame:
    """One row ``(papers, single_arm, invalid, unprocessed, catastrophic)``; outputs ``(paper_id, n_arms)``, null arms being not readable."""
    done = outputs.agg(F.count_if(F.col("n_arms") == 1).alias("single_arm"), F.count_if(F.col("n_arms").isNull()).alias("invalid"))
    todo = papers.select("paper_id").distinct()
    left = todo.join(outputs.select("paper_id"), "paper_id", "left_anti").agg(F.count("*").alias("unprocessed"))
    worst = findings.where("severity = 'ERROR'").groupBy("paper_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).agg(F.count("*").alias("catastrophic"))
    # Each side is one aggregated row.
    return todo.agg(F.count("*").alias("papers")).crossJoin(done).crossJoin(left).crossJoin(worst)


def version_drift(outputs: DataFrame, current: str, version: str = "prompt_version") -> DataFrame:
    """Outputs made by another version than the current one; unknown and null versions are left out."""
    return outputs.where((F.col(version) != current) & (F.col(version) != "unknown"))


def self_weighted(df: DataFrame, n: str) -> DataFrame:
    """One row: the mean of ``n`` weighted by itself."""
    x = F.col(n).cast("double")
    return df.agg(F.try_divide(F.sum(x * x), F.sum(x)).alias("mean"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``(bin, low, high, n)`` of equal bins, all of them; the last one is closed and values outside are left out."""
    width = (high - low) / bins
    x = F.col(value).cast("double")
    nth = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("long")
    counted = df.where((x >= low) & (x <= high)).groupBy(nth.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counted, "bin", "left").select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """``(size, groups)``."""
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def characteristics(df: DataFrame, numbers: list[str], categories: list[str], top: int = 3) -> DataFrame:
    """``(characteristic, value)`` texts: count, ranges and medians of numbers, the most frequent values of categories (ties by name)."""
    out = [df.agg(F.count("*").alias("n")).select(F.lit("n").alias("characteristic"), F.col("n").cast("string").alias("value"))]
    if numbers:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "characteristic", "_x")
        three = exact_quantiles(long, "_x", [0.5, 0.0, 1.0], ["characteristic"])
        out.append(three.select("characteristic", F.format_string("%.2f (%.2f to %.2f)", "q0", "q1", "q2").alias("value")))
    for c in categories:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("k")).orderBy(F.col("k").desc(), "v").limit(top)
        listed = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "v")))
        text = F.array_join(F.transform(listed, lambda x: F.concat(x["v"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(")"))), ", ")
        out.append(counts.agg(text.alias("value")).select(F.lit(c).alias("characteristic"), "value"))
    return reduce(DataFrame.unionByName, out)


def json_report(findings: DataFrame, papers: DataFrame, run: dict[str, str]) -> DataFrame:
    """One row ``report``: a JSON text of run data, counts by severity, and papers with errors, with warnings only, and clean.

    It is one row by contract and lists ids, so it suits the papers of one run.
    """
    worst = findings.groupBy("paper_id").agg(F.min(F.when(F.col("severity") == "ERROR", 1).when(F.col("severity") == "WARNING", 2).otherwise(3)).alias("rank"))
    state = papers.select(F.col("paper_id").cast("string").alias("paper_id")).distinct().join(worst, "paper_id", "left")
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("paper_id"))))
    lists = state.agg(ids(F.col("rank") == 1).alias("papers_with_errors"), ids(F.col("rank") == 2).alias("papers_with_warnings"), ids(F.coalesce("rank", F.lit(3)) == 3).alias("clean_papers"))
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("ERROR", "WARNING", "INFO")])
    body = F.struct(*[F.lit(v).alias(k) for k, v in run.items()], F.struct("ERROR", "WARNING", "INFO").alias("counts"), "papers_with_errors", "papers_with_warnings", "clean_papers")
    return counts.crossJoin(lists).select(F.to_json(body).alias("report"))


def baseline_comparison(pooled: DataFrame, cohorts: DataFrame, names: list[str]) -> DataFrame:
    """``(variable, estimate, ci, se, n, <cohort>_mean_sd, <cohort>_n ...)`` as texts: ``pooled(variable, mean, se, ci_low, ci_high, n)`` beside ``cohorts(cohort, variable, mean, sd, n)``.

    A dash stands where a cohort lacks the variable, or there is no standard
    error; a deviation that is not known is left out. One row a cohort and variable.
    """
    shown = lambda pattern, *c: F.format_string(pattern, *[F.col(x).cast("double") for x in c])
    cell = F.concat(shown("%.1f", "mean"), F.when(F.col("sd").isNotNull(), shown(" (%.1f)", "sd")).otherwise(""))
    spread = cohorts.select("cohort", F.col("variable").alias("_v"), cell.alias("cell"), F.col("n").cast("string").alias("k")).groupBy("_v").pivot("cohort", names).agg(F.max("cell").alias("mean_sd"), F.max("k").alias("n"))
    joined = pooled.join(spread, F.col("variable").eqNullSafe(F.col("_v")), "left")
    dash = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("—")).alias(c)
    return joined.select("variable", shown("%.1f", "mean").alias("estimate"), F.when(F.col("se").isNull(), "—").otherwise(shown("[%.1f, %.1f]", "ci_low", "ci_high")).alias("ci"), F.when(F.col("se").isNull(), "—").otherwise(shown("%.2f", "se")).alias("se"), F.col("n"), *(dash(f"{c}_{x}") for c in names for x in ("mean_sd", "n")))


def summary_row(groups: DataFrame, members: DataFrame, span: str, total: str, distinct: str, setting: str, settings: list[str], pooled: dict[str, DataFrame]) -> DataFrame:
    """One row: counts of groups and members, the range of ``span``, the sum of ``total``, distinct values, the percent of all groups in each of ``settings``, and mean and interval of each of ``pooled``."""
    percent = [F.coalesce(F.try_divide(100.0 * F.count_if(F.col(setting) == s), F.count("*")), F.lit(0.0)).alias(f"pct_{s}") for s in settings]
    whole = lambda f: F.format_string("%.0f", f(span).cast("double"))
    one = groups.agg(F.count("*").alias("n_groups"), F.concat_ws("-", whole(F.min), whole(F.max)).alias("range"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("total"), F.count_distinct(distinct).alias("n_distinct"), *percent)
    out = one.crossJoin(F.broadcast(members.agg(F.count("*").alias("n_members"))))
    for name, row in pooled.items():
        out = out.crossJoin(F.broadcast(row.select(F.col("mean").alias(f"{name}_pooled"), F.col("ci_low").alias(f"{name}_ci_lo"), F.col("ci_high").alias(f"{name}_ci_hi"))))
    return out.select("n_groups", "n_members", "range", "total", "n_distinct", *(f"`pct_{s}`" for s in settings), *(f"{n}_{x}" for n in pooled for x in ("pooled", "ci_lo", "ci_hi")))
