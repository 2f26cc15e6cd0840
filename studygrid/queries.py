"""Registered queries of the analytics operators over the driver's tables, and their SQL.

Order lines stand for members, orders for groups, quantity for the weight.
Doubles are rounded on both sides, as sums are added up in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studygrid.functions import texts
from studygrid.functions import values as v
from studygrid.operators import agreement, compare, groups, ledger, regression, rules
from studygrid.plans import reports

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


@query("SELECT l_orderkey, round(sum(sqrt(l_extendedprice) * l_quantity) / sum(l_quantity), 6) AS root_price FROM lineitem GROUP BY l_orderkey")
def weighted_mean_per_group(spark, d):
    rows = table(spark, d, "lineitem").withColumn("root_price", F.sqrt("l_extendedprice"))
    return rounded(groups.weighted_mean_per_group(rows, "root_price", "l_quantity", "l_orderkey"), "root_price")


def _trials(spark, d):
    per = groups.weighted_mean_per_group(table(spark, d, "lineitem"), "l_discount", "l_quantity", "l_orderkey")
    size = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total_n"))
    return per.join(size, "l_orderkey")


TRIALS = "t AS (SELECT l_orderkey, sum(l_discount * l_quantity) / sum(l_quantity) AS x, sum(l_quantity) AS w FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {TRIALS}, m AS (SELECT sum(x * w) / sum(w) AS m, count(*) AS n, sum(w) AS sw FROM t) SELECT round(max(m), 8) AS mean, round(sqrt(sum(w * w * (x - m) * (x - m)) / ((max(n) - 1) / CAST(max(n) AS DOUBLE) * max(sw) * max(sw))), 8) AS se, max(n) AS n FROM t, m")
def weighted_mean_across_groups(spark, d):
    return rounded(groups.weighted_mean_across_groups(_trials(spark, d), "l_discount", "total_n", interval=False), "mean", "se", digits=8)


@query(f"WITH {TRIALS} SELECT round(avg(x), 8) AS mean, round(stddev_samp(x) / sqrt(count(x)), 8) AS se, count(x) AS n FROM t")
def simple_mean_across_groups(spark, d):
    return rounded(groups.simple_mean_across_groups(_trials(spark, d), "l_discount", interval=False), "mean", "se", digits=8)


@query("SELECT round(sqrt(sum((l_quantity - 1) * l_tax * l_tax) / sum(l_quantity - 1)), 8) AS pooled_sd, count(*) AS n_members, count(DISTINCT l_orderkey) AS n_groups FROM lineitem WHERE l_quantity > 1")
def pooled_sd(spark, d):
    return rounded(groups.pooled_sd(table(spark, d, "lineitem"), "l_tax", "l_quantity", "l_orderkey"), "pooled_sd", digits=8)


def flag():
    return F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag") == "R")


FLAG_SQL = "CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag = 'R' END"


@query(f"SELECT l_orderkey, coalesce(bool_or({FLAG_SQL}), false) AS flag FROM lineitem GROUP BY l_orderkey")
def boolean_any_true(spark, d):
    return groups.boolean_per_group(table(spark, d, "lineitem").withColumn("flag", flag()), "flag", "l_orderkey")


@query(f"SELECT l_orderkey, CASE WHEN count(f) > 0 THEN sum(CAST(f AS INT)) * 2 >= count(f) END AS flag FROM (SELECT l_orderkey, {FLAG_SQL} AS f FROM lineitem) GROUP BY l_orderkey")
def boolean_modal(spark, d):
    return groups.boolean_per_group(table(spark, d, "lineitem").withColumn("flag", flag()), "flag", "l_orderkey", "modal")


@query(f"SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN 'ambiguous' WHEN bool_or(f) THEN 'reported' ELSE 'not_reported' END AS status FROM (SELECT l_orderkey, {FLAG_SQL} IS NOT NULL AND l_tax > 0.04 AS f FROM lineitem) GROUP BY l_orderkey")
def reporting_class(spark, d):
    rows = table(spark, d, "lineitem").withColumn("field", F.when(flag().isNotNull() & (F.col("l_tax") > 0.04), 1))
    return groups.reporting_class(rows, "field", "l_orderkey", rows.where("l_orderkey % 10 = 0").select("l_orderkey"))


@query("SELECT l_orderkey, CAST(max(CAST(l_tax > 0.06 AS INT)) + max(CAST(l_discount > 0.08 AS INT)) + max(CAST(l_quantity > 45 OR l_returnflag = 'A' AS INT)) AS INT) AS score FROM lineitem GROUP BY l_orderkey")
def composite_score(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", *[F.when(c, 1).alias(n) for n, c in (("a", F.col("l_tax") > 0.06), ("b", F.col("l_discount") > 0.08), ("c", F.col("l_quantity") > 45), ("e", F.col("l_returnflag") == "A"))])
    return groups.composite_score(rows, "l_orderkey", {"one": ["a"], "two": ["b"], "three": ["c", "e"]})


@query("""WITH r AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN sqrt(l_tax + 1) END AS tax, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 END AS code FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n_members, sum(l_quantity) AS total_weight, round(sum(tax * l_quantity) / sum(CASE WHEN tax IS NOT NULL THEN l_quantity END), 6) AS tax, count(*) FILTER (WHERE tax IS NULL) AS tax_n_missing, list_sort(list_distinct(list(code))) AS codes FROM r GROUP BY l_orderkey)
SELECT l_orderkey, n_members, total_weight, tax, tax_n_missing, CASE WHEN len(codes) = 1 THEN codes[1] END AS code,
CASE WHEN len(codes) = 1 THEN list_transform(codes, lambda c: CASE c WHEN 1 THEN 'Primary' WHEN 2 THEN 'Secondary' ELSE 'code ' || c END)[1] ELSE 'Mixed: ' || array_to_string(list_transform(codes, lambda c: CASE c WHEN 1 THEN 'Primary' WHEN 2 THEN 'Secondary' ELSE 'code ' || c END), ' / ') END AS label FROM g""")
def group_roll_up(spark, d):
    rows = table(spark, d, "lineitem").withColumn("tax", F.when(F.col("l_linenumber") != 3, F.sqrt(F.col("l_tax") + 1))).withColumn("code", F.expr("CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 END"))
    return rounded(groups.roll_up(rows, "l_orderkey", "l_quantity", ["tax"], "code", {1: "Primary", 2: "Secondary", 3: "Community"}), "tax")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def crosstab_counts(spark, d):
    return groups.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_orderpriority, round(100 * coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) / sum(o_totalprice), 6) AS \"F\", round(100 * coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) / sum(o_totalprice), 6) AS \"O\", round(100 * coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0) / sum(o_totalprice), 6) AS \"P\" FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1")
def crosstab_weighted_percent(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O", "P"))
    return rounded(groups.crosstab(rows, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "o_totalprice", percent=True), "F", "O", "P")


@query("WITH c AS (SELECT l_linenumber AS s, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1) SELECT r AS score, coalesce(n, 0) AS n, coalesce(round(100 * w / (SELECT sum(w) FROM c), 6), 0.0) AS share FROM range(10) t(r) LEFT JOIN c ON r = s")
def dense_distribution(spark, d):
    return rounded(groups.dense_distribution(table(spark, d, "lineitem"), "l_linenumber", "l_quantity", 9), "share")


@query("SELECT 'c_custkey' AS \"column\", count(*) FILTER (WHERE x % 7 = 0) AS n_null, round(100.0 * count(*) FILTER (WHERE x % 7 = 0) / count(*), 6) AS pct_null FROM (SELECT c_custkey AS x FROM customer) UNION ALL SELECT 'c_name', 0, 0.0")
def null_profile(spark, d):
    rows = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("c_custkey"), "c_name")
    return rounded(groups.null_profile(rows), "pct_null")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1")
def quartiles(spark, d):
    return rounded(groups.quartiles(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), "q1", "median", "q3", digits=4)


@query("SELECT l_suppkey, sum(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END) AS score FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_weighted_groups(spark, d):
    return groups.top_groups(table(spark, d, "lineitem"), "l_suppkey", F.expr("CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END"), 5)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 100 + sum(CAST(l_quantity > 25 AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) END AS number FROM lineitem")
def running_number(spark, d):
    return groups.running_number(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") > 25, F.lit(100)).select("l_orderkey", "l_linenumber", "number")


PAIRS_SQL = "p AS (SELECT l_shipmode AS field, a, b FROM (SELECT 'm' || (l_linenumber % 3) AS l_shipmode, CASE WHEN l_quantity > 20 THEN l_returnflag ELSE 'N' END AS a, CASE WHEN l_tax > 0.01 THEN l_returnflag ELSE 'A' END AS b FROM lineitem))"


def _rated(spark, d):
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("m"), (F.col("l_linenumber") % 3).cast("string")).alias("field"),
        F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).otherwise("N").alias("a"),
        F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).otherwise("A").alias("b"),
    )


@query(f"""WITH {PAIRS_SQL}, n AS (SELECT field, count(*) AS n, avg(CAST(a = b AS INT)) AS po FROM p GROUP BY 1),
c AS (SELECT field, cat, sum(x) AS na, sum(y) AS nb FROM (SELECT field, a AS cat, 1 AS x, 0 AS y FROM p UNION ALL SELECT field, b, 0, 1 FROM p) GROUP BY 1, 2),
e AS (SELECT c.field, sum((na + nb) / (2.0 * n) * (1 - (na + nb) / (2.0 * n))) / (count(*) - 1) AS pe, sum(CAST(na AS DOUBLE) * nb) / (max(n) * max(n)) AS pk FROM c JOIN n ON c.field = n.field GROUP BY 1)
SELECT n.field, n, round(po, 6) AS percent_agreement, round((po - pe) / (1 - pe), 6) AS ac1, round((po - pk) / (1 - pk), 6) AS kappa FROM n JOIN e ON n.field = e.field""")
def agreement_categorical(spark, d):
    return rounded(agreement.categorical(_rated(spark, d)), "percent_agreement", "ac1", "kappa")


@query("""WITH p AS (SELECT 'f' || (l_linenumber % 2) AS field, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS a, CASE WHEN l_orderkey % 4 <> 0 THEN l_quantity + 10 * l_tax END AS b FROM lineitem),
f AS (SELECT field, a, b, (a + b) / 2 AS s FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
g AS (SELECT field, count(*) AS n, avg(s) AS g, avg(a) AS ma, avg(b) AS mb FROM f GROUP BY 1),
q AS (SELECT f.field, max(n) AS n, 2 * sum((s - g) * (s - g)) AS subj, max(n) * (max((ma - g) * (ma - g)) + max((mb - g) * (mb - g))) AS rater, sum((a - g) * (a - g) + (b - g) * (b - g)) AS total FROM f JOIN g ON f.field = g.field GROUP BY 1),
m AS (SELECT field, n, subj / (n - 1) AS bms, rater AS jms, (total - subj - rater) / (n - 1) AS ems FROM q),
c AS (SELECT field, count(*) FILTER (WHERE a IS NULL AND b IS NULL) * 1.0 / count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS nc FROM p GROUP BY 1),
s AS (SELECT field, avg(a - b) AS md, stddev_samp(a - b) AS sd FROM f GROUP BY 1)
SELECT m.field, n, round((bms - ems) / (bms + ems + 2 * (jms - ems) / n), 6) AS icc, round(nc, 6) AS na_concordance, round(md, 6) AS mean_diff, round(sd, 6) AS sd_diff, round(md - 1.96 * sd, 6) AS lower, round(md + 1.96 * sd, 6) AS upper
FROM m JOIN c ON m.field = c.field JOIN s ON m.field = s.field""")
def agreement_numerical(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_linenumber") % 2).cast("string")).alias("field"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("a"),
        F.when(F.col("l_orderkey") % 4 != 0, F.col("l_quantity") + 10 * F.col("l_tax")).alias("b"),
    )
    return rounded(agreement.numerical(rows), "icc", "na_concordance", "mean_diff", "sd_diff", "lower", "upper")


@query("""WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type || ' ' || p_name, ' ')) AS b FROM part)
SELECT p_partkey, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS f1, round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM w""")
def token_f1(spark, d):
    rows = table(spark, d, "part").withColumn("both", F.concat_ws(" ", "p_type", "p_name"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    return rounded(rows.select("p_partkey", agreement.token_f1(F.col("p_name"), F.col("both")).alias("f1"), agreement.jaccard(words("p_name"), words("both")).alias("jaccard")), "f1", "jaccard")


@query("SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 6) AS se FROM lineitem")
def ols_one(spark, d):
    return rounded(rounded(regression.fit_one(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").drop("t"), "slope", "se"), "intercept", digits=4)


@query("""WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_tax) AS mb, var_pop(l_quantity) AS aa, var_pop(l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_tax, l_extendedprice) AS yb FROM lineitem),
c AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS a1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b1 FROM s)
SELECT n, round(my - a1 * ma - b1 * mb, 3) AS intercept, round(a1, 5) AS slope_a, round(b1, 3) AS slope_b FROM c""")
def ols_two(spark, d):
    return rounded(rounded(regression.fit_two(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_tax"), "slope_a", digits=5), "intercept", "slope_b", digits=3)


@query("""WITH s AS (SELECT count(*) AS n, avg(o_orderkey) AS mx, regr_slope(o_totalprice, o_orderkey) AS b, regr_intercept(o_totalprice, o_orderkey) AS a, regr_sxx(o_totalprice, o_orderkey) AS sxx, regr_syy(o_totalprice, o_orderkey) - regr_slope(o_totalprice, o_orderkey) * regr_sxy(o_totalprice, o_orderkey) AS sse FROM orders),
h AS (SELECT o_orderkey, n, sse, o_totalprice - a - b * o_orderkey AS r, 1.0 / n + (o_orderkey - mx) * (o_orderkey - mx) / sxx AS h FROM orders, s)
SELECT o_orderkey, round(r * r * h / (2 * sse / (n - 2) * (1 - h) * (1 - h)), 9) AS cooks, r * r * h / (2 * sse / (n - 2) * (1 - h) * (1 - h)) > 4.0 / n AS influential FROM h""")
def cooks_distance(spark, d):
    return rounded(regression.cooks_distance(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "cooks", "influential"), "cooks", digits=9)


@query("SELECT round(1 / (1 - sum(l_quantity * l_tax) * sum(l_quantity * l_tax) / (sum(l_quantity * l_quantity) * sum(l_tax * l_tax))), 6) AS vif FROM lineitem")
def vif_pair(spark, d):
    return rounded(regression.vif_pair(table(spark, d, "lineitem"), "l_quantity", "l_tax"), "vif")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, d):
    return rounded(regression.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount").select("n", "rho"), "rho")


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson(spark, d):
    return rounded(regression.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("n", "r"), "r")


@query("""WITH c AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k FROM orders GROUP BY 1), p AS (SELECT *, k * 1.0 / n AS p, 1.959963984540054 AS z FROM c)
SELECT o_orderpriority, round(p, 6) AS share, round((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 6) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 6) AS high FROM p""")
def wilson_interval(spark, d):
    c = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return rounded(c.select("o_orderpriority", regression.wilson(F.col("k"), F.col("n")).alias("w")).select("o_orderpriority", "w.*"), "share", "low", "high")


RECORDS_SQL = "r AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"


def _runs(spark, d):
    rows = table(spark, d, "lineitem")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.max("l_quantity").alias("l_quantity"))
    keys, fields = ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"]
    a = compare.long_form(rows.where("l_orderkey % 11 <> 0 and not (l_orderkey % 7 = 0 and l_linenumber = 2)"), keys, fields)
    b = compare.long_form(rows.where("l_orderkey % 13 <> 0").withColumn("l_returnflag", F.expr("CASE WHEN l_quantity > 30 THEN 'X' ELSE l_returnflag END")), keys, fields)
    return a, b


@query(f"""WITH {RECORDS_SQL},
a AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM r WHERE l_orderkey % 11 <> 0 AND NOT (l_orderkey % 7 = 0 AND l_linenumber = 2)),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus FROM r WHERE l_orderkey % 13 <> 0),
pa AS (SELECT DISTINCT l_orderkey FROM a), pb AS (SELECT DISTINCT l_orderkey FROM b)
SELECT coalesce(pa.l_orderkey, pb.l_orderkey) AS l_orderkey, NULL AS l_linenumber, '_status' AS field, CASE WHEN pa.l_orderkey IS NULL THEN 'missing' ELSE 'present' END AS value_a, CASE WHEN pb.l_orderkey IS NULL THEN 'missing' ELSE 'present' END AS value_b FROM pa FULL JOIN pb ON pa.l_orderkey = pb.l_orderkey WHERE pa.l_orderkey IS NULL OR pb.l_orderkey IS NULL
UNION ALL SELECT coalesce(a.l_orderkey, b.l_orderkey), CAST(coalesce(a.l_linenumber, b.l_linenumber) AS VARCHAR), '_status', CASE WHEN a.l_orderkey IS NULL THEN 'missing' ELSE 'present' END, CASE WHEN b.l_orderkey IS NULL THEN 'missing' ELSE 'present' END
  FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE (a.l_orderkey IS NULL OR b.l_orderkey IS NULL) AND coalesce(a.l_orderkey, b.l_orderkey) IN (SELECT l_orderkey FROM pa INTERSECT SELECT l_orderkey FROM pb)
UNION ALL SELECT a.l_orderkey, CAST(a.l_linenumber AS VARCHAR), 'l_returnflag', a.l_returnflag, b.l_returnflag FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag IS DISTINCT FROM b.l_returnflag
UNION ALL SELECT a.l_orderkey, CAST(a.l_linenumber AS VARCHAR), 'l_linestatus', a.l_linestatus, b.l_linestatus FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_linestatus IS DISTINCT FROM b.l_linestatus""")
def diff_runs(spark, d):
    return compare.diff_runs(*_runs(spark, d), "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value_a, CASE WHEN o_totalprice > 100000 THEN 'P' ELSE o_orderstatus END AS value_b FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'")
def diff_common(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_totalprice > 100000 THEN 'P' ELSE o_orderstatus END").alias("o_orderstatus"), "o_orderpriority")
    return compare.diff_common(a, b, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


RULES = [rules.Rule("l_quantity", "range", low=5, high=45), rules.Rule("l_returnflag", "enum", allowed=("A", "N")), rules.Rule("l_tax", "order", other="l_discount"), rules.Rule("l_extendedprice", "integer")]
FINDINGS_SQL = """f AS (SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_linenumber AS VARCHAR) AS arm, 'ERROR' AS severity, 'range_violation' AS category FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), 'ERROR', 'type_enum' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), 'WARNING', 'range_order' FROM lineitem WHERE l_tax > l_discount
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), 'WARNING', 'type_integer' FROM lineitem WHERE l_extendedprice <> floor(l_extendedprice))"""


def _findings(spark, d):
    return rules.validate(table(spark, d, "lineitem"), RULES, "l_orderkey", "l_linenumber")


@query(f"WITH {FINDINGS_SQL} SELECT * FROM f")
def findings(spark, d):
    return _findings(spark, d).select("paper_id", "arm", "severity", "category")


@query(f"WITH {FINDINGS_SQL} SELECT severity, category, count(*) AS n, count(DISTINCT paper_id) AS papers FROM f GROUP BY 1, 2")
def finding_summary(spark, d):
    return rules.summary(_findings(spark, d))


@query(f"WITH {FINDINGS_SQL} SELECT paper_id, sum(CASE severity WHEN 'ERROR' THEN 3 WHEN 'WARNING' THEN 1 ELSE 0 END) AS score FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def worst_papers(spark, d):
    return rules.worst_papers(_findings(spark, d))


@query(f"WITH {FINDINGS_SQL} SELECT paper_id, count(*) AS errors FROM f WHERE severity = 'ERROR' GROUP BY 1 HAVING count(*) >= 5")
def crowded_papers(spark, d):
    return rules.crowded(_findings(spark, d))


@query(f"WITH {FINDINGS_SQL} SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper_id FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT paper_id FROM f)")
def clean_papers(spark, d):
    return rules.clean_papers(table(spark, d, "lineitem"), _findings(spark, d), "l_orderkey")


def _ledger(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.lit("c").alias("category"), F.col("o_orderpriority").alias("message"), F.lit("ERROR").alias("severity"), "o_orderkey", "o_orderstatus")
    old = o.where("o_orderkey % 3 <> 0").withColumn("status", F.expr("CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'open' END"))
    return old, o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 5 <> 0")


LEDGER_SQL = """l AS (SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, 'c' AS category, o_orderpriority AS message, 'ERROR' AS severity,
CASE WHEN o_orderkey % 3 <> 0 AND o_orderstatus = 'F' THEN 'accepted' ELSE 'open' END AS status FROM orders
WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 0) AND NOT (o_orderkey % 3 <> 0 AND o_orderstatus <> 'F' AND o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0))"""


@query(f"WITH {LEDGER_SQL} SELECT * FROM l")
def ledger_sync(spark, d):
    return ledger.sync(*_ledger(spark, d))


@query(f"WITH {LEDGER_SQL} SELECT severity, count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'accepted') AS accepted, 0 AS rejected, 0 AS fixed, count(DISTINCT CASE WHEN status = 'open' THEN paper_id END) AS blocking_papers FROM l GROUP BY 1")
def ledger_stats(spark, d):
    return ledger.stats(ledger.sync(*_ledger(spark, d)))


@query(f"WITH {LEDGER_SQL} SELECT paper_id, category, message, severity, CASE WHEN status = 'open' AND CAST(paper_id AS BIGINT) % 2 = 0 THEN 'fixed' ELSE status END AS status FROM l")
def ledger_resolve(spark, d):
    now = ledger.sync(*_ledger(spark, d))
    decided = now.select(*ledger.KEY, F.when(F.col("paper_id").cast("long") % 2 == 0, "fixed").otherwise("unclear").alias("decision"))
    return ledger.resolve(now, decided)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 1000 AND o_totalprice <= 50000 THEN 'low' WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN 'middle' WHEN o_totalprice > 150000 AND o_totalprice <= 300000 THEN 'high' END AS bucket FROM orders")
def right_closed_buckets(spark, d):
    return table(spark, d, "orders").select("o_orderkey", v.bucket(F.col("o_totalprice"), [1000, 50000, 150000, 300000], ["low", "middle", "high"]).alias("bucket"))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(lower(o_orderpriority), 'urgent|high') THEN 'first' WHEN regexp_matches(lower(o_orderpriority), 'low') THEN 'last' ELSE 'open' END AS decision FROM orders")
def first_match_rules(spark, d):
    return table(spark, d, "orders").select("o_orderkey", v.first_match(F.col("o_orderpriority"), [("urgent|high", "first"), ("low", "last")], "open").alias("decision"))


@query("""SELECT o_orderkey, trim(regexp_replace('  ' || o_orderpriority || '   x. ', '\\s+', ' ', 'g')) AS basic, regexp_replace(lower(trim(regexp_replace('  ' || o_orderpriority || '   x. ', '\\s+', ' ', 'g'))), '[.,;:!?\\s]+$', '') AS free,
o_orderstatus = 'F' AS flag FROM orders""")
def normalised_text(spark, d):
    messy = F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("   x. "))
    return table(spark, d, "orders").select("o_orderkey", v.basic_string(messy).alias("basic"), v.free_text(messy).alias("free"), v.boolean(F.when(F.col("o_orderstatus") == "F", " Yes").otherwise("0")).alias("flag"))


@query("SELECT p_partkey, p_size - p_size % 7 + CASE WHEN p_size % 7 > 3.5 THEN 7 ELSE 0 END AS week FROM part")
def nearest_week(spark, d):
    return table(spark, d, "part").select("p_partkey", v.nearest_multiple(F.col("p_size"), (7,)).alias("week"))


#: Country texts of the query below, by nation key, and what they resolve to.
COUNTRIES = [("Norway", "Europe"), ("Poland, Sweden", "Europe"), ("Europe (Greece, Poland)", "Europe"), ("India and Egypt", "Multi-continent"), ("Atlantis", "Other"), (None, "Unknown"), ("Chile", "South America"), ("New Zealand, Atlantis", "Other"), ("Taiwan, Thailand and Japan", "Asia"), ("South Africa", "Africa")]


@query("SELECT n_nationkey, CASE n_nationkey % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, (_, x) in enumerate(COUNTRIES)) + " END AS continent FROM nation")
def continents(spark, d):
    named = F.element_at(F.array(*(F.lit(x) for x, _ in COUNTRIES)), F.col("n_nationkey").cast("int") % 10 + 1)
    return table(spark, d, "nation").select("n_nationkey", v.continent(named).alias("continent"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE round(p_size + 0.125, 2) END AS number, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size + 0.125 END AS decimal, p_size % 4 = 0 AS missing FROM part")
def normalised_numbers(spark, d):
    text = F.when(F.col("p_size") % 4 == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(",125 kg")))
    short = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(",125 ")))
    return table(spark, d, "part").select("p_partkey", v.numeric(text).alias("number"), v.decimal_comma(short).alias("decimal"), v.is_na(text).alias("missing"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 2 END AS n, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS first_key, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS first_value,
          CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus || ': ' || CAST(o_custkey AS VARCHAR) || '~prio: ' || o_orderpriority END AS text FROM orders""")
def key_value_items(spark, d):
    items = F.array(F.concat("o_orderstatus", F.lit(": "), F.col("o_custkey").cast("string")), F.concat(F.lit("prio: "), F.col("o_orderpriority")))
    text = v.joined(F.when(F.col("o_orderkey") % 5 != 0, items))
    pairs, of_list = v.pairs_of_string(text), v.pairs_of_list(F.concat(F.array(F.lit("NA")), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("n/a"))).otherwise(items)))
    same = F.when(pairs.eqNullSafe(of_list), text).otherwise(F.lit("list and text differ"))
    return table(spark, d, "orders").select("o_orderkey", F.when(pairs.isNotNull(), F.size(pairs)).alias("n"), F.try_element_at(pairs, F.lit(1))["key"].alias("first_key"), F.try_element_at(pairs, F.lit(1))["value"].alias("first_value"), same.alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE 'Stage ' || p_brand END AS label, CASE WHEN p_size % 3 = 0 THEN p_size END AS n, CASE WHEN p_size % 3 < 2 THEN p_size / 2.0 END AS pct,
          CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || '->' || p_type END AS noted, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS note FROM part""")
def labels_and_notes(spark, d):
    half = F.format_string("%.1f", F.col("p_size") / 2)
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Stage "), "p_brand", F.lit(" : "), F.col("p_size").cast("string"), F.lit(" ("), half, F.lit("%)"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Stage "), "p_brand", F.lit(": "), half, F.lit(" %"))).otherwise("no colon")
    found = v.label_count_percent(text)
    noted = texts.with_note(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(" -> "), "p_type")))
    back = F.when(noted["note"] == "", noted["value"]).otherwise(F.concat(noted["value"], F.lit("->"), noted["note"]))
    return table(spark, d, "part").select("p_partkey", found["label"].alias("label"), found["n"].alias("n"), found["pct"].alias("pct"), back.alias("noted"), noted["note"].alias("note"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'COPD only' ELSE 'COPD + other' END AS diagnosis, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'true' END AS category, CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 30 THEN 'mid' ELSE 'high' END AS band FROM part")
def classes_and_bands(spark, d):
    keys = F.when(F.col("p_size") % 3 == 1, F.array(F.lit("COPD II"), F.lit("severe COPD"))).when(F.col("p_size") % 3 == 2, F.array(F.lit("COPD"), F.lit("asthma")))
    kind, text = F.when(F.col("p_size") % 2 == 0, "number").otherwise("boolean"), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise("True")
    return table(spark, d, "part").select("p_partkey", texts.diagnosis_class(keys).alias("diagnosis"), texts.categorical(kind, text).alias("category"), v.bucket(F.col("p_size"), [1, 10, 30, 50], ["low", "mid", "high"], True).alias("band"))


@query("""WITH o AS (SELECT o_orderpriority, o_custkey % 3 AS k, o_custkey % 2 AS m FROM orders)
SELECT o_orderpriority AS field, round(avg(CASE WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 0.5 ELSE 1.0 / 3 END), 6) AS key_jaccard,
       round(sum(CASE k WHEN 0 THEN 1 + (1 - m) WHEN 1 THEN 1 ELSE 1 END) / sum(CASE k WHEN 0 THEN 2 ELSE 1 END), 6) AS value_agreement FROM o GROUP BY 1""")
def agreement_structured(spark, d):
    """Keys x and y on one side; x and y, x alone, or x and z on the other; 1,0 and 1 match, y matches on even keys."""
    pair = lambda k, x: F.struct(F.lit(k).alias("key"), x.alias("value"))
    k, m = F.col("o_custkey") % 3, F.col("o_custkey") % 2
    a = F.array(pair("x", F.lit("1,0 %")), pair("y", F.lit(" Two")))
    y = pair("y", F.when(m == 0, F.lit("two")).otherwise(F.lit("2")))
    b = F.when(k == 0, F.array(pair("x", F.lit("1")), y)).when(k == 1, F.array(pair("x", F.lit("1.0")))).otherwise(F.array(pair("x", F.lit("1.005")), pair("z", F.lit("0"))))
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("field"), a.alias("a"), b.alias("b"))
    return rounded(agreement.structured(rows), "key_jaccard", "value_agreement")


@query("SELECT o_orderpriority, round(2 * (asin(sqrt(avg(CAST(o_orderstatus = 'F' AS INT)))) - asin(sqrt(0.3))), 6) AS h FROM orders GROUP BY 1")
def share_effects(spark, d):
    share = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("p"))
    return rounded(share.select("o_orderpriority", regression.cohens_h(F.col("p"), F.lit(0.3)).alias("h")), "h")


#: Two long runs over orders with a field for each bucket: the second is changed or missing in known rows.
FIELDS = [("bool", "boolean"), ("cat", "categorical"), ("num", "numerical"), ("items", "structured_string_array"), ("text", "free_text"), ("id", "identifier"), ("note", "EXCLUDED")]


def _sides(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    money = F.round(F.col("o_totalprice"), 2)
    a = {"bool": F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("0"), "cat": F.concat(F.lit(" "), "o_orderpriority"), "num": money.cast("string"), "items": F.concat(F.lit("s: "), "o_orderstatus", F.lit("~p: 1")), "text": F.concat("o_orderpriority", F.lit(" one.")), "id": F.col("o_custkey").cast("string"), "note": F.lit("x")}
    b = {
        "bool": F.when(k % 7 == 0, "NA").when(k % 5 == 0, "yes").otherwise(F.when(F.col("o_orderstatus") == "F", "true").otherwise("no")),
        "cat": F.when(k % 5 == 0, "other").otherwise(F.col("o_orderpriority")),
        "num": F.when(k % 7 == 0, "n/a").when(k % 5 == 0, F.round(F.col("o_totalprice") + 1000, 2).cast("string")).otherwise(money.cast("string")),
        "items": F.when(k % 5 == 0, F.concat(F.lit("s: "), "o_orderstatus")).otherwise(F.concat(F.lit("p: 1.0~s: "), F.lower("o_orderstatus"))),
        "text": F.when(k % 5 == 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit(" ONE"))),
        "id": F.when(k % 5 == 0, "-").otherwise(F.col("o_custkey").cast("string")),
        "note": F.lit("y"),
    }
    long = lambda side: o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), x.cast("string").alias("value")) for f, x in side.items()])).alias("f")).select("o_orderkey", "f.*")
    return long(a), long(b), spark.createDataFrame(FIELDS, "field_name string, bucket string")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus, o_totalprice, regexp_replace(o_orderpriority, '\\s+', ' ', 'g') AS pr FROM orders),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE k % 7 <> 0) AS known, count(*) FILTER (WHERE k % 7 = 0) AS one FROM o),
bc AS (SELECT o_orderstatus = 'F' AS a, CASE WHEN k % 5 = 0 THEN true ELSE o_orderstatus = 'F' END AS b FROM o WHERE k % 7 <> 0),
bs AS (SELECT avg(CAST(a = b AS INT)) AS po, (avg(CAST(a AS INT)) + avg(CAST(b AS INT))) / 2 AS p FROM bc),
x AS (SELECT round(o_totalprice, 2) AS x, CASE WHEN k % 5 = 0 THEN round(o_totalprice + 1000, 2) ELSE round(o_totalprice, 2) END AS y FROM o WHERE k % 7 <> 0),
m AS (SELECT count(*) AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c, avg(x) - avg(y) AS g FROM x),
i AS (SELECT ((vx + vy) / 2 + c) AS s, ((vx + vy) / 2 - c) AS e, n * g * g / 2 AS r, n FROM m),
f AS (SELECT avg(CASE WHEN k % 5 = 0 THEN 2.0 * len(t) / (2 * len(t) + 1) ELSE 1.0 END) AS f1 FROM (SELECT k, list_distinct(string_split(lower(pr), ' ')) AS t FROM o)),
cg AS (SELECT pr AS a, CASE WHEN k % 5 = 0 THEN 'other' ELSE pr END AS b FROM o),
cs AS (SELECT cat, sum(pa + pb) / (2 * (SELECT n FROM n)) AS pi FROM (SELECT a AS cat, count(*) AS pa, 0 AS pb FROM cg GROUP BY a UNION ALL SELECT b, 0, count(*) FROM cg GROUP BY b) GROUP BY cat),
ce AS (SELECT sum(pi * (1 - pi)) / (count(*) - 1) AS pe FROM cs),
share AS (SELECT avg(CAST(k % 5 <> 0 AS INT)) AS keep FROM o)
SELECT 'bool' AS field, 'boolean' AS bucket, known AS n_compared, 0 AS n_both_na, one AS n_one_na, 'gwet_ac1' AS primary_name, round((po - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)), 6) AS primary_value, 'percent_agreement' AS secondary_name, round(po, 6) AS secondary_value, (po - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)) < 0.99 AS flagged FROM bs, n
UNION ALL SELECT 'cat', 'categorical', n, 0, 0, 'gwet_ac1', round((keep - pe) / (1 - pe), 6), 'percent_agreement', round(keep, 6), false FROM n, ce, share
UNION ALL SELECT 'num', 'numerical', known, 0, one, 'icc_2_1', round((s - e) / (s + e + 2 * (r - e) / i.n), 6), 'na_concordance_rate', 0.0, true FROM i, n
UNION ALL SELECT 'items', 'structured_string_array', n, 0, 0, 'key_jaccard', round(keep + (1 - keep) * 0.5, 6), 'value_agreement_on_matched_keys', 1.0, false FROM n, share
UNION ALL SELECT 'text', 'free_text', n, 0, 0, 'token_f1', round(f1, 6), NULL, NULL, false FROM n, f
UNION ALL SELECT 'id', 'identifier', n, 0, 0, 'exact_match_rate', round(keep, 6), NULL, NULL, true FROM n, share
UNION ALL SELECT 'note', 'EXCLUDED', 0, 0, 0, 'excluded', NULL, NULL, NULL, false""")
def agreement_all_buckets(spark, d):
    got = reports.agreement_results(*_sides(spark, d), ["o_orderkey"], {"boolean": (0.99, None), "numerical": (0.5, 0.9), "identifier": (0.99, None)})
    return rounded(got.drop("reason", "kappa"), "primary_value", "secondary_value")


@query("""WITH o AS (SELECT * FROM orders)
SELECT 'bool' AS field, o_orderkey, 'false' AS value_a, 'true' AS value_b, NULL AS only_in_a, NULL AS only_in_b FROM o WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 AND o_orderstatus <> 'F'
UNION ALL SELECT 'num', o_orderkey, CAST(round(o_totalprice, 2) AS VARCHAR), CAST(round(o_totalprice + 1000, 2) AS VARCHAR), NULL, NULL FROM o WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0
UNION ALL SELECT 'cat', o_orderkey, regexp_replace(o_orderpriority, '\\s+', ' ', 'g'), 'other', NULL, NULL FROM o WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'items', o_orderkey, 's: ' || o_orderstatus || '~p: 1', 's: ' || o_orderstatus, 'p', '' FROM o WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'id', o_orderkey, CAST(o_custkey AS VARCHAR), '-', NULL, NULL FROM o WHERE o_orderkey % 5 = 0""")
def agreement_disagreements(spark, d):
    found = reports.disagreements(*_sides(spark, d), ["o_orderkey"])
    only = (F.when(F.col(c).isNotNull(), F.array_join(c, " ")).alias(c) for c in ("only_in_a", "only_in_b"))
    return found.select("field", "o_orderkey", "value_a", "value_b", *only)


@query("SELECT f AS field, o_orderkey, 'b' AS missing_in FROM orders, (VALUES ('bool'), ('num')) AS t(f) WHERE o_orderkey % 7 = 0")
def agreement_one_sided(spark, d):
    return reports.one_sided(*_sides(spark, d), ["o_orderkey"]).select("field", "o_orderkey", "missing_in")


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT * FROM r WHERE l_orderkey % 11 <> 0 AND NOT (l_orderkey % 7 = 0 AND l_linenumber = 2) AND l_orderkey % 13 <> 0),
p AS (SELECT l_returnflag AS a, CASE WHEN l_quantity > 30 THEN 'X' ELSE l_returnflag END AS b FROM k), n AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS po FROM p),
c AS (SELECT cat, sum(x) AS na, sum(y) AS nb FROM (SELECT a AS cat, 1 AS x, 0 AS y FROM p UNION ALL SELECT b, 0, 1 FROM p) GROUP BY 1),
e AS (SELECT sum((na + nb) / (2.0 * n) * (1 - (na + nb) / (2.0 * n))) / (count(*) - 1) AS pe, sum(CAST(na AS DOUBLE) * nb) / (max(n) * max(n)) AS pk FROM c, n)
SELECT 'l_linestatus' AS field, 'free_text' AS bucket, count(*) AS n_compared, 'token_f1' AS primary_name, 1.0 AS primary_value, NULL AS kappa, false AS flagged, NULL AS reason FROM k
UNION ALL SELECT 'l_returnflag', 'categorical', n, 'gwet_ac1', round((po - pe) / (1 - pe), 6), round((po - pk) / (1 - pk), 6), true, printf('gwet_ac1=%.3f < 0.8', (po - pe) / (1 - pe)) FROM n, e""")
def agreement_of_runs(spark, d):
    mapping = spark.createDataFrame([("l_linestatus", "free_text"), ("l_returnflag", "categorical")], "field_name string, bucket string")
    got = reports.agreement_results(*_runs(spark, d), mapping, ["l_orderkey", "l_linenumber"], {"categorical": (0.8, None)})
    return rounded(got.select("field", "bucket", "n_compared", "primary_name", "primary_value", "kappa", "flagged", "reason"), "primary_value", "kappa")
