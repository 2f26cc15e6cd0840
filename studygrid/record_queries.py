"""More registered queries: record checks, repairs, reviews and report tables, with their SQL.

Importing this module adds them to the registry of ``studygrid.queries``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from studygrid.operators import catalogue, checks, compare, groups, inference, models, recode, repair, selection, tables
from studygrid.plans import reports
from studygrid.queries import query, rounded, table
from studygrid.sources import runs as run_files


def _lines(spark, d):
    return table(spark, d, "lineitem")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS n, least(l_linenumber * 3, l_quantity) AS f, l_quantity - least(l_linenumber * 3, l_quantity) + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS m, 100 * l_discount * 5 AS fp, 50.0 AS mp FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_linenumber AS VARCHAR) AS arm, category FROM (
SELECT *, 'gender_math_count_sum' AS category FROM r WHERE f + m <> n UNION ALL
SELECT *, 'gender_math_pct_mismatch' FROM r WHERE abs(round(f / n * 100, 2) - fp) > 1.0 UNION ALL
SELECT *, 'gender_math_pct_mismatch' FROM r WHERE abs(round(m / n * 100, 2) - mp) > 1.0 UNION ALL
SELECT *, 'gender_math_pct_sum' FROM r WHERE abs(fp + mp - 100) > 1.0)""")
def check_shares(spark, d):
    f = F.least(F.col("l_linenumber") * 3, F.col("l_quantity"))
    m = F.col("l_quantity") - f + F.when(F.col("l_linenumber") == 3, 1).otherwise(0)
    found = checks.collect(_lines(spark, d), "l_orderkey", "l_linenumber", [checks.shares(F.col("l_quantity"), f, m, 100 * F.col("l_discount") * 5, F.lit(50.0))])
    return found.select("paper_id", "arm", "category")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, l_linenumber * 2 + CAST(l_suppkey % 9 AS BIGINT) * 4 AS total FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_linenumber AS VARCHAR) AS arm, CASE WHEN total < n THEN 'array_sum_count_low' ELSE 'array_sum_count_high' END AS category, CASE WHEN total < n THEN 'rest: ' || (n - total) END AS fix_value FROM r WHERE total <> n AND total > 0""")
def check_item_sums(spark, d):
    items = F.array(F.concat(F.lit("Never: "), (F.col("l_linenumber") * 2).cast("string"), F.lit(" (10%)")), F.concat(F.lit("Now: "), (F.col("l_suppkey") % 9 * 4).cast("string")), F.lit("Share: 5%"))
    found = checks.collect(_lines(spark, d), "l_orderkey", "l_linenumber", [checks.item_sum("smoking", items, F.col("l_quantity").cast("long"), "rest")])
    return found.select("paper_id", "arm", "category", "fix_value")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_linenumber AS VARCHAR) AS arm, 'severity_prefix_casing' AS category, lower(l_returnflag) || '_sd: ' || l_linestatus AS fix_value FROM lineitem WHERE l_returnflag IN ('A', 'R')
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), 'severity_prefix_unknown', NULL FROM lineitem WHERE l_linenumber = 2""")
def check_item_prefixes(spark, d):
    items = F.array(F.concat("l_returnflag", F.lit("_sd: "), "l_linestatus"), F.when(F.col("l_linenumber") == 2, "two words: 1").otherwise("other: 1"))
    found = checks.collect(_lines(spark, d), "l_orderkey", "l_linenumber", [checks.item_prefixes(items, ["a_mean", "r"])])
    return found.select("paper_id", "arm", "category", "fix_value")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_linenumber AS VARCHAR) AS arm, CASE WHEN l_quantity < 7.5 THEN 'Mild' WHEN l_quantity <= 9.0 THEN 'Moderate' ELSE 'Severe' END AS fix_value FROM lineitem
WHERE CASE l_returnflag WHEN 'A' THEN 'Mild' WHEN 'N' THEN 'Severe' END <> CASE WHEN l_quantity < 7.5 THEN 'Mild' WHEN l_quantity <= 9.0 THEN 'Moderate' ELSE 'Severe' END""")
def check_graded(spark, d):
    label = F.when(F.col("l_returnflag") == "A", "Mild").when(F.col("l_returnflag") == "N", "Severe").otherwise("NA")
    return checks.collect(_lines(spark, d), "l_orderkey", "l_linenumber", [checks.graded("grade", F.col("l_quantity"), label)]).select("paper_id", "arm", "fix_value")


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, bool_or(l_linenumber = 1 AND l_returnflag = 'N') AS control, bool_or(l_returnflag = 'R') AS treat, count(DISTINCT l_linestatus) AS kinds FROM lineitem GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, category FROM (
SELECT l_orderkey, 'cross_arm_time' AS category FROM g WHERE n >= 2 AND kinds > 1 UNION ALL SELECT l_orderkey, 'cross_arm_missing_treat' FROM g WHERE n >= 2 AND NOT treat UNION ALL
SELECT l_orderkey, 'cross_arm_missing_control' FROM g WHERE n >= 2 AND NOT control UNION ALL SELECT l_orderkey, 'arm_count_mismatch' FROM g JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 > 0 AND o_custkey % 5 <> n)""")
def check_whole_paper(spark, d):
    arm = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "N"), "control").when(F.col("l_returnflag") == "R", "treat1").otherwise("other")
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("n_arms"))
    return checks.whole_paper(_lines(spark, d).withColumn("arm", arm), "l_orderkey", "arm", ["l_linestatus"], expected).select("paper_id", "category")


@query("""WITH r AS (SELECT *, CASE l_linenumber WHEN 1 THEN 'treat4' WHEN 2 THEN 'Usual care' ELSE 'arm ' || l_linenumber END AS arm FROM lineitem),
n AS (SELECT *, coalesce(max(CASE WHEN arm = 'treat4' THEN 4 END) OVER (PARTITION BY l_orderkey), 0) + sum(CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, arm ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT l_orderkey, l_linenumber, arm, CASE WHEN l_linenumber = 1 THEN arm WHEN l_linenumber = 2 THEN 'control' ELSE 'treat' || CAST(k AS BIGINT) END AS new_arm FROM n""")
def rename_arms(spark, d):
    n = F.col("l_linenumber")
    rows = _lines(spark, d).select("l_orderkey", "l_linenumber", F.when(n == 1, "treat4").when(n == 2, "Usual care").otherwise(F.concat(F.lit("arm "), n.cast("string"))).alias("arm"))
    return repair.rename_arms(rows, "l_orderkey", "arm", "l_linenumber")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS cov_nr, o_orderstatus AS arm, 'grade' AS field_name, '"' || o_orderpriority || '"' AS old_value, '"Moderate"' AS new_value FROM orders WHERE o_totalprice > 100000 AND o_orderpriority <> 'Moderate'""")
def fix_audit(spark, d):
    o = table(spark, d, "orders")
    run = o.select(F.col("o_orderkey").cast("string").alias("cov_nr"), F.col("o_orderstatus").alias("arm"), F.lit("grade").alias("field_name"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')).alias("value"))
    fixes = o.where("o_totalprice > 100000").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("arm"), F.lit("grade_mismatch").alias("category"), F.lit("grade").alias("fix_field"), F.lit("Moderate").alias("fix_value"))
    return repair.apply_fixes(run, fixes, "sev")[1].drop("category")


NOTES = "CASE o_custkey % 4 WHEN 0 THEN 'please Rerun' WHEN 1 THEN 'ignore, expected' WHEN 2 THEN 'hm' END"


@query(f"""WITH l AS (SELECT o_custkey AS p, min(CASE WHEN o_orderstatus = 'F' THEN 'fixed' ELSE 'open' END) AS s, max(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS open FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1),
r AS (SELECT o_custkey AS p, count(DISTINCT coalesce(note, '')) AS notes, min(CASE note WHEN 'please Rerun' THEN 'rejected' WHEN 'hm' THEN NULL ELSE 'accepted' END) AS d, bool_or(note IS NULL) AS blank FROM (SELECT o_custkey, {NOTES} AS note FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1)
SELECT CASE WHEN notes > 1 THEN 'conflict' WHEN d IS NULL AND NOT blank THEN 'undecided' WHEN open IS NULL THEN 'not_found' WHEN open = 0 THEN 'already_resolved' ELSE 'applied' END AS outcome, count(*) AS n FROM r LEFT JOIN l USING (p) GROUP BY 1""")
def review_outcomes(spark, d):
    o = table(spark, d, "orders")
    key = (F.col("o_custkey").cast("string").alias("paper_id"), F.lit("c").alias("category"), F.lit("m").alias("message"))
    ledger = o.where("o_orderkey % 3 > 0").select(*key, F.lit("ERROR").alias("severity"), F.when(F.col("o_orderstatus") == "F", "fixed").otherwise("open").alias("status"))
    reviewed = o.where("o_orderkey % 2 = 0").select(*key, F.expr(NOTES).alias("resolution_note"))
    return repair.apply_review(ledger, reviewed)[1]


@query("""WITH e AS (SELECT o_orderkey, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, CASE WHEN o_custkey % 10 = 0 THEN 'delete' ELSE 'back_up' END AS action FROM orders JOIN e USING (o_orderkey) WHERE o_custkey % 10 <= 1 OR k >= 3""")
def quarantine(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.nullif(F.col("o_custkey") % 10, F.lit(0)).alias("n_arms"))
    errors = _lines(spark, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("paper_id"), F.lit("ERROR").alias("severity"))
    return repair.quarantine(files, errors, 3)


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'reported' WHEN 'O' THEN 'not_reported' ELSE 'ambiguous' END"


@query(f"SELECT o_orderpriority AS domain, count(*) FILTER (WHERE s = 'reported') AS reported, count(*) FILTER (WHERE s = 'not_reported') AS not_reported, count(*) FILTER (WHERE s = 'ambiguous') AS ambiguous, round(count(*) FILTER (WHERE s = 'reported') / count(*), 6) AS proportion FROM (SELECT *, {STATUS} AS s FROM orders) GROUP BY 1")
def domain_table(spark, d):
    return rounded(tables.domain_table(table(spark, d, "orders").withColumn("status", F.expr(STATUS)), "o_orderpriority"), "proportion")


FLAGS = {"excludes": "l_returnflag = 'R'", "equipment": "l_tax > 0.04", "training": "l_discount > 0.05", "support": "l_quantity > 25"}


def _flags(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", *[F.expr(e).alias(n) for n, e in FLAGS.items()])


@query(" UNION ALL ".join(f"SELECT '{n}' AS flag, count(*) FILTER (WHERE {e}) AS n_yes, count(*) FILTER (WHERE NOT ({e})) AS n_no, round(count(*) FILTER (WHERE {e}) / count(*), 6) AS proportion FROM lineitem" for n, e in FLAGS.items()))
def prevalence(spark, d):
    return rounded(tables.prevalence(_flags(spark, d), list(FLAGS)), "proportion")


FLAG_ROWS = "f AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST({e} AS INT) AS {n}" for n, e in FLAGS.items()) + " FROM lineitem)"


@query(f"WITH {FLAG_ROWS} SELECT l_orderkey, l_linenumber, 2 * (1 - excludes) + equipment + training * greatest(1 - excludes, equipment) + support * greatest(1 - excludes, equipment) AS score FROM f")
def inclusiveness_score(spark, d):
    return _flags(spark, d).select("l_orderkey", "l_linenumber", tables.inclusiveness(*map(F.col, FLAGS)).alias("score"))


@query(f"WITH {FLAG_ROWS}, b(v) AS (VALUES (0), (1)) SELECT a.v AS excludes, b.v AS equipment, c.v AS training, e.v AS support, count(l_orderkey) AS n FROM b a CROSS JOIN b CROSS JOIN b c CROSS JOIN b e LEFT JOIN f ON f.excludes = a.v AND f.equipment = b.v AND f.training = c.v AND f.support = e.v GROUP BY 1, 2, 3, 4")
def combinations(spark, d):
    return tables.combinations(_flags(spark, d), list(FLAGS))


ERRORS = {"first": "CASE l_returnflag WHEN 'R' THEN 'rule_misapplication' ELSE 'none' END", "second": "CASE WHEN l_quantity > 40 THEN 'hallucinated_value' WHEN l_linenumber < 4 THEN 'none' END"}
ERROR_ROWS = "r AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ERRORS.items()) + " FROM lineitem)"


@query(f"""WITH {ERROR_ROWS}, c AS (SELECT unnest([first, second]) AS t FROM r), k AS (SELECT t, count(*) AS n FROM c WHERE t IS NOT NULL GROUP BY 1), b AS (SELECT first = 'rule_misapplication' AS x, coalesce(second = 'hallucinated_value', false) AS y, first = 'none' OR coalesce(second = 'none', false) AS z FROM r),
s AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE x OR y) AS bad, count(*) FILTER (WHERE x) AS minor, count(*) FILTER (WHERE y) AS major, count(*) FILTER (WHERE z AND NOT x AND NOT y) AS fine FROM b)
SELECT CASE t WHEN 'none' THEN 'no_error' WHEN 'rule_misapplication' THEN 'minor_error' ELSE 'major_error' END AS error_type, n AS count, round(100.0 * n / (SELECT sum(n) FROM k), 6) AS pct, CASE t WHEN 'none' THEN fine WHEN 'rule_misapplication' THEN minor ELSE major END AS rows_with_type, n_rows FROM k, s
UNION ALL SELECT 'any_error', bad, round(100.0 * bad / n_rows, 6), bad, n_rows FROM s""")
def error_summary(spark, d):
    return rounded(tables.error_summary(_lines(spark, d).select(*[F.expr(e).alias(n) for n, e in ERRORS.items()]), list(ERRORS)), "pct")


@query(f"WITH {ERROR_ROWS} " + " UNION ALL ".join(f"SELECT '{n}' AS field, count(*) FILTER (WHERE {n} = 'none') AS none, count(*) FILTER (WHERE {n} = 'rule_misapplication') AS minor, count(*) FILTER (WHERE {n} = 'hallucinated_value') AS major, count(*) FILTER (WHERE {n} IN ('rule_misapplication', 'hallucinated_value')) AS any_error, count({n}) AS reported FROM r" for n in ERRORS))
def error_fields(spark, d):
    return tables.error_fields(_lines(spark, d).select(*[F.expr(e).alias(n) for n, e in ERRORS.items()]), list(ERRORS))


@query("SELECT o_orderpriority AS bucket, count(*) AS fields, count(*) FILTER (WHERE o_totalprice < 50000) AS flagged, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY 1")
def bucket_summary(spark, d):
    return rounded(tables.bucket_summary(table(spark, d, "orders").select(F.col("o_orderpriority").alias("bucket"), F.col("o_totalprice").alias("value"), (F.col("o_totalprice") < 50000).alias("flagged"))), "median", digits=4)


@query("SELECT l_shipmode AS day, count(*) AS calls, sum(l_partkey) AS tokens_in, sum(l_suppkey) AS tokens_out, round(sum(CASE l_returnflag WHEN 'A' THEN l_partkey * 0.14 + l_suppkey * 0.28 WHEN 'N' THEN l_partkey * 0.435 + l_suppkey * 0.87 ELSE 0 END) / 1e6, 6) AS cost FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def costs(spark, d):
    calls = _lines(spark, d).select(F.col("l_linestatus").alias("day"), F.col("l_returnflag").alias("model"), F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"))
    prices = spark.createDataFrame([("A", 0.14, 0.28), ("N", 0.435, 0.87)], "model string, price_in double, price_out double")
    return rounded(tables.costs(calls, prices, ["day"]), "cost")


@query("""SELECT (SELECT count(*) FROM customer) AS papers, count(*) FILTER (WHERE n = 1) AS single_arm, CAST(0 AS BIGINT) AS invalid, (SELECT count(*) FROM customer) - count(*) AS unprocessed, count(*) FILTER (WHERE f >= 5) AS catastrophic FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1)""")
def run_health(spark, d):
    o = table(spark, d, "orders")
    papers = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"))
    outputs = o.groupBy(F.col("o_custkey").alias("paper_id")).agg(F.count("*").alias("n_arms"))
    return tables.run_health(papers, outputs, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("paper_id"), F.lit("ERROR").alias("severity")))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', 'unknown')")
def version_drift(spark, d):
    return tables.version_drift(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "1-URGENT", "o_orderpriority")


@query("SELECT round(sum(l_quantity * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem")
def self_weighted(spark, d):
    return rounded(tables.self_weighted(_lines(spark, d), "l_quantity"), "mean")


@query("WITH c AS (SELECT CAST(least(floor((l_quantity - 5) / 8), 4) AS BIGINT) AS b, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 GROUP BY 1) SELECT r AS bin, 5 + r * 8.0 AS low, 5 + (r + 1) * 8.0 AS high, coalesce(n, 0) AS n FROM range(5) t(r) LEFT JOIN c ON b = r")
def histogram(spark, d):
    return rounded(tables.histogram(_lines(spark, d), "l_quantity", 5, 45, 5), "low", "high")


@query("SELECT size, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY 1")
def group_sizes(spark, d):
    return tables.group_sizes(_lines(spark, d), "l_orderkey")


@query("""WITH s AS (SELECT count(*) AS n, var_pop(l_tax) AS zz, var_pop(l_quantity) AS xx, covar_pop(l_quantity, l_tax) AS xz, covar_pop(l_extendedprice, l_tax) AS yz, covar_pop(l_extendedprice, l_quantity) AS xy FROM lineitem) SELECT n, round((xy - xz * yz / zz) / (xx - xz * xz / zz), 4) AS slope FROM s""")
def partial_slope(spark, d):
    return rounded(models.partial_slope(_lines(spark, d), "l_extendedprice", "l_quantity", "l_tax"), "slope", digits=4)


@query("""WITH m AS (SELECT count(*) AS n, avg(c_nationkey) AS mx, regr_slope(c_acctbal, c_nationkey) AS b, regr_intercept(c_acctbal, c_nationkey) AS a, regr_sxx(c_acctbal, c_nationkey) AS sxx, regr_syy(c_acctbal, c_nationkey) - regr_slope(c_acctbal, c_nationkey) * regr_sxy(c_acctbal, c_nationkey) AS rest FROM customer),
e AS (SELECT c_acctbal AS y, c_nationkey AS x, n, b, pow(c_acctbal - a - b * c_nationkey, 2) AS r2, 1.0 / n + pow(c_nationkey - mx, 2) / sxx AS h, rest FROM customer, m),
k AS (SELECT *, r2 * h / (2 * rest / (n - 2) * pow(1 - h, 2)) > 4.0 / n AS bad FROM e)
SELECT max(n) AS n, round(max(b), 6) AS slope, count(*) FILTER (WHERE bad) AS n_influential, count(*) FILTER (WHERE NOT bad) AS n_after, round(regr_slope(y, x) FILTER (WHERE NOT bad), 6) AS slope_after, round(regr_intercept(y, x) FILTER (WHERE NOT bad), 6) AS intercept_after FROM k""")
def refit_without_influential(spark, d):
    return rounded(models.refit(table(spark, d, "customer"), "c_acctbal", "c_nationkey"), "slope", "slope_after", "intercept_after")


@query("""WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem),
u AS (SELECT l_orderkey, sum((l_quantity - mx) * (l_extendedprice - a - b * l_quantity)) AS u FROM lineitem, m GROUP BY 1), s AS (SELECT count(*) AS g, sum(u * u) AS meat FROM u)
SELECT n, g AS clusters, round(b, 4) AS slope, round(sqrt(g * (n - 1) / ((g - 1.0) * (n - 2)) * meat) / sxx, 4) AS se FROM m, s""")
def clustered_errors(spark, d):
    return rounded(models.fit_clustered(_lines(spark, d), "l_extendedprice", "l_quantity", "l_orderkey").drop("z"), "slope", "se", digits=4)


MEANS = "SELECT l_returnflag AS variable, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1"
COHORTS = "SELECT l_linestatus AS cohort, l_returnflag AS variable, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2"


@query(f"WITH m AS ({MEANS}), c AS ({COHORTS}) SELECT cohort, variable, round((m.mean - c.mean) / sqrt((m.sd * m.sd + c.sd * c.sd) / 2), 6) AS smd, round(m.se / sqrt((m.sd * m.sd + c.sd * c.sd) / 2), 6) AS se FROM m JOIN c USING (variable)")
def against_cohorts(spark, d):
    rows = _lines(spark, d)
    of = (F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"))
    means = rows.groupBy(F.col("l_returnflag").alias("variable")).agg(*of, (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("se"))
    cohorts = rows.where("l_linenumber = 1").groupBy(F.col("l_linestatus").alias("cohort"), F.col("l_returnflag").alias("variable")).agg(*of)
    return rounded(models.against_cohorts(means, cohorts).select("cohort", "variable", "smd", "se"), "smd", "se")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, round(sum({c} * l_quantity) / sum(l_quantity), 6) AS weighted, round(avg({c}), 6) AS simple FROM lineitem" for c in ("l_tax", "l_discount")))
def weighted_and_simple(spark, d):
    return rounded(models.weighted_and_simple(_lines(spark, d), ["l_tax", "l_discount"], "l_quantity").drop("difference"), "weighted", "simple")


#: Rules of three diseases over the files below.
CATALOGUE = {
    "copd": {"required": ["cov_nr", "arm", "n", "age", "sd", "grade", "flag", "items"], "numeric": {"n": (5, 45, True), "age": (0, 60000, False)}, "boolean": ["flag"], "array": ["items"], "below": [("sd", "n")]},
    "cvd": {"required": ["cov_nr", "arm", "n", "age", "sd", "grade", "flag", "items", "extra"], "enum": {"grade": [1, 2]}, "numeric": {"sd": (None, 2.5, True)}, "above": [("n", "sd")]},
    "dm": {"required": ["cov_nr", "arm", "n", "age", "sd", "grade", "flag", "items"], "text_enum": {"flag": ["yes"]}, "array": ["items"], "sum": [("n", "sd", "whole")]},
}


def _result_files(spark, d):
    """A file of one disease for each order: a list of its lines, or their first for a tenth of the orders; each line a record with faults."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    arm = F.when(flag == "R", F.concat(F.lit("treat"), n.cast("string"))).when(flag == "A", "control").otherwise(F.concat(F.lit("Group ("), n.cast("string"), F.lit(")")))
    text = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    field = lambda name, x: F.concat(F.lit(f'"{name}":'), x.cast("string"))
    grade = F.when(n % 4 == 0, text(n % 4)).otherwise((n % 4).cast("string"))
    fields = [
        field("cov_nr", text(F.when(n == 5, "9").otherwise(F.col("l_orderkey")))), field("arm", text(arm)), field("n", F.col("l_quantity").cast("int")),
        field("age", F.when(n == 3, '"old"').when(n == 4, '"NA"').otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))),
        field("sd", (n / 2 * 7).cast("decimal(12,1)")), field("grade", grade), field("flag", F.when(flag == "R", "true").when(flag == "A", '"yes"').otherwise("0")),
        field("items", F.when(n == 2, '"NA"').when(n == 6, '"one"').otherwise('["one: 1"]')), F.when(n == 7, '"unknown":1'), F.when(n == 1, '"_metadata":{"prompt_version":"v7"}'),
    ]
    rows = _lines(spark, d).select("l_orderkey", F.struct("l_linenumber", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("j")).alias("r"))
    papers = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"]).alias("j"))
    doc = F.when(F.col("l_orderkey") % 10 == 0, F.get("j", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("j", ","), F.lit("]")))
    disease = F.element_at(F.array(*map(F.lit, CATALOGUE)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return papers.select(F.col("l_orderkey").cast("string").alias("paper_id"), disease.alias("disease"), doc.alias("text"))


@query("""WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, l_orderkey % 3 AS disease, l_linenumber AS i, CAST(trunc(l_quantity) AS INT) AS n, round(l_extendedprice, 2) AS age, l_linenumber * 3.5 AS sd, l_returnflag AS f,
  CASE l_returnflag WHEN 'R' THEN 'treat' || l_linenumber WHEN 'A' THEN 'control' ELSE 'Group (' || l_linenumber || ')' END AS arm, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS least, count(*) OVER (PARTITION BY l_orderkey) AS arms FROM lineitem WHERE l_orderkey % 10 <> 0),
p AS (SELECT paper_id, max(CASE WHEN i = 1 AND least = 1 THEN 'v7' ELSE '' END) AS prompt_version, max(arms) AS arms, bool_or(f = 'A') AS control, bool_or(f = 'R') AS treat FROM r GROUP BY 1),
e AS (
SELECT paper_id, arm, 'range_violation' AS category, NULL AS fix_value FROM r WHERE disease = 0 AND (n < 5 OR n > 45)
UNION ALL SELECT paper_id, arm, 'range_violation', NULL FROM r WHERE disease = 0 AND i NOT IN (3, 4) AND age > 60000
UNION ALL SELECT paper_id, arm, 'type_numeric', NULL FROM r WHERE disease = 0 AND i = 3
UNION ALL SELECT paper_id, arm, 'type_boolean', NULL FROM r WHERE disease = 0 AND f <> 'R'
UNION ALL SELECT paper_id, arm, 'type_array', NULL FROM r WHERE disease IN (0, 2) AND i = 6
UNION ALL SELECT paper_id, arm, 'range_order', NULL FROM r WHERE disease = 0 AND sd >= n OR disease = 1 AND n <= sd
UNION ALL SELECT paper_id, arm, 'schema_missing_field', NULL FROM r WHERE disease = 1
UNION ALL SELECT paper_id, arm, 'type_enum', NULL FROM r WHERE disease = 1 AND i % 4 NOT IN (1, 2) OR disease = 2 AND f <> 'A'
UNION ALL SELECT paper_id, arm, 'type_integer', CAST(CASE WHEN CAST(floor(sd) AS BIGINT) % 2 = 0 THEN floor(sd) ELSE floor(sd) + 1 END AS BIGINT)::VARCHAR FROM r WHERE disease = 1 AND sd <> floor(sd)
UNION ALL SELECT paper_id, arm, 'range_violation', NULL FROM r WHERE disease = 1 AND sd > 2.5
UNION ALL SELECT paper_id, arm, 'schema_extra_field', NULL FROM r WHERE i = 7
UNION ALL SELECT paper_id, arm, 'schema_cov_nr_mismatch', NULL FROM r WHERE i = 5 AND paper_id <> '9'
UNION ALL SELECT paper_id, arm, 'schema_arm_naming', NULL FROM r, (VALUES (1), (2)) AS t(x) WHERE f = 'N'
UNION ALL SELECT paper_id, NULL, 'cross_arm_missing_treat', NULL FROM p WHERE arms >= 2 AND NOT treat
UNION ALL SELECT paper_id, NULL, 'cross_arm_missing_control', NULL FROM p WHERE arms >= 2 AND NOT control)
SELECT e.*, prompt_version FROM e JOIN p USING (paper_id)
UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), NULL, 'schema_not_list', NULL, '' FROM lineitem WHERE l_orderkey % 10 = 0""")
def validate_files(spark, d):
    found = catalogue.validate_files(_result_files(spark, d), catalogue.compiled(spark, CATALOGUE))
    return found.select("paper_id", "arm", "category", "fix_value", "prompt_version")


@query("""WITH w AS (SELECT DISTINCT substr(p_name, 1, strpos(p_name || ' ', ' ') - 1) AS word FROM part WHERE p_partkey % 3 = 0),
i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(substr(p_name, 1, strpos(p_name || ' ', ' ') - 1)) WHEN 1 THEN substr(p_name, 1, strpos(p_name || ' ', ' ') - 1) || '_sd' WHEN 2 THEN 'x' || p_partkey % 7 ELSE substr(p_name, 1, strpos(p_name || ' ', ' ') - 1) END AS prefix FROM part),
m AS (SELECT p_partkey, prefix, (SELECT max(length(word)) FROM w WHERE starts_with(lower(prefix), lower(word))) AS k, prefix IN (SELECT word FROM w) AS fine FROM i)
SELECT p_partkey AS paper_id, prefix, CASE WHEN k = length(prefix) THEN 'case' WHEN k IS NULL THEN 'invalid' ELSE 'similar' END AS issue, CASE WHEN k IS NOT NULL THEN (SELECT min(word) FROM w WHERE lower(word) = substr(lower(prefix), 1, k)) END AS expected FROM m WHERE NOT fine""")
def vocabulary_issues(spark, d):
    part, first = table(spark, d, "part"), F.substring_index("p_name", " ", 1)
    words = part.where("p_partkey % 3 = 0").select(F.lit("copd").alias("disease"), first.alias("word"))
    k = F.col("p_partkey") % 4
    value = F.when(k == 0, F.upper(first)).when(k == 1, F.concat(first, F.lit("_sd"))).when(k == 2, F.concat(F.lit("x"), (F.col("p_partkey") % 7).cast("string"))).otherwise(first)
    items = part.select(F.col("p_partkey").alias("paper_id"), F.lit("control").alias("arm"), F.lit("copd").alias("disease"), F.concat(value, F.lit(": 1")).alias("value"))
    return catalogue.vocabulary_issues(items, words).select("paper_id", "prefix", "issue", "expected")


@query("""WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_tax) AS mb, var_pop(l_extendedprice) AS yy, var_pop(l_quantity) AS aa, var_pop(l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_tax, l_extendedprice) AS yb FROM lineitem),
c AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS a1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b1 FROM s),
v AS (SELECT *, (yy - a1 * ay - b1 * yb) / (n - 3) AS s2 FROM c)
SELECT 'Intercept' AS term, n, round(my - a1 * ma - b1 * mb, 3) AS estimate, round(sqrt(s2 * (1 + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)), 3) AS se FROM v
UNION ALL SELECT 'l_quantity', n, round(a1, 3), round(sqrt(s2 * bb / det), 3) FROM v UNION ALL SELECT 'l_tax', n, round(b1, 3), round(sqrt(s2 * aa / det), 3) FROM v""")
def ols_many(spark, d):
    return rounded(inference.fit_many(_lines(spark, d), "l_extendedprice", ["l_quantity", "l_tax"]).select("term", "n", "estimate", "se"), "estimate", "se", digits=3)


def _determinant(cells) -> str:
    """SQL of the determinant of named cells."""
    k, terms = len(cells), []
    for order in itertools.permutations(range(k)):
        sign = "-" if sum(order[i] > order[j] for i in range(k) for j in range(i + 1, k)) % 2 else "+"
        terms.append(sign + " * ".join(cells[i][order[i]] for i in range(k)))
    return f"({' '.join(terms)})"


DESIGN = ["l_quantity", "l_tax", "l_discount", "l_linenumber"]
CELLS = [[f"g{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
MINOR = [_determinant([[CELLS[i][j] for j in range(4) if j != m] for i in range(4) if i != m]) for m in range(4)]


@query(f"WITH g AS (SELECT {', '.join(f'sum(CAST({DESIGN[i]} AS DOUBLE) * {DESIGN[j]}) AS g{i}{j}' for i in range(4) for j in range(i, 4))} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(g{m}{m} * {MINOR[m]} / {_determinant(CELLS)}, 6) AS vif FROM g" for m, c in enumerate(DESIGN)))
def vif_many(spark, d):
    return rounded(inference.vif(_lines(spark, d), DESIGN), "vif")


#: Four runs over the lines: what each has of a line's fields, and how it changes them.
RUNS = {
    "r1": ("true", "l_returnflag", "l_linestatus"), "r2": ("l_orderkey % 7 <> 0", "CASE WHEN l_quantity > 30 THEN 'X' ELSE l_returnflag END", "l_linestatus"),
    "r3": ("l_linenumber <> 2", "l_returnflag", "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_linestatus END"), "r4": ("l_orderkey % 7 <> 0 AND l_linenumber <> 3", "l_returnflag", "lower(l_linestatus)"),
}
RUNS_SQL = "u AS (" + " UNION ALL ".join(f"SELECT '{r}' AS run, l_orderkey AS p, l_linenumber AS a, {f} AS flag, {s} AS status FROM o WHERE {t}" for r, (t, f, s) in RUNS.items()) + ")"


def _four_runs(spark, d):
    rows = _lines(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.max("l_quantity").alias("l_quantity"))
    # All runs from one pass over the lines.
    each = [F.struct(F.lit(r).alias("run"), F.lit(name).alias("field_name"), F.expr(value).alias("value"), F.expr(t).alias("there")) for r, (t, f, s) in RUNS.items() for name, value in (("flag", f), ("status", s))]
    cells = rows.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("arm"), F.inline(F.array(*each)))
    return cells.where("there").select("run", "paper_id", "arm", "field_name", "value")


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2), {RUNS_SQL},
n AS (SELECT DISTINCT run, p FROM u), k AS (SELECT DISTINCT p, a FROM u),
j AS (SELECT k.p, k.a, x.run AS run_a, y.run AS run_b, ua.run AS ra, ub.run AS rb, ua.flag AS fa, ub.flag AS fb, ua.status AS sa, ub.status AS sb FROM k JOIN n x ON x.p = k.p JOIN n y ON y.p = k.p AND x.run < y.run
  LEFT JOIN u ua ON ua.p = k.p AND ua.a = k.a AND ua.run = x.run LEFT JOIN u ub ON ub.p = k.p AND ub.a = k.a AND ub.run = y.run)
SELECT p AS paper_id, run_a, run_b, CAST(a AS VARCHAR) AS arm, 'flag' AS field, fa AS value_a, fb AS value_b FROM j WHERE ra IS NOT NULL AND rb IS NOT NULL AND fa IS DISTINCT FROM fb
UNION ALL SELECT p, run_a, run_b, CAST(a AS VARCHAR), 'status', sa, sb FROM j WHERE ra IS NOT NULL AND rb IS NOT NULL AND sa IS DISTINCT FROM sb
UNION ALL SELECT p, run_a, run_b, CAST(a AS VARCHAR), '_status', CASE WHEN ra IS NULL THEN 'missing' ELSE 'present' END, CASE WHEN rb IS NULL THEN 'missing' ELSE 'present' END FROM j WHERE (ra IS NULL) <> (rb IS NULL)""")
def diff_pairs(spark, d):
    return compare.diff_pairs(_four_runs(spark, d))


@query("""WITH r AS (SELECT l_orderkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity) - 1 AS i, l_returnflag, l_linestatus, l_quantity, l_shipmode FROM (SELECT *, l_returnflag || l_linenumber AS l_shipmode FROM lineitem)),
z AS (SELECT * FROM r WHERE p % 3 <> 0 AND i < 4),
f AS (SELECT 'flag' AS field_name, p, i, l_quantity > 30 AS bad FROM z UNION ALL SELECT 'status', p, i, i = 1 FROM z UNION ALL SELECT 'mode', p, i, false FROM z),
s AS (SELECT field_name, list(p || '_' || i ORDER BY p, i) AS x FROM f WHERE bad GROUP BY 1)
SELECT f.field_name, 'common' AS presence, CASE WHEN bool_or(bad) THEN 'DIFF' ELSE 'SAME' END AS status, count(*) FILTER (WHERE NOT bad) AS same, count(*) FILTER (WHERE bad) AS diff, coalesce(any_value(array_to_string(x[1:5], ' ')), '') AS sample FROM f LEFT JOIN s ON f.field_name = s.field_name GROUP BY 1
UNION ALL VALUES ('old', 'removed', NULL, NULL, NULL, NULL), ('fresh', 'new', NULL, NULL, NULL, NULL)""")
def compare_by_place(spark, d):
    order = F.struct("l_linenumber", "l_extendedprice", "l_quantity").alias("k")
    lists = _lines(spark, d).groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.array_sort(F.collect_list(F.struct(order, "l_returnflag", "l_linestatus"))).alias("x"))
    at = lists.select("paper_id", F.posexplode("x").alias("place", "y"))
    rows = at.select("paper_id", "place", F.col("y.l_returnflag").alias("flag"), F.col("y.l_linestatus").alias("status"), F.concat("y.l_returnflag", F.col("y.k.l_linenumber").cast("string")).alias("mode"), F.col("y.k.l_quantity").alias("q"))
    a = rows.where("place < 4").withColumn("old", F.lit("1"))
    b = rows.where("paper_id % 3 <> 0").withColumn("fresh", F.lit("1")).withColumn("flag", F.when(F.col("q") > 30, "X").otherwise(F.col("flag"))).withColumn("status", F.when(F.col("place") != 1, F.col("status")))
    # By inline, as unpivot forgets that the rows are dealt by paper.
    long = lambda df, names: df.select("paper_id", "place", F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in names]))).where("value IS NOT NULL")
    out = compare.compare_by_place(long(a, ["flag", "status", "mode", "old"]), long(b, ["flag", "status", "mode", "fresh"]))
    return out.withColumn("sample", F.array_join("sample", " "))


@query("SELECT o_orderkey, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS c_name, (SELECT count(*) FROM orders WHERE o_custkey % 6 = 0) AS unmatched FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 6 <> 0")
def with_lookup(spark, d):
    lookup = table(spark, d, "customer").where("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    joined, gaps = selection.with_lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), lookup, "o_custkey", "c_name")
    return joined.crossJoin(F.broadcast(gaps)).select("o_orderkey", "c_name", "unmatched")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus AS bucket FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag <> 'N'")
def with_group_values(spark, d):
    trials = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("bucket"))
    arms = _lines(spark, d).select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("setting"))
    return selection.with_group_values(arms, trials, "l_orderkey", ["bucket"], ("setting",)).drop("setting")


@query("WITH v AS (SELECT CASE WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS value FROM customer) SELECT value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v), 6) AS pct FROM v GROUP BY 1")
def value_counts(spark, d):
    rows = table(spark, d, "customer").select(F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("v"))
    return rounded(selection.value_counts(rows, "v", missing=True), "pct")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 20 UNION ALL (SELECT -o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 50)")
def seeded_sample(spark, d):
    o = table(spark, d, "orders")
    return selection.seeded_sample(o, "o_orderkey", 20, 7, "o_orderstatus").select("o_orderkey").unionByName(selection.seeded_sample(o, "o_orderkey", 50, 7).select((-F.col("o_orderkey")).alias("o_orderkey")))


@query("SELECT l_orderkey, l_returnflag, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def distinct_keys(spark, d):
    rows = _lines(spark, d).select("l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice")
    return selection.distinct_keys(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_extendedprice"]).drop("l_linenumber")


@query("SELECT count(DISTINCT o_custkey) AS groups, round(sum(o_totalprice), 2) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def members_of(spark, d):
    return rounded(selection.members_of(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "o_totalprice"), "n", digits=2)


@query(f"""WITH m AS ({MEANS}), c AS ({COHORTS})
SELECT m.variable, printf('%.1f', m.mean) AS estimate, m.se IS NOT NULL AS has_interval, o.x AS cohort, CASE WHEN c.mean IS NULL THEN '—' ELSE printf('%.1f (%.1f)', c.mean, c.sd) END AS mean_sd FROM m CROSS JOIN (VALUES ('F'), ('O'), ('none')) AS o(x) LEFT JOIN c ON c.cohort = o.x AND c.variable = m.variable""")
def baseline_comparison(spark, d):
    rows = _lines(spark, d)
    of = (F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"), F.count("*").alias("n"))
    pooled = rows.groupBy(F.col("l_returnflag").alias("variable")).agg(*of, (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("se"))
    pooled = pooled.select("variable", "mean", "se", (F.col("mean") - F.col("se")).alias("ci_low"), (F.col("mean") + F.col("se")).alias("ci_high"), "n")
    cohorts = rows.where("l_linenumber = 1").groupBy(F.col("l_linestatus").alias("cohort"), F.col("l_returnflag").alias("variable")).agg(*of)
    out = tables.baseline_comparison(pooled, cohorts, ["F", "O", "none"])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("cohort"), F.col(f"{c}_mean_sd").alias("mean_sd")) for c in ("F", "O", "none")]))
    return out.select("variable", "estimate", F.col("ci").startswith("[").alias("has_interval"), pairs.alias("p")).select("variable", "estimate", "has_interval", "p.*")


@query("""WITH t AS (SELECT o_orderpriority AS setting, count(*) AS k FROM orders GROUP BY 1)
SELECT count(*) AS n_groups, (SELECT count(*) FROM lineitem) AS n_members, min(o_custkey) || '-' || max(o_custkey) AS "range", CAST(sum(o_shippriority) AS BIGINT) AS total, count(DISTINCT o_orderstatus) AS n_distinct,
round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 6) AS "pct_1-URGENT", round(100.0 * count(*) FILTER (WHERE o_orderpriority = 'none') / count(*), 6) AS pct_none, round(avg(o_totalprice), 4) AS price_pooled FROM (SELECT *, o_orderkey % 9 AS o_shippriority FROM orders)""")
def summary_row(spark, d):
    o = table(spark, d, "orders").withColumn("part", F.col("o_orderkey") % 9).withColumn("one", F.lit(1.0))
    pooled = {"price": groups.weighted_mean_across_groups(o, "o_totalprice", "one")}
    out = tables.summary_row(o, _lines(spark, d), "o_custkey", "part", "o_orderstatus", "o_orderpriority", ["1-URGENT", "none"], pooled)
    return rounded(out.drop("price_ci_lo", "price_ci_hi"), "pct_1-URGENT", "pct_none").withColumn("price_pooled", F.round("price_pooled", 4))


KINDS_OF_A = """CASE o_custkey % 6 WHEN 0 THEN '["NA"]' WHEN 1 THEN '["x: 1", "NA"]' WHEN 2 THEN '0' WHEN 3 THEN '2' WHEN 4 THEN '" n/a "' ELSE '"' || o_orderpriority || '"' END"""
KINDS_OF_B = """CASE o_custkey % 5 WHEN 0 THEN '"NaN"' WHEN 1 THEN '12' WHEN 2 THEN 'null' WHEN 3 THEN '"' || o_orderstatus || '"' ELSE '""' END"""
FIELD_OF = "CASE o_orderkey % 3 WHEN 0 THEN 'ethnicity' WHEN 1 THEN 'ses' ELSE 'diagnosis' END"
BUCKET_OF = "CASE o_orderkey % 3 WHEN 1 THEN 'boolean' ELSE 'structured_string_array' END"


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 3 AS f, o_custkey % 6 AS i, o_custkey % 5 AS j, o_orderpriority, o_orderstatus FROM orders),
p AS (SELECT o_orderkey, CASE f WHEN 0 THEN 'ethnicity' WHEN 1 THEN 'ses' ELSE 'diagnosis' END AS field_name, CASE f WHEN 2 THEN 'structured_string_array' ELSE 'boolean' END AS bucket,
  CASE WHEN f = 0 OR (f = 1 AND i < 2) THEN CASE WHEN i IN (1, 3, 5) THEN 'true' ELSE 'false' END ELSE CASE i WHEN 0 THEN 'NA' WHEN 1 THEN 'x: 1~NA' WHEN 2 THEN '0' WHEN 3 THEN '2' WHEN 4 THEN ' n/a ' ELSE o_orderpriority END END AS a,
  CASE WHEN f < 2 THEN CASE WHEN j = 3 THEN 'true' ELSE 'false' END ELSE CASE j WHEN 0 THEN 'NaN' WHEN 1 THEN '12' WHEN 3 THEN o_orderstatus WHEN 4 THEN '' END END AS b FROM r)
SELECT * FROM p""")
def recoded_values(spark, d):
    pairs = table(spark, d, "orders").select("o_orderkey", F.expr(FIELD_OF).alias("field_name"), F.expr(BUCKET_OF).alias("bucket"), F.expr(KINDS_OF_A).alias("a"), F.expr(KINDS_OF_B).alias("b"))
    return recode.recoded(pairs)


@query("""SELECT 'status' AS field_name, o_orderkey, o_orderstatus AS llm_value, 'X' AS prior_value, '' AS adjudication, '' AS adjudicator_note FROM orders WHERE o_custkey % 4 = 0""")
def adjudication_queue(spark, d):
    o = table(spark, d, "orders")
    long = lambda x, y: o.select("o_orderkey", F.expr(f"stack(2, 'status', {x}, 'priority', {y})").alias("field_name", "value"))
    mapping = spark.createDataFrame([("status", "categorical", "A_reference"), ("priority", "identifier", "no")], "field_name string, bucket string, tier1_prior_extraction string")
    found = reports.disagreements(long("o_orderstatus", "o_orderpriority"), long("CASE WHEN o_custkey % 4 = 0 THEN 'X' ELSE o_orderstatus END", "'other'"), mapping, ["o_orderkey"])
    return recode.adjudication_queue(found, mapping, ["o_orderkey"])


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)
SELECT CAST(l_orderkey AS VARCHAR) AS cov_nr, CAST(l_linenumber AS VARCHAR) AS arm, l_returnflag || '~1' AS items, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END AS n, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS note FROM o""")
def wide_records(spark, d):
    # Lines are dealt first, so that none is sorted before its shuffle.
    rows = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").repartition("l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").cast("long").alias("q"))
    n = F.col("l_linenumber")
    values = {"items": F.concat(F.lit('["'), "flag", F.lit('", 1]')), "n": F.when(n % 2 == 0, F.col("q").cast("string")), "note": F.when(n % 3 == 0, "null").otherwise(F.concat(F.lit('"'), "flag", F.lit('"')))}
    cells = F.array(*[F.struct(F.lit(k).alias("field_name"), v.alias("value")) for k, v in values.items()])
    run = rows.select(F.col("l_orderkey").cast("string").alias("cov_nr"), n.cast("string").alias("arm"), F.posexplode(cells).alias("place", "c")).select("cov_nr", "arm", "place", "c.*").where("value IS NOT NULL")
    return run_files.wide_records(run, place="place").select("cov_nr", "arm", "items", "n", "note")
