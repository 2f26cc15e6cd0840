"""Registered queries of reviews, exports and reporting reach, with their SQL; importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from studygrid.operators import compare, groups, models, review, tables
from studygrid.queries import ORACLE_SQL, query, rounded, table
from studygrid.record_queries import _four_runs
from studygrid.sources import exports

ARMS = "WITH o AS (SELECT l_orderkey AS p, l_linenumber AS a, min(l_returnflag) AS f, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


def _reviewed_run(spark, d):
    """A run of all order lines, and reviewed rows that set a number, lengthen a list, and add a field."""
    # Lines are dealt first, so that none is sorted before its shuffle.
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").repartition("l_orderkey", "l_linenumber")
    arms = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.max("l_quantity").cast("long").alias("q"))
    cells = F.array(F.struct(F.lit("n").alias("field_name"), F.col("q").cast("string").alias("value")), F.struct(F.lit("items").alias("field_name"), F.concat(F.lit('["'), "f", F.lit(': 1"]')).alias("value")))
    run = arms.select(F.col("l_orderkey").cast("string").alias("cov_nr"), F.col("l_linenumber").cast("string").alias("arm"), F.inline(cells))
    o, p = table(spark, d, "orders"), F.col("o_orderkey")
    rows = [
        F.when(p % 3 == 0, F.struct(F.lit(0).alias("place"), F.lit("n").alias("category"), F.when(p % 2 == 0, "").otherwise("1").alias("arm"), F.concat(F.lit("q"), p.cast("string")).alias("proposed_fix"))),
        F.when(p % 6 == 0, F.struct(F.lit(1).alias("place"), F.lit("items").alias("category"), F.lit("").alias("arm"), F.lit("more").alias("proposed_fix"))),
        F.when(p % 5 == 0, F.struct(F.lit(2).alias("place"), F.lit("added").alias("category"), F.lit("").alias("arm"), F.lit('a "b"').alias("proposed_fix"))),
        F.when(p % 7 == 0, F.struct(F.lit(3).alias("place"), F.lit("n").alias("category"), F.lit("").alias("arm"), F.lit("not written").alias("proposed_fix"))),
    ]
    note = F.when(F.col("place") < 3, "fix to this").otherwise("expected")
    reviewed = o.select(p.cast("string").alias("paper_id"), F.inline(F.array_compact(F.array(*rows)))).withColumns({"message": F.lit("m"), "resolution_note": note})
    return run, reviewed


FIXED = """{arms}, fixed AS (
SELECT p, a, 'n' AS field_name, CAST(CAST(q AS BIGINT) AS VARCHAR) AS old_value, '"q' || p || '"' AS new_value FROM o WHERE p % 3 = 0 AND (p % 2 = 0 OR a = 1)
UNION ALL SELECT p, a, 'items', '["' || f || ': 1"]', '["' || f || ': 1","more"]' FROM o WHERE p % 6 = 0
UNION ALL SELECT p, a, 'added', NULL, '"a \\"b\\""' FROM o WHERE p % 5 = 0)""".format(arms=ARMS)


@query(f"{FIXED} SELECT CAST(p AS VARCHAR) AS cov_nr, CAST(a AS VARCHAR) AS arm, field_name, old_value, new_value, 'apply_reviewed:fixed' AS fix_rule FROM fixed")
def reviewed_audit(spark, d):
    run, reviewed = _reviewed_run(spark, d)
    return review.written_fixes(run, review.planned(reviewed))[1]


@query(f"""{FIXED}, run AS (SELECT p, a, 'n' AS field_name, CAST(CAST(q AS BIGINT) AS VARCHAR) AS value FROM o UNION ALL SELECT p, a, 'items', '["' || f || ': 1"]' FROM o)
SELECT CAST(coalesce(r.p, x.p) AS VARCHAR) AS cov_nr, CAST(coalesce(r.a, x.a) AS VARCHAR) AS arm, coalesce(r.field_name, x.field_name) AS field_name, coalesce(new_value, value) AS value FROM run r FULL JOIN fixed x ON r.p = x.p AND r.a = x.a AND r.field_name = x.field_name""")
def reviewed_run(spark, d):
    run, reviewed = _reviewed_run(spark, d)
    return review.written_fixes(run, review.planned(reviewed))[0]


@query("""WITH l AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_custkey % 4 = 0 THEN 'accepted' ELSE 'open' END AS status,
  CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 4 <> 0 THEN CASE o_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 0 END ELSE 0 END AS r FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS paper_id, CASE WHEN r = 0 THEN status WHEN r = 2 THEN 'rejected' WHEN r = 4 THEN 'fixed' ELSE 'accepted' END AS status,
CASE r WHEN 1 THEN 'Correct autofix.' WHEN 2 THEN 'Catastrophic error, needs rerun.' WHEN 3 THEN 'Manual check OK.' WHEN 4 THEN 'Fixed from proposed value.' WHEN 5 THEN 'Expected behaviour, no action needed.' WHEN 6 THEN 'Correct autofix (empty note).' END AS resolution,
CASE WHEN r = 4 THEN o_orderpriority WHEN r > 0 THEN '' END AS corrected_value FROM l""")
def reviewed_ledger(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    key = [F.col("o_orderkey").cast("string").alias("paper_id"), F.col("o_orderstatus").alias("category"), F.lit("m").alias("message")]
    ledger = o.select(*key, F.when(k % 4 == 0, "accepted").otherwise("open").alias("status"))
    note = F.element_at(F.array(*map(F.lit, ("Correct autofix", "RERUN it", "a manual check", "Fix to that", "as expected", "  ", "no idea"))), (k % 7 + 1).cast("int"))
    reviewed = o.where("o_orderkey % 3 = 0").select(*key, note.alias("resolution_note"), F.col("o_orderpriority").alias("proposed_fix"))
    return review.closed(ledger, review.planned(reviewed), "me").select("paper_id", "status", "resolution", "corrected_value")


@query("""WITH n AS (SELECT l_orderkey AS p, l_linestatus AS c, CASE WHEN l_orderkey % 4 = 0 THEN 'Manual check' WHEN l_orderkey % 4 = 1 THEN '' WHEN l_orderkey % 4 = 2 AND l_linenumber > 5 THEN 'other' ELSE 'Autofix to Moderate, yes' END AS note FROM lineitem),
k AS (SELECT p, c, count(DISTINCT note) AS notes, min(note) AS note FROM n GROUP BY 1, 2), l AS (SELECT o_orderkey AS p, o_orderstatus AS c, o_custkey % 3 = 0 AS done FROM orders WHERE o_orderkey % 7 <> 0),
u AS (SELECT k.*, l.done FROM k LEFT JOIN l ON k.p = l.p AND k.c = l.c WHERE notes = 1 AND note IN ('', 'Autofix to Moderate, yes'))
SELECT count(done) AS matched, count(*) FILTER (WHERE NOT done) AS applied, count(*) FILTER (WHERE done) AS already_resolved, count(*) FILTER (WHERE done IS NULL) AS not_found, (SELECT count(*) FROM k WHERE notes > 1) AS conflicts FROM u""")
def batch_review(spark, d):
    p, i = F.col("l_orderkey"), F.col("l_linenumber")
    note = F.when(p % 4 == 0, "Manual check").when(p % 4 == 1, "").when((p % 4 == 2) & (i > 5), "other").otherwise("Autofix to Moderate, yes")
    reviewed = table(spark, d, "lineitem").select(p.alias("paper_id"), F.col("l_linestatus").alias("category"), F.lit("").alias("message"), note.alias("resolution_note"))
    status = F.when(F.col("o_custkey") % 3 == 0, "fixed").otherwise("open")
    ledger = table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.col("o_orderstatus").alias("category"), F.lit("").alias("message"), status.alias("status"))
    return review.batch_review(ledger, reviewed, dry_run=True)[1]


@query("""SELECT CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS cov_nr, 'n' || c_nationkey % 3 AS disease, 'ERROR' AS severity, o_orderstatus AS category, CAST(o_orderkey AS VARCHAR) AS message, CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS auto_fixable, 'open' AS status, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'x' || o_orderkey END, '') AS proposed_fix
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_shippriority = 0 AND c_nationkey % 3 = 1""".replace("o_shippriority = 0 AND ", ""))
def findings_export(spark, d):
    o = table(spark, d, "orders")
    ledger = o.select(
        F.col("o_custkey").alias("paper_id"), F.lit("ERROR").alias("severity"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("message"), (F.col("o_orderstatus") == "F").alias("auto_fixable"), F.lit("open").alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).alias("fix_value"),
    )
    diseases = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), F.concat(F.lit("n"), (F.col("c_nationkey") % 3).cast("string")).alias("disease"))
    out = exports.exported_findings(review.numbered(ledger), diseases, disease="n1", severity="ERROR", status="open")
    return out.select("id", "cov_nr", "disease", "severity", "category", "message", "auto_fixable", "status", "proposed_fix")


@query("""WITH m AS (SELECT l_orderkey AS g, bool_or(l_linenumber = 5) AS a, bool_or(l_returnflag = 'R') AS b, bool_or(l_quantity > 45) AS c, bool_or(l_quantity > 45 OR l_discount > 0.09) AS e FROM lineitem GROUP BY 1),
r AS (SELECT o_totalprice AS w, coalesce(a, false) AS a, coalesce(b, false) AS b, coalesce(c, false) AS c, coalesce(e, false) AS e FROM orders LEFT JOIN m ON g = o_orderkey WHERE o_orderkey % 5 <> 0)
SELECT x.domain, count(*) FILTER (WHERE x.hit) AS groups, round(coalesce(sum(w) FILTER (WHERE x.hit), 0), 2) AS members, round(100.0 * count(*) FILTER (WHERE x.hit) / count(*), 6) AS groups_pct, round(100.0 * coalesce(sum(w) FILTER (WHERE x.hit), 0) / sum(w), 6) AS members_pct
FROM (SELECT w, unnest([{'domain': 'literacy', 'hit': a}, {'domain': 'digital', 'hit': b}, {'domain': 'income', 'hit': c}, {'domain': 'capital', 'hit': e}]) AS x FROM r) GROUP BY 1""")
def reporting_reach(spark, d):
    q, disc = F.col("l_quantity"), F.col("l_discount")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 5, 2).otherwise(0).alias("health_literacy"), (F.col("l_returnflag") == "R").alias("digital_literacy"), F.when(q > 45, q).alias("ses_income"), F.when(disc > 0.09, disc).alias("ses_living_situation"))
    weights = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    fields = {"literacy": ["health_literacy"], "digital": ["digital_literacy"], "income": ["ses_income"], "capital": ["ses_income", "ses_living_situation"]}
    out = groups.reporting_reach(rows, "l_orderkey", "o_totalprice", fields, weights)
    return rounded(rounded(out, "groups_pct", "members_pct"), "members", digits=2)


@query("""WITH c AS (SELECT l_returnflag AS model, l_linenumber = 7 AS skipped, l_linestatus = 'F' AS ok, l_quantity AS elapsed, l_partkey AS ti, l_suppkey AS too, l_linenumber AS cr FROM lineitem),
p AS (SELECT * FROM (VALUES ('A', 3.0, 15.0, 0.5), ('N', 1.0, NULL, NULL)) AS t(m, pi, po, pr))
SELECT count(*) AS calls, count(*) FILTER (WHERE NOT skipped) AS done, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE NOT skipped AND NOT ok) AS errors, round(sum(elapsed) FILTER (WHERE NOT skipped), 2) AS elapsed_s,
CAST(sum(ti) FILTER (WHERE NOT skipped) AS BIGINT) AS tokens_in, CAST(sum(too) FILTER (WHERE NOT skipped) AS BIGINT) AS tokens_out, round(sum((ti * coalesce(pi, 0) + too * coalesce(po, 0) + cr * coalesce(pr, 0)) / 1e6) FILTER (WHERE NOT skipped), 4) AS cost FROM c LEFT JOIN p ON m = model""")
def run_totals(spark, d):
    calls = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_linenumber") == 7).alias("skipped"), (F.col("l_linestatus") == "F").alias("ok"), F.col("l_quantity").cast("double").alias("elapsed_s"),
        F.col("l_partkey").cast("long").alias("tokens_in"), F.col("l_suppkey").cast("long").alias("tokens_out"), F.col("l_linenumber").cast("long").alias("cache_read"), F.lit(9).cast("long").alias("cache_write"),
    )
    prices = spark.createDataFrame([("A", 3.0, 15.0, 0.5, None), ("N", 1.0, None, None, None)], "model string, price_in double, price_out double, price_cache_read double, price_cache_write double")
    return rounded(rounded(tables.run_totals(calls, prices), "elapsed_s", digits=2), "cost", digits=4)


@query("""WITH c AS (SELECT l_linestatus AS cohort, l_returnflag AS variable, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT cohort, variable, round(sd / sqrt(n), 6) AS se, round(mean - 1.96 * sd / sqrt(n), 6) AS se_low, round(mean + 1.96 * sd / sqrt(n), 6) AS se_high, round(mean - 1.96 * sd, 6) AS sd_low, round(mean + 1.96 * sd, 6) AS sd_high FROM c""")
def cohort_bands(spark, d):
    cohorts = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("cohort"), F.col("l_returnflag").alias("variable")).agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"), F.count("*").alias("n"))
    return rounded(models.cohort_bands(cohorts).drop("mean", "sd", "n"), "se", "se_low", "se_high", "sd_low", "sd_high")


PADDED = "CASE WHEN length({0}) < {1} THEN rpad({0}, {1}, ' ') ELSE {0} END"


@query(f"""WITH d AS ({ORACLE_SQL["diff_pairs"]}), t AS (SELECT *, coalesce(value_a, 'None') AS x, coalesce(value_b, 'None') AS y FROM d)
SELECT paper_id, run_a, run_b, count(*) AS n, '## ' || run_a || ' vs ' || run_b || ' (' || count(*) || ' difference' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ')' || chr(10) || chr(10) || '| ' || rpad('ARM', 25, ' ') || ' | ' || rpad('FIELD', 35, ' ') || ' | ' || rpad(run_a, 25, ' ') || ' | ' || run_b || ' |' || chr(10)
|| '|' || repeat('-', 27) || '|' || repeat('-', 37) || '|' || repeat('-', 27) || '|' || repeat('-', 20) || '|' || chr(10)
|| string_agg('| ' || {PADDED.format("arm", 25)} || ' | ' || {PADDED.format("field", 35)} || ' | ' || {PADDED.format("x", 25)} || ' | ' || y || ' |', chr(10) ORDER BY arm, field) || chr(10) AS markdown FROM t GROUP BY paper_id, run_a, run_b""")
def diff_documents(spark, d):
    return exports.diff_documents(compare.diff_pairs(_four_runs(spark, d))).drop("document")
