import json

from pyspark.sql import functions as F

from studygrid.operators import checks, repair, tables


def categories(df):
    return sorted((r["paper_id"], r["arm"], r["category"]) for r in df.collect())


def test_checks_of_an_arm(spark):
    schema = "cov_nr string, arm string, n int, f int, m int, fp double, mp double, smoking array<string>, other array<string>, hba double, grade string, flag boolean, why string, nyha array<string>"
    rows = [
        ("1", "control", 10, 4, 6, 40.0, 60.0, ["Never: 4 (40%)", "Now: 6"], ["crp_mean: 3"], 7.4, "Mild", False, None, ["I"]),
        ("1", "group (a)", 10, 4, 5, 55.0, 60.0, ["Never: 4", "a|b: 1"], ["CRP_sd: 3", "what is: this", "comorbid_x1_pct: 3", "other: z"], 9.0, "Severe", True, "NA", ["NA"]),
        ("2", "treat1", 10, 4, 6, 40.0, 60.0, ["A: 8", "B: 4", "A 1%, B 2%"], None, None, None, None, None, None),
        ("3", None, None, None, None, None, None, None, [], None, "NA", None, None, []),
    ]
    df = spark.createDataFrame(rows, schema)
    c = F.col
    found = checks.collect(
        df, "cov_nr", "arm",
        [
            checks.arm_name(c("arm")), checks.shares(c("n"), c("f"), c("m"), c("fp"), c("mp")),
            checks.item_format("smoking", c("smoking")), checks.item_sum("smoking", c("smoking"), c("n"), "not smoking"),
            checks.item_prefixes(c("other"), ["crp_mean"]), checks.graded("hba1c_severity", c("hba"), c("grade")),
            checks.discussion({"needs_discussion_time": (c("flag"), c("why"))}), checks.missing_class("nyha", c("nyha"), c("flag").isNotNull()),
        ],
    )
    a = "group (a)"
    assert categories(found.where("paper_id <> '3'")) == sorted(
        [("1", a, x) for x in ("schema_arm_naming", "schema_arm_naming", "gender_math_count_sum", "gender_math_pct_mismatch", "gender_math_pct_mismatch", "gender_math_pct_sum", "array_format_pipe", "array_sum_count_low", "severity_prefix_casing", "severity_prefix_unknown", "hba1c_severity_mismatch", "needs_discussion_flag")]
        + [("2", "treat1", "array_format_comma"), ("2", "treat1", "array_sum_count_high")]
    )
    assert [r["category"] for r in found.where("paper_id = '3'").collect()] == ["schema_arm_naming"]
    fixes = {r["category"]: (r["fix_field"], r["fix_value"]) for r in found.where("fix_value is not null").collect()}
    assert fixes == {"array_sum_count_low": ("smoking", "not smoking: 5"), "severity_prefix_casing": ("CRP_sd", "crp_sd: 3"), "hba1c_severity_mismatch": ("hba1c_severity", "Moderate")}
    assert checks.collect(df.where("n < 0"), "cov_nr", "arm", [checks.arm_name(c("arm"))]).count() == 0


def test_checks_of_a_paper(spark):
    rows = [("1", "control", 5), ("1", "treat1", None), ("2", "treat1", 5), ("2", "treat2", 5), ("3", "control", 1), ("4", "control", 3), ("4", "usual", 3)]
    df = spark.createDataFrame(rows, "p string, arm string, days int")
    expected = spark.createDataFrame([("3", 2), ("2", 0), ("1", 2)], "p string, n_arms int")
    found = {(r["paper_id"], r["category"]) for r in checks.whole_paper(df, "p", "arm", ["days"], expected).collect()}
    assert found == {("1", "cross_arm_time"), ("2", "cross_arm_missing_control"), ("4", "cross_arm_missing_treat"), ("3", "arm_count_mismatch")}


def test_sentinel_tells_history(spark):
    df = spark.createDataFrame([("1", "a", ["NA"]), ("2", "a", ["NA"]), ("3", "a", ["NA"]), ("4", "a", ["x"]), ("5", "a", None)], "p string, arm string, dx array<string>")
    old = spark.createDataFrame([("1", "v1", ["NA"]), ("1", "v2", ["NA"]), ("2", "v1", None), ("2", "v2", ["COPD"])], "p string, version string, dx array<string>")
    found = {r["paper_id"]: r["message"] for r in checks.sentinel(df, "p", "arm", "dx", old).collect()}
    assert found == {"1": "dx is NA; so in 2 prior runs", "2": "dx is NA; run v2 had it", "3": "dx is NA"}


def long(spark, rows):
    return spark.createDataFrame([(p, a, k, json.dumps(v)) for p, a, k, v in rows], "cov_nr string, arm string, field_name string, value string")


def test_fields_of_a_run(spark):
    run = long(spark, [("1", "a", "n", 5), ("1", "a", "_m", {}), ("1", "a", "zz", True), ("1", "a", "flag", "yes"), ("1", "a", "list", "NA"), ("2", "a", "n", "5"), ("2", "a", "list", 3), ("2", "a", "flag", None)])
    assert {(r["paper_id"], r["category"], r["message"]) for r in checks.field_sets(run, ["n", "list"], ["flag"]).collect()} == {("1", "schema_extra_field", "zz")}
    assert {(r["paper_id"], r["category"]) for r in checks.field_types(run, {"n": "number", "flag": "boolean", "list": "array"}).collect()} == {("1", "type_boolean"), ("2", "type_numeric"), ("2", "type_array")}


def test_arms_get_names(spark):
    df = spark.createDataFrame([("1", "treat2", 0), ("1", "Usual care", 1), ("1", "group b", 2), ("1", "group c", 3), ("2", "x", 0), ("2", None, 1)], "p string, arm string, pos int")
    found = {(r["p"], r["arm"]): r["new_arm"] for r in repair.rename_arms(df, "p", "arm", "pos").collect()}
    assert found == {("1", "treat2"): "treat2", ("1", "Usual care"): "control", ("1", "group b"): "treat3", ("1", "group c"): "treat4", ("2", "x"): "treat1", ("2", None): None}


def values(run):
    return {(r["cov_nr"], r["field_name"]): json.loads(r["value"]) for r in run.collect()}


def test_fields_get_names(spark):
    run = long(spark, [("1", "a", "ses_employment", ["x"]), ("1", "a", "ses_job_status", ["NA"]), ("2", "a", "ses_employment", ["x"]), ("2", "a", "ses_job_status", ["y"]), ("3", "a", "instrument_name", "q"), ("3", "a", "gender_intermediate_n", 1), ("3", "a", "ses_employment", ["NA"])])
    assert values(repair.rename_fields(run)) == {("1", "ses_job_status"): ["x"], ("2", "ses_employment"): ["x"], ("2", "ses_job_status"): ["y"], ("3", "health_literacy_instrument_name"): "q", ("3", "ses_employment"): ["NA"]}


def test_orphans_move_into_the_list(spark):
    run = long(spark, [("1", "a", "other", ["CRP: 1"]), ("1", "a", "crp", 1), ("1", "a", "six_minute", "50 m"), ("1", "a", "n", 3), ("2", "a", "crp", 1), ("2", "a", "other", "NA")])
    assert values(repair.fold_orphans(run, ["n"], "other")) == {("1", "other"): ["CRP: 1", "other: six_minute: 50 m"], ("1", "n"): 3, ("2", "crp"): 1, ("2", "other"): "NA"}


def test_fixes_and_audit(spark):
    run = long(spark, [("1", "a", "smoking", ["A: 1"]), ("1", "a", "sev", ["CRP_sd: 3", "CRP_sd: 4", "b: 1"]), ("1", "a", "days", 6.5), ("1", "b", "days", 6.5), ("2", "a", "grade", "Mild")])
    fixes = spark.createDataFrame(
        [("1", "a", "array_sum_count_low", "smoking", "none: 4"), ("1", "a", "severity_prefix_casing", "CRP_sd", "crp_sd: 3"), ("1", None, "type_integer", "days", "7"), ("2", "a", "hba1c_severity_mismatch", "grade", 'Mode"rate'), ("2", "a", "x", None, None)],
        "paper_id string, arm string, category string, fix_field string, fix_value string",
    )
    fixed, audit = repair.apply_fixes(run, fixes, "sev")
    got = {(r["cov_nr"], r["arm"], r["field_name"]): json.loads(r["value"]) for r in fixed.collect()}
    assert got == {("1", "a", "smoking"): ["A: 1", "none: 4"], ("1", "a", "sev"): ["crp_sd: 3", "crp_sd: 4", "b: 1"], ("1", "a", "days"): 7, ("1", "b", "days"): 7, ("2", "a", "grade"): 'Mode"rate'}
    assert audit.count() == 5 and fixed.columns == run.columns


def test_reviews(spark):
    ledger = spark.createDataFrame([("1", "c", "m", "ERROR", "open"), ("2", "c", "m", "ERROR", "accepted"), ("3", "c", "m", "ERROR", "open"), ("4", "c", "m", "ERROR", "open")], "paper_id string, category string, message string, severity string, status string")
    notes = [("1", "please rerun"), ("2", "Ignore"), ("3", "rerun"), ("3", "ignore"), ("4", "hm"), ("5", None)]
    reviewed = spark.createDataFrame([(p, "c", "m", n) for p, n in notes], "paper_id string, category string, message string, resolution_note string")
    after, outcome = repair.apply_review(ledger, reviewed)
    assert {r["paper_id"]: r["status"] for r in after.collect()} == {"1": "rejected", "2": "accepted", "3": "open", "4": "open"}
    assert {r["outcome"]: r["n"] for r in outcome.collect()} == {"applied": 1, "already_resolved": 1, "conflict": 1, "undecided": 1, "not_found": 1}
    by = spark.createDataFrame([("Rerun it",), ("Manual check x",), (" ",), ("?",)], "n string").select(repair.decision_by_prefix(F.col("n"), [("Rerun", "rejected")]).alias("d"))
    assert [r["d"] for r in by.collect()] == ["rejected", None, "accepted", None]


def test_quarantine_and_rerun(spark):
    files = spark.createDataFrame([("1", 2), ("2", 1), ("3", None), ("4", 3)], "paper_id string, n_arms int")
    findings = spark.createDataFrame([("4", "ERROR")] * 5 + [("1", "ERROR")] * 4, "paper_id string, severity string")
    assert {r["paper_id"]: r["action"] for r in repair.quarantine(files, findings).collect()} == {"2": "back_up", "3": "delete", "4": "back_up"}
    health = tables.run_health(spark.createDataFrame([("1",), ("9",)], "paper_id string"), files, findings).first()
    assert tuple(health) == (2, 1, 1, 1, 1)
    left = [3, 1, 0, 0]
    assert repair.rerun(lambda i: None, lambda: left.pop(0), 5) == 3


def test_report_tables(spark):
    df = spark.createDataFrame([("none", "rule_misapplication"), ("hallucinated_value", None), ("none", "none")], "a string, b string")
    got = {r["error_type"]: tuple(r)[1:] for r in tables.error_summary(df, ["a", "b"]).collect()}
    assert got == {"no_error": (3, 60.0, 1, 3), "minor_error": (1, 20.0, 1, 3), "major_error": (1, 20.0, 1, 3), "any_error": (2, 200 / 3, 2, 3)}
    assert {r["field"]: tuple(r)[1:] for r in tables.error_fields(df, ["a", "b"]).collect()} == {"a": (2, 0, 1, 1, 3), "b": (1, 1, 0, 1, 2)}
    flags = spark.createDataFrame([(False, True), (True, False), (True, None)], "x boolean, y boolean")
    assert {tuple(r) for r in tables.prevalence(flags, ["x", "y"]).collect()} == {("x", 2, 1, 2 / 3), ("y", 1, 1, 0.5)}
    assert {tuple(r) for r in tables.combinations(flags.where("y is not null"), ["x", "y"]).collect()} == {(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)}
    assert [r["n"] for r in tables.histogram(spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,)], "v double"), "v", 0, 10, 2).orderBy("bin").collect()] == [1, 2]
    assert [tuple(r) for r in tables.characteristics(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "x int, c string"), ["x"], ["c"]).collect()] == [("n", "3"), ("x", "2.00 (1.00 to 3.00)"), ("c", "b (2), a (1)")]
    report = tables.json_report(spark.createDataFrame([("1", "ERROR"), ("2", "WARNING"), ("2", "INFO")], "paper_id string, severity string"), spark.createDataFrame([("1",), ("2",), ("3",)], "paper_id string"), {"run": "r"}).first()
    assert json.loads(report["report"]) == {"run": "r", "counts": {"ERROR": 1, "WARNING": 1, "INFO": 1}, "papers_with_errors": ["1"], "papers_with_warnings": ["2"], "clean_papers": ["3"]}


def test_rename_arms_sorts_once(spark):
    df = spark.createDataFrame([("1", "treat2", 1), ("1", "new", 2)], "p string, arm string, pos int")
    out = repair.rename_arms(df, "p", "arm", "pos")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1 and out.where("arm = 'new'").first()["new_arm"] == "treat3"
