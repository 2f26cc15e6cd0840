import json

import pytest

from studygrid.operators import catalogue as c

RULES = {
    "copd": {
        "required": ["cov_nr", "arm", "n", "days", "flag", "grade", "items"], "numeric": {"n": (1, 100, True), "time_total_days": (0, None, True)}, "boolean": ["flag"],
        "enum": {"grade": [1, 2, 3]}, "text_enum": {"sure": ["high", "low"]}, "array": ["items"], "above": [("sys", "dia")], "below": [("sd", "n")], "sum": [("a", "b", "ab")],
    },
    "dm": {"required": ["cov_nr"], "numeric": {"n": (1, 5, False)}},
}


def findings(spark, *files):
    df = spark.createDataFrame([(p, d, t if isinstance(t, str) else json.dumps(t)) for p, d, t in files], "paper_id string, disease string, text string")
    return sorted((r["paper_id"], r["arm"] or "", r["severity"], r["category"], r["fix_value"] or "", r["prompt_version"]) for r in c.validate_files(df, c.compiled(spark, RULES)).collect())


def record(**more):
    return {"cov_nr": "1", "arm": "control", "n": 10, "days": 1, "flag": True, "grade": 1, "items": ["x: 1"]} | more


def test_structure(spark):
    got = findings(spark, ("1", "copd", {"arm": "control"}), ("2", "copd", "[1, null, \"x\"]"), ("3", "dm", "[not json"), ("4", "dm", []), ("5", "dm", "null"))
    assert got == [("1", "", "ERROR", "schema_not_list", "", ""), ("2", "index_0", "ERROR", "schema_not_dict", "", ""), ("2", "index_1", "ERROR", "schema_not_dict", "", ""), ("2", "index_2", "ERROR", "schema_not_dict", "", ""), ("5", "", "ERROR", "schema_not_list", "", "")]


CASES = [
    ({}, []),
    ({"n": None, "flag": "NA", "grade": [], "items": "NA"}, []),
    ({"days": "drop"}, [("schema_missing_field", "")]),
    ({"cov_nr": 99}, [("schema_cov_nr_mismatch", "")]),
    ({"flag": "yes", "grade": 4}, [("type_boolean", ""), ("type_enum", "")]),
    ({"grade": "2", "sure": "High"}, [("type_enum", "")]),
    ({"grade": 2.0, "sure": "low"}, []),
    ({"grade": True}, []),
    ({"grade": False, "sure": 1}, [("type_enum", ""), ("type_enum", "")]),
    ({"n": "10"}, [("type_numeric", "")]),
    ({"n": True}, [("type_numeric", "")]),
    ({"n": 10.5}, [("type_integer", "10")]),
    ({"n": 100.5}, [("range_violation", ""), ("type_integer", "100")]),
    ({"time_total_days": 62.5}, [("type_integer", "63")]),
    ({"n": 0}, [("range_violation", "")]),
    ({"items": "one"}, [("type_array", "")]),
    ({"items": None, "sys": 80, "dia": 80}, [("range_order", "")]),
    ({"sys": "80", "dia": 90, "sd": 10}, [("range_order", "")]),
    ({"a": 1, "b": 2.5, "ab": 5}, [("time_math", "")]),
    ({"a": 1, "b": 3, "ab": 5}, []),
    ({"gender_female_n": 4, "gender_male_n": 5}, [("gender_math_count_sum", "")]),
]


def test_rules_of_records(spark):
    files = [(str(i), "copd", [{k: v for k, v in ({"cov_nr": str(i)} | {k: v for k, v in record().items() if k != "cov_nr"} | more).items() if v != "drop"}]) for i, (more, _) in enumerate(CASES)]
    got = findings(spark, *files)
    for i, (more, want) in enumerate(CASES):
        assert sorted((x[3], x[4]) for x in got if x[0] == str(i) and x[3] != "schema_extra_field") == want, more


def test_stamp_arms_and_diseases(spark):
    one = record(extra=1, _metadata={"prompt_version": "v3", "study_info": {"n_arms": 3}}, time_total_days=30)
    two = record(arm="treat1 (x)", time_total_days=31)
    got = findings(spark, ("1", "copd", [one, two]), ("9", "dm", [{"cov_nr": "9", "arm": "b", "n": 7}]), ("8", "unknown", [{"cov_nr": "8", "arm": "control", "n": "x"}]))
    assert [x for x in got if x[0] == "1" and x[3] != "schema_extra_field"] == [("1", "", "ERROR", "arm_count_mismatch", "", "v3"), ("1", "", "ERROR", "cross_arm_time", "", "v3"), ("1", "treat1 (x)", "WARNING", "schema_arm_naming", "", "v3")]
    assert sorted(x[3] for x in got if x[0] == "9") == ["range_violation", "schema_arm_naming", "schema_extra_field", "schema_extra_field"]
    assert {x[3] for x in got if x[0] == "8"} == {"schema_extra_field"}  # no rule of an unknown disease
    with pytest.raises(ValueError):
        c.compiled(spark, {"x": {"required": [], "unheard": []}})


def test_rules_are_joined_once(spark):
    df = spark.createDataFrame([("1", "copd", "[]")], "paper_id string, disease string, text string")
    plan = c.rule_findings(c.records(df), c.compiled(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "Exchange hashpartitioning" not in plan


def test_disease_and_study_info(spark):
    rows = [("out/copd/1.json", {}), ("cvd/2.json", {}), ("out/dm_v8/3.json", {}), ("x/4.json", {"hba1c_pct_mean": 1, "hba1c_severity": "NA", "fev1_pct_mean": 2}), ("x/5.json", {"nyha_class": None}), ("x/6.json", {"fev1_pct_mean": 1}), ("x/7.json", {"hba1c_pct_mean": 1})]
    df = spark.createDataFrame([(p, json.dumps([r])) for p, r in rows], "path string, text string")
    found = c.records(df.selectExpr("path AS paper_id", "path", "'?' AS disease", "text"))
    assert {r[0]: r[1] for r in found.select("paper_id", c.detected_disease(found["paper_id"], found["record"])).collect()} == dict(zip([p for p, _ in rows], ["copd", "cvd", "dm", "dm", "cvd", "copd", None], strict=True))
    texts = [json.dumps([{"_metadata": {"study_info": {"n_arms": 2}}}]), "[]", "{bad", '[{"_metadata": 3}]', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(c.study_info(df["t"])).collect()] == ['{"n_arms":2}', "{}", "{}", "{}", "{}"]


def test_vocabulary(spark):
    words = spark.createDataFrame([("copd", "GOLD"), ("copd", "gold_stage"), ("copd", "mMRC"), ("dm", "x")], "disease string, word string")
    rows = [("GOLD_stage: 2", "case", "gold_stage"), ("gold: 1", "case", "GOLD"), ("goldx: 1", "similar", "GOLD"), ("GOLD_stages_a: 1", "similar", "gold_stage"), ("?!", "invalid", None), ("x: 1", "invalid", None), ("mMRC: 3", None, None), ("NA", None, None)]
    df = spark.createDataFrame([("1", "control", "copd", v) for v, *_ in rows], "paper_id string, arm string, disease string, value string")
    found = c.vocabulary_issues(df, words)
    assert {(r["value"], r["issue"], r["expected"]) for r in found.collect()} == {x for x in rows if x[1]}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_checks_of_records_are_compiled_and_objects_need_no_schema(spark):
    from pyspark.sql import functions as F

    from studygrid.operators import checks

    one = spark.range(1).select(checks.only((F.col("id") == 0, checks.finding("ERROR", "x", F.lit("m"), "f", 1)), (F.lit(None).cast("boolean"), checks.finding("ERROR", "y", F.lit("m")))).alias("f"))
    assert "lambda" not in one._jdf.queryExecution().optimizedPlan().toString() and [x["category"] for x in one.first()["f"]] == ["x"]
    files = spark.createDataFrame([("1", "dm", '[{"a": [1, {"b": 2}]}, 3, null]')], "paper_id string, disease string, text string")
    assert [r["kind"] for r in c.records(files).orderBy("position").collect()] == ["OBJECT", "BIGINT", "VOID"]
