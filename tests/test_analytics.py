import json
import math

import pytest
from pyspark.sql import functions as F

from studygrid.functions import values as v
from studygrid.functions.tdist import t_quantile, t_two_sided
from studygrid.operators import agreement, compare, groups, ledger, regression, rules
from studygrid.plans import reports
from studygrid.sources import runs
from studygrid.streaming.findings import follow, read_ledger


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arms(spark):
    rows = [(1, 65.0, 50, True, 1), (1, 66.0, 48, None, 2), (2, 70.0, 30, False, 2), (2, None, 30, True, 2), (3, 60.0, 20, None, None)]
    return spark.createDataFrame(rows, "g int, age double, n int, flag boolean, code int")


def test_weighted_means(spark):
    per = groups.weighted_mean_per_group(arms(spark), "age", "n", "g")
    assert {r["g"]: r["age"] for r in per.collect()} == {1: pytest.approx((65 * 50 + 66 * 48) / 98), 2: 70.0, 3: 60.0}
    df = spark.createDataFrame([(60.0, 10), (70.0, 30), (65.0, 20)], "x double, w int")
    r = groups.weighted_mean_across_groups(df, "x", "w").first()
    m = (600 + 2100 + 1300) / 60
    se = math.sqrt(sum(w * w * (x - m) ** 2 for x, w in ((60, 10), (70, 30), (65, 20))) / (2 / 3 * 3600))
    assert r["mean"] == pytest.approx(m) and r["se"] == pytest.approx(se) and r["ci_high"] == pytest.approx(m + t_quantile(0.975, 2) * se)
    empty = groups.weighted_mean_across_groups(df.where("x < 0"), "x", "w").first()
    assert empty["n"] == 0 and empty["mean"] is None and empty["ci_low"] is None
    single = groups.weighted_mean_across_groups(df.limit(1), "x", "w").first()
    assert single["n"] == 1 and single["se"] is None


def test_booleans_and_roll_up(spark):
    modal = {r["g"]: r["flag"] for r in groups.boolean_per_group(arms(spark), "flag", "g", "modal").collect()}
    assert modal == {1: True, 2: True, 3: None}
    any_ = {r["g"]: r["flag"] for r in groups.boolean_per_group(arms(spark), "flag", "g").collect()}
    assert any_ == {1: True, 2: True, 3: False}
    with pytest.raises(ValueError):
        groups.boolean_per_group(arms(spark), "flag", "g", "other")
    up = {r["g"]: r for r in groups.roll_up(arms(spark), "g", "n", ["age"], "code", {1: "Primary", 2: "Secondary"}).collect()}
    assert up[1]["label"] == "Mixed: Primary / Secondary" and up[1]["code"] is None
    assert up[2]["label"] == "Secondary" and up[2]["age_n_missing"] == 1 and up[2]["age"] == 70.0
    assert up[3]["label"] is None


def test_pooled_sd_needs_two(spark):
    df = spark.createDataFrame([(1, 2.0, 10), (1, 4.0, 20), (2, 3.0, 1)], "g int, sd double, n int")
    r = groups.pooled_sd(df, "sd", "n", "g").first()
    assert r["pooled_sd"] == pytest.approx(math.sqrt((9 * 4 + 19 * 16) / 28)) and r["n_members"] == 2 and r["n_groups"] == 1
    r = groups.pooled_sd(df.where("n = 20"), "sd", "n", "g").first()
    assert r["pooled_sd"] is None and r["n_groups"] == 0


def test_agreement_edges(spark):
    rows = [("f", "yes", "yes"), ("f", "yes", "no"), ("f", "yes", "no"), ("f", "no", "no"), ("same", "a", "a"), ("same", "a", "a")]
    r = {x["field"]: x for x in agreement.categorical(spark.createDataFrame(rows, "field string, a string, b string")).collect()}
    assert r["f"]["percent_agreement"] == 0.5 and r["f"]["ac1"] == pytest.approx(0.0) and r["same"]["ac1"] == 1.0 == r["same"]["kappa"]
    nums = [("eq", 1.0, 1.0), ("eq", 1.0, 1.0), ("one", 1.0, 2.0), ("na", None, None), ("na", None, 1.0), ("na", 1.0, 2.0), ("na", 3.0, 4.0)]
    r = {x["field"]: x for x in agreement.numerical(spark.createDataFrame(nums, "field string, a double, b double")).collect()}
    assert r["eq"]["icc"] == 1.0 and r["one"]["icc"] is None and r["one"]["sd_diff"] == 0.0 and r["na"]["na_concordance"] == 0.5
    assert one(spark, agreement.values_match(F.lit("66,2 %"), F.lit("66.205"))) and one(spark, agreement.values_match(F.lit(" A"), F.lit("a")))
    assert one(spark, agreement.token_f1(F.lit(""), F.lit(" "))) == 1.0 and one(spark, agreement.token_f1(F.lit("a"), F.lit(""))) == 0.0
    pairs = spark.sql("select 'f' field, array(named_struct('key','a','value','1'), named_struct('key','a','value','2')) a, array(named_struct('key','a','value','2.0'), named_struct('key','b','value','x')) b")
    r = agreement.structured(pairs).first()
    assert r["key_jaccard"] == 0.5 and r["value_agreement"] == 1.0
    f = agreement.flagged(spark.createDataFrame([(0.893,), (None,), (0.95,)], "icc double"), "icc", 0.9).collect()
    assert [x["reason"] for x in f] == ["icc=0.893 < 0.9", "icc undefined", None]


def test_normalising(spark):
    assert one(spark, v.numeric(F.lit("142,3 mmHg"))) == 142.3 and one(spark, v.numeric(F.lit("1,234"))) == 1.23 and one(spark, v.numeric(F.lit("none"))) is None
    assert one(spark, v.boolean(F.lit(" YES"))) is True and one(spark, v.boolean(F.lit("maybe"))) is None
    assert one(spark, v.free_text(F.lit("  Two  Words. ! "))) == "two words" and one(spark, v.basic_string(F.lit("  "))) is None
    assert [tuple(p) for p in one(spark, v.pairs_of_string(F.lit("smoking: 10~never: 20~x")))] == [("smoking", "10"), ("never", "20"), ("x", "")]
    assert one(spark, v.pairs_of_string(F.lit(" ~ "))) is None
    assert tuple(one(spark, v.label_count_percent(F.lit("GOLD 2: 12 (34.5%)")))) == ("GOLD 2", 12, 34.5) and one(spark, v.label_count_percent(F.lit("none"))) is None
    assert one(spark, v.is_na(F.lit(" n/a "))) and not one(spark, v.is_na(F.lit("N/a"))) and one(spark, v.is_na_list(F.array(F.lit("NA"))))
    named = {"Norway": "Europe", "Poland,Chile": "Multi-continent", "Narnia": "Other", " ": "Other", None: "Unknown", "Europe (Sweden and Norway)": "Europe", "Thailand and Taiwan": "Asia"}
    assert {x: one(spark, v.continent(F.lit(x).cast("string"))) for x in named} == named
    assert one(spark, v.bucket(F.lit(2014), [2005, 2014, 2019], ["a", "b"])) == "a" and one(spark, v.bucket(F.lit(2005), [2005, 2014], ["a"])) is None and one(spark, v.bucket(F.lit(2005), [2005, 2014], ["a"], True)) == "a"


def test_regression_and_t(spark):
    xs, ys = [1.0, 2.0, 3.0, 4.0, 5.0, 9.0], [2.1, 3.9, 6.2, 7.8, 10.1, 12.0]
    df = spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double")
    r = regression.with_inference(regression.fit_one(df, "y", "x")).first()
    n, mx, my = 6, sum(xs) / 6, sum(ys) / 6
    b = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    assert r["slope"] == pytest.approx(b) and r["p"] == pytest.approx(t_two_sided(r["t"], n - 2)) and r["ci_low"] < b < r["ci_high"]
    assert [x["influential"] for x in regression.cooks_distance(df, "y", "x").orderBy("x").collect()][-1]
    assert regression.spearman(df, "x", "y").first()["rho"] == pytest.approx(1.0)
    assert t_quantile(0.975, 10) == pytest.approx(2.228138851964939) and t_two_sided(2.228138851964939, 10) == pytest.approx(0.05)


def test_ranks_do_not_depend_on_a_shared_exchange(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000 / 2).alias("x"), F.floor(F.col("id") / 3).cast("double").alias("y"))
    try:
        for reuse, adaptive in (("false", "true"), ("false", "false"), ("true", "true")):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            assert tuple(regression._ranked(df, "x", "r").agg(F.count_distinct("r"), F.sum("r")).first()) == (60_000, 60_000 * 60_001 / 2)
            assert tuple(regression._ranked(df, "y", "r").agg(F.count_distinct("r"), F.sum("r")).first()) == (20_000, 60_000 * 60_001 / 2)
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_agreement_results_of_all_buckets(spark):
    def run(*rows):
        return spark.createDataFrame([(str(i), f, x) for i, (f, x) in enumerate(rows)], "paper string, field_name string, value string")

    mapping = spark.createDataFrame([("n", "numerical"), ("s", "structured_string_array"), ("t", "free_text"), ("z", "EXCLUDED"), ("e", "categorical")], "field_name string, bucket string")
    a = run(("n", "NA"), ("n", "n/a"), ("n", "3,1"), ("s", "a: 1~b: 2"), ("s", "a: 1"), ("t", "Caf\u00e9!"), ("z", "1"), ("e", ""))
    b = run(("n", "n/a"), ("n", "2"), ("n", "3.1"), ("s", "b: 2~a: 3"), ("s", "c: 1"), ("t", "cafe\u0301"), ("z", "2"), ("e", "x"))
    got = {r["field"]: r for r in reports.undersampled(reports.agreement_results(a, b, mapping, ["paper"], {"structured_string_array": (0.4, 0.9), "numerical": (0.5, None)})).collect()}
    assert [got["n"][x] for x in ("n_compared", "n_both_na", "n_one_na", "primary_value", "reason", "undersampled")] == [1, 1, 1, None, "icc_2_1 undefined", True]
    assert [got["s"][x] for x in ("primary_value", "secondary_value", "reason")] == [0.5, 0.5, "value_agreement_on_matched_keys=0.500 < 0.9"]
    assert got["t"]["primary_value"] == 1.0 and [got["z"][x] for x in ("n_compared", "primary_name", "flagged")] == [0, "excluded", False]
    assert [got["e"][x] for x in ("n_compared", "n_one_na", "flagged", "reason")] == [0, 1, False, "no comparable cases"]
    rows = {(r["field"], r["paper"]): r for r in reports.disagreements(a, b, mapping, ["paper"]).collect()}
    assert set(rows) == {("s", "3"), ("s", "4")} and rows["s", "3"]["mismatch"] == "a" and (rows["s", "4"]["only_in_a"], rows["s", "4"]["only_in_b"]) == (["a"], ["c"])
    with pytest.raises(Exception, match="Unknown bucket: odd"):
        reports.agreement_results(a, b, spark.createDataFrame([("n", "odd")], "field_name string, bucket string"), ["paper"], {}).collect()


def test_diff_of_runs(spark):
    a = spark.createDataFrame([("1", "t", "x", "1"), ("1", "t", "y", None), ("2", "t", "x", "1"), ("3", "c", "x", "1"), ("3", "t", "x", "1")], "cov_nr string, arm string, field_name string, value string")
    b = spark.createDataFrame([("1", "t", "x", "2"), ("1", "t", "y", None), ("3", "t", "x", "1"), ("4", "t", "_metadata", "z")], "cov_nr string, arm string, field_name string, value string")
    assert sorted((r["cov_nr"], r["arm"] or "", r["field"]) for r in compare.diff_runs(a, b, "cov_nr", "arm").collect()) == [("1", "t", "x"), ("2", "", "_status"), ("3", "c", "_status")]
    assert compare.diff_runs(a, a, "cov_nr", "arm").count() == 0
    assert compare.field_presence(a, b).where("presence = 'new'").count() == 1


def test_rules_and_ledger(spark):
    df = spark.createDataFrame([("1", "t", 5, 9, None), ("1", "c", 200, 3, "z")], "p string, a string, x int, y int, e string")
    found = rules.validate(df, [rules.Rule("x", "range", 0, 100), rules.Rule("x", "less", other="y"), rules.Rule("e", "required"), rules.Rule("e", "enum", allowed=("q",))], "p", "a")
    assert sorted((r["arm"], r["category"]) for r in found.collect()) == [("c", "range_order"), ("c", "range_violation"), ("c", "type_enum"), ("t", "schema_missing_field")]
    assert rules.cross_arm(df, "p", "a", "x").count() == 1
    old = spark.createDataFrame([("1", "k", "gone", "ERROR", "open"), ("1", "k", "done", "ERROR", "rejected"), ("9", "k", "other", "ERROR", "open")], "paper_id string, category string, message string, severity string, status string")
    now = spark.createDataFrame([("1", "k", "new", "WARNING"), ("1", "k", "done", "ERROR")], "paper_id string, category string, message string, severity string")
    after = ledger.sync(old, now, now.select("paper_id"))
    assert sorted((r["message"], r["status"]) for r in after.collect()) == [("done", "rejected"), ("new", "open"), ("other", "open")]
    said = spark.createDataFrame([("1", "k", "new", "fixed"), ("9", "k", "other", "fixed"), ("9", "k", "other", "rejected")], "paper_id string, category string, message string, decision string")
    assert sorted((r["message"], r["status"]) for r in ledger.resolve(after, said).collect()) == [("done", "rejected"), ("new", "fixed"), ("other", "open")]
    assert ledger.replace_by_key(old, old.limit(1), "paper_id").count() == 2


def test_sources(spark, tmp_path):
    path = tmp_path / "run.jsonl"
    path.write_text(json.dumps({"cov_nr": "0001", "arm": "t", "age": 65.5, "ses": False, "needs_discussion_x": True}) + "\n\n" + json.dumps([{"cov_nr": "0002", "arm": "c", "list": ["a: 1"], "none": None}]) + "\n")
    got = {(r["cov_nr"], r["field_name"]): r["value"] for r in runs.read_run(spark, str(path)).collect()}
    assert got[("0001", "age")] == "65.5" and got[("0001", "ses")] == "false" and json.loads(got[("0002", "list")]) == ["a: 1"] and len(got) == 4
    (tmp_path / "bad.jsonl").write_text('{"arm": "t", "x": 1}\n')
    with pytest.raises(Exception, match="cov_nr"):
        runs.read_run(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "map.csv").write_text("field_name,bucket\na,x\na,y\n")
    with pytest.raises(ValueError):
        runs.read_mapping(spark, str(tmp_path / "map.csv"))
    (tmp_path / "cohort.csv").write_text('# note\nvariable,n,mean,sd,note\nage,10,"63,4","7,1",x\n')
    assert runs.read_cohort(spark, str(tmp_path / "cohort.csv"), "E").first()["mean"] == 63.4
    (tmp_path / "look.csv").write_text("﻿Cov nr;Year;Country\n#157 ;2010;UK \n#158;x;USA\n")
    assert [tuple(r) for r in runs.read_lookup(spark, str(tmp_path / "look.csv")).collect()] == [(157, 2010, "UK"), (158, None, "USA")]
    (tmp_path / "copd").mkdir()
    (tmp_path / "copd" / "#0464_x.md").write_text("text")
    r = runs.read_papers(spark, str(tmp_path / "copd")).first()
    assert r["disease"] == "copd" and r["cov_nr"] == "0464"


def test_agreement_report(spark):
    run = spark.createDataFrame([("1", "t", "n", "5,0"), ("2", "t", "n", "7"), ("1", "t", "c", "x"), ("2", "t", "c", "y")], "cov_nr string, arm string, field_name string, value string")
    mapping = spark.createDataFrame([("n", "numerical"), ("c", "categorical")], "field_name string, bucket string")
    got = {r["field"]: r for r in reports.agreement_results(run, run, mapping, ["cov_nr", "arm"], {"numerical": (0.9, 0.9)}).collect()}
    assert got["n"]["primary_value"] == pytest.approx(1.0) and got["c"]["primary_value"] == got["c"]["kappa"] == 1.0
    assert got["n"]["kappa"] is None and got["n"]["reason"] is None and not got["n"]["flagged"]
    # Without a key in common there is no agreement of values.
    items = lambda x: spark.createDataFrame([("1", "t", "s", x)], "cov_nr string, arm string, field_name string, value string")
    one = reports.agreement_results(items("x: 1"), items("y: 1"), spark.createDataFrame([("s", "structured_string_array")], "field_name string, bucket string"), ["cov_nr", "arm"], {"structured_string_array": (0.0, 0.9)}).first()
    assert one["reason"] == "value_agreement_on_matched_keys undefined" and one["flagged"]


def test_stream_of_findings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"p": "1", "a": "t", "x": 500}\n')
    args = (spark, str(tmp_path / "in"), "p string, a string, x int", str(tmp_path / "ledger"), str(tmp_path / "check"), [rules.Rule("x", "range", 0, 100)], "p", "a")
    follow(*args).awaitTermination(60)
    (tmp_path / "in" / "b.json").write_text('{"p": "1", "a": "t", "x": 50}\n{"p": "2", "a": "t", "x": -1}\n')
    follow(*args).awaitTermination(60)
    last = read_ledger(spark, str(tmp_path / "ledger"))
    assert [(r["paper_id"], r["status"]) for r in last.collect()] == [("2", "open")]


def test_entry_imports_without_the_corpus_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "studygrid"), tmp_path / "studygrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    env = {**os.environ, "PYTHONPATH": ""}
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), [k for k in q if k.startswith('op') and k[2].isdigit()], 'pipeline' in q)"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip().endswith("[] False"), out.stderr
