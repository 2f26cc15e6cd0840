import csv
import glob
import json

from pyspark.sql import functions as F

from studygrid import dealing
from studygrid.operators import compare, groups, review
from studygrid.sources import exports, sheets
from studygrid.sources import runs as run_files

RUN = [
    ("1", "control", "n", "10"), ("1", "control", "smoking_status", '["Never: 4"]'), ("1", "control", "age_mean", "40.5"), ("1", "control", "diagnosis", '["a", 1]'),
    ("1", "treat1", "n", "12"), ("1", "treat1", "smoking_status", '"NA"'), ("2", "control", "n", "7"),
]
REVIEWED = [
    (0, "1", "array_sum_count_low", "low", "control", "Fix to this", "Now: 6"), (1, "1", "array_sum_count_low", "low", "treat1", "proposed fix", "Now: 1"),
    (2, "1", "age_mean", "m1", "control", "fix to", "41"), (3, "1", "age_mean", "m1", "control", "fix to", "42"), (4, "1", "diagnosis", "m2", "", "FIX TO", 'b "c"'),
    (5, "1", "n", "m3", "control", "please rerun", "99"), (6, "2", "n", "m4", None, None, ""), (7, "2", "n", "m5", None, "no idea", "8"),
    (8, "9", "n", "m6", None, "expected", None), (9, None, "n", "m7", None, "expected", None),
]
LEDGER = [("1", "array_sum_count_low", "low", "WARNING", "open"), ("1", "age_mean", "m1", "ERROR", "open"), ("1", "n", "m3", "ERROR", "open"), ("1", "diagnosis", "m2", "ERROR", "accepted"), ("2", "n", "m4", "INFO", "open"), ("2", "n", "m5", "INFO", "open"), ("9", "n", "m6", "INFO", "open")]


def tables(spark):
    return (
        spark.createDataFrame(LEDGER, "paper_id string, category string, message string, severity string, status string"),
        spark.createDataFrame(RUN, "cov_nr string, arm string, field_name string, value string"),
        spark.createDataFrame(REVIEWED, "place int, paper_id string, category string, message string, arm string, resolution_note string, proposed_fix string"),
    )


def test_review_writes_proposed_fixes(spark):
    ledger, run, reviewed = tables(spark)
    new_ledger, new_run, audit, summary = review.apply_reviewed(ledger, run, reviewed)
    values = {(r["cov_nr"], r["arm"], r["field_name"]): json.loads(r["value"]) for r in new_run.collect()}
    assert values == {
        ("1", "control", "n"): 10, ("1", "control", "smoking_status"): ["Never: 4", "Now: 6"], ("1", "control", "age_mean"): "42", ("1", "control", "diagnosis"): ["a", 1, 'b "c"'],
        ("1", "treat1", "n"): 12, ("1", "treat1", "smoking_status"): "NA", ("1", "treat1", "diagnosis"): 'b "c"', ("2", "control", "n"): 7,
    }
    assert sorted((r["arm"], r["field_name"], r["fix_rule"]) for r in audit.collect()) == [("control", x, "apply_reviewed:fixed") for x in ("age_mean", "diagnosis", "smoking_status")] + [("treat1", "diagnosis", "apply_reviewed:fixed")]
    found = {(r["paper_id"], r["message"]): (r["status"], r["resolution"], r["corrected_value"]) for r in new_ledger.collect()}
    assert found == {
        ("1", "low"): ("fixed", "Fixed from proposed value.", "Now: 6"), ("1", "m1"): ("fixed", "Fixed from proposed value.", "41"), ("1", "m3"): ("rejected", "Catastrophic error, needs rerun.", ""),
        ("1", "m2"): ("accepted", None, None), ("2", "m4"): ("open", None, None), ("2", "m5"): ("open", None, None), ("9", "m6"): ("open", None, None),
    }
    assert summary.first().asDict() == {"total_rows": 10, "papers_affected": 3, "papers_missing": 1, "findings_resolved": 3, "values_fixed": 4}
    same_ledger, same_run, would, counts = review.apply_reviewed(ledger, run, reviewed, dry_run=True)
    assert same_ledger is ledger and same_run is run
    assert would.count() == 4 and counts.first() == summary.first()


def test_review_of_empty_tables(spark):
    ledger, run, reviewed = tables(spark)
    new_ledger, new_run, audit, summary = review.apply_reviewed(ledger.limit(0), run, reviewed.limit(0))
    assert (new_ledger.count(), new_run.count(), audit.count()) == (0, len(RUN), 0)
    assert sum(summary.first()) == 0


def test_batch_review(spark):
    ledger, _, _ = tables(spark)
    notes = [("1", "age_mean", "m1", "Autofix to Moderate, as said"), ("1", "n", "m3", "a"), ("1", "n", "m3", "b"), ("1", "diagnosis", "m2", ""), ("2", "n", "m4", None), ("2", "n", "m5", "Manual check"), ("7", "n", "x", "Minor miss, manual check.")]
    reviewed = spark.createDataFrame(notes, "paper_id string, category string, message string, resolution_note string")
    done, counts = review.batch_review(ledger, reviewed)
    assert counts.first().asDict() == {"matched": 3, "applied": 2, "already_resolved": 1, "not_found": 1, "conflicts": 1}
    assert {(r["message"], r["resolution"]) for r in done.where("reviewer = 'batch'").collect()} == {("m1", "Autofix to Moderate."), ("m4", "Correct autofix.")}
    dry, again = review.batch_review(ledger, reviewed, dry_run=True)
    assert dry is ledger and again.first() == counts.first()
    assert [r["id"] for r in review.open_findings(review.numbered(ledger), "1").collect()] == [1, 2, 4]


def test_findings_export(spark, tmp_path):
    ledger, _, _ = tables(spark)
    diseases = spark.createDataFrame([("1", "copd"), ("2", "dm")], "paper_id string, disease string")
    path = str(tmp_path / "findings")
    exports.write_findings_csv(ledger.withColumn("auto_fixable", F.col("paper_id") == "1").withColumn("fix_value", F.lit('x, "y"')), path, diseases=diseases, disease="copd", severity="ERROR")
    rows = [r for f in glob.glob(path + "/part-*") for r in csv.DictReader(open(f))]
    assert sorted((r["cov_nr"], r["disease"], r["category"], r["auto_fixable"], r["id"], r["proposed_fix"]) for r in rows) == [("1", "copd", c, "True", "", 'x, "y"') for c in ("age_mean", "diagnosis", "n")]
    assert list(rows[0]) == list(exports.FINDING_COLUMNS)
    all_ = {(r["cov_nr"], r["disease"]) for r in exports.exported_findings(ledger, diseases).collect()}
    assert all_ == {("1", "copd"), ("2", "dm"), ("9", "")}
    assert exports.fixed_columns(ledger, ["status", "nothing", "paper_id"]).columns == ["status", "nothing", "paper_id"]


def test_diff_documents(spark):
    rows = [("A", "1", "control", "n", "1"), ("B", "1", "control", "n", "2"), ("A", "1", "control", "m", "1"), ("B", "1", "treat1", "n", "2")]
    runs = spark.createDataFrame(rows, "run string, paper_id string, arm string, field_name string, value string")
    one = exports.diff_documents(compare.diff_pairs(runs)).first()
    assert json.loads(one["document"]) == [
        {"arm": "control", "field": "m", "value_a": "1", "value_b": None}, {"arm": "control", "field": "n", "value_a": "1", "value_b": "2"}, {"arm": "treat1", "field": "_status", "value_a": "missing", "value_b": "present"},
    ]
    lines = one["markdown"].split("\n")
    assert lines[0] == "## A vs B (3 differences)" and lines[2] == f"| {'ARM':<25} | {'FIELD':<35} | {'A':<25} | B |"
    assert f"| {'treat1':<25} | {'_status':<35} | {'missing':<25} | present |" in lines


def test_results_discovered(spark, tmp_path):
    for folder, names in {"copd": ("1", "x"), "copd_v9": ("2",), "copd_v11": ("1", "3", "note"), "copd_v11_rerun1": ("5",), "dm_v2": ("1",), "other": ("8",)}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.json").write_text("[]")
    found = sheets.read_results(spark, str(tmp_path))
    pick = lambda **k: sorted((r["folder"].rsplit("/", 1)[1], r["paper_id"]) for r in sheets.discovered(found, **k).collect())
    assert pick() == [("copd", "1"), ("copd", "x"), ("copd_v11", "1"), ("copd_v11", "3"), ("copd_v11", "note"), ("dm_v2", "1")]
    assert pick(disease="dm") == [("dm_v2", "1")]
    assert pick(output_version="v11_rerun1") == [("copd_v11_rerun1", "5")]
    assert pick(disease="copd", paper="1") == [("copd", "1"), ("copd_v11", "1")]
    assert sorted(map(tuple, sheets.disease_map(found).collect())) == [("1", "dm"), ("3", "copd")]


def test_folders_and_cohorts(spark, tmp_path):
    import pytest

    (tmp_path / "copd").mkdir()
    (tmp_path / "copd" / "#1234_a.md").write_text("text")
    assert [(r["disease"], r["cov_nr"]) for r in run_files.read_papers(spark, str(tmp_path / "copd"), ("copd", "dm")).collect()] == [("copd", "1234")]
    with pytest.raises(Exception, match="unknown disease: copd"):
        run_files.read_papers(spark, str(tmp_path / "copd"), ("dm",)).collect()
    (tmp_path / "a.csv").write_text('# made\nvariable,n,mean,sd,note\nage_years,10,"63,4","7,1",x\n\n')
    found = run_files.read_cohorts(spark, str(tmp_path), {"A": "a.csv", "B": "b.csv"})
    assert [tuple(r) for r in found.collect()] == [("A", "age_years", 10, 63.4, 7.1, "x")]
    assert run_files.read_cohorts(spark, str(tmp_path), {"B": "b.csv"}).count() == 0
    assert run_files.schema_hash(found) == run_files.schema_hash(found.select(*reversed(found.columns))) != run_files.schema_hash(found.drop("n"))


def test_keys_by_side(spark):
    kind = "array<struct<key:string,value:string>>"
    rows = spark.createDataFrame([("f", [("b", "1"), ("a", "1")], [("c", "2")]), ("f", [("a", "3")], None), ("g", None, [])], f"field string, a {kind}, b {kind}")
    found = {(r["field"], r["side"]): (r["keys"], r["n_keys"], r["n_known"]) for r in groups.key_audit_by_side(rows, "field", {"A": "a", "B": "b"}).collect()}
    assert found == {("f", "A"): ("a; b", 2, 2), ("f", "B"): ("c", 1, 1), ("g", "A"): ("", 0, 0), ("g", "B"): ("", 0, 1)}


def test_diff_documents_have_no_lambda(spark):
    diffs = spark.createDataFrame([("1", "a", "b", "t", "f", None, "y"), ("1", "a", "b", None, "f", "x", "y")], "paper_id string, run_a string, run_b string, arm string, field string, value_a string, value_b string")
    out = exports.diff_documents(diffs)
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first()["document"] == '[{"arm":null,"field":"f","value_a":"x","value_b":"y"},{"arm":"t","field":"f","value_a":null,"value_b":"y"}]'


def test_fixes_shuffle_values_once(spark, monkeypatch):
    """Run and audit have one exchange of values and one of fixes, both to the counted tasks; an arm without any fix, repeated fields and unknown papers stay."""
    monkeypatch.setattr(dealing, "SMALL", 2)
    run = spark.createDataFrame([("1", "a", "n", "5"), ("1", "a", "n", "6"), ("1", "b", "k", "true"), ("1", None, "n", "1"), (None, "a", "n", "7"), ("2", "a", "n", "8"), ("3", "a", None, "9")], "cov_nr string, arm string, field_name string, value string")
    plan = spark.createDataFrame([("1", "n", "", "a", 0, "x", "fixed", "r", True), ("1", "n", "", "", 1, "y", "fixed", "r", True), ("3", "n", "", "", 0, "z", "fixed", "r", True), ("9", "n", "", "", 0, "z", "fixed", "r", True)], "paper_id string, category string, message string, arm string, place long, proposed string, status string, resolution string, apply_fix boolean")
    new, audit = review.written_fixes(run, plan)
    for df in (new, audit):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange ") == text.count("REPARTITION_BY_NUM") == 2
    y = '"y"'
    assert sorted(map(tuple, new.collect()), key=str) == sorted([("1", "a", "n", y), ("1", "a", "n", y), ("1", "b", "k", "true"), ("1", "b", "n", y), ("1", None, "n", y), (None, "a", "n", "7"), ("2", "a", "n", "8"), ("3", "a", None, "9"), ("3", "a", "n", '"z"')], key=str)
    assert sorted(tuple(r)[:5] for r in audit.where("arm is not null").collect() if r["old_value"]) == [("1", "a", "n", "5", y), ("1", "a", "n", "6", y)]
