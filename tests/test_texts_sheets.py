import json
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from studygrid.functions import texts
from studygrid.sources import sheets


def each(spark, inputs, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, t string")
    return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tables_typed_as_prose(spark):
    cases = {
        None: ["NA"], "": ["NA"], "n/a": ["NA"], "NA (see text)": ["NA"], "Male 4 (60%)\nna here": ["NA"], "Only words": ["NA"],
        "Education (year) 8.6+/-3.2": ["Mean years: 8.6 (SD 3.2)"],
        "Level of education (imputed, 0 = none)\n0,72 (SE 0.061)": ["Mean years: 0.72 (SE 0.061)"],
        "Primary, n (%) 45 (60,5)": ["Primary: 45 (60.5%)"], "Primary n(%) 45": ["Primary: 45"],
        "White 90,5% (n46)": ["White: 46 (90.5%)"], "Male 45 (60%)": ["Male: 45 (60%)"], "Male 45 (60.1)": ["Male: 45 (60.1%)"], "White 90%": ["White: 90%"],
        "Primary: 5\nGroup 2: none": ["Primary: 5"], "Top\nGroup 2: none\n3 (4)": ["Top: 3 (4%)"],
        "School\n12 (34,5)\n7 (20%)": ["School: 12 (34,5%)", "?: 7 (20%)"], "12 (3)": ["?: 12 (3%)"],
        "Years of education (all) 11.09 (2.23)": ["Mean years: 11.09 (SD 2.23)"],
        "Grade 3": ["Grade 3:"],
    }
    got = dict(zip(cases, each(spark, list(cases), texts.prior_items), strict=True))
    assert got == cases


def test_records_of_answers(spark):
    cases = ['{"a": 1}', '[{"a": 1}, {"b": 2}]', '```json\n[{"a": 1}]\n```', '```\n{"a": 1}\n```', 'x {"a": {"b": 1}} y } {"c": 2} {bad} z', "", "prose", None]
    got = [[json.loads(r) for r in x] for x in each(spark, cases, texts.records)]
    assert got == [[{"a": 1}], [{"a": 1}, {"b": 2}], [{"a": 1}], [{"a": 1}], [{"a": {"b": 1}}, {"c": 2}], [], [], []]


def test_small_texts(spark):
    plain = unicodedata.normalize("NFD", "café")
    assert each(spark, [plain, "abc", None], texts.composed) == ["café", "abc", None]
    assert [tuple(x) for x in each(spark, ["a -> b->c", "a"], texts.with_note)] == [("a", "b->c"), ("a", "")]
    df = spark.createDataFrame([("number", "3.0"), ("number", "3.5"), ("boolean", "True"), ("string", " A  b "), ("string", "NA")], "k string, t string")
    assert [r["x"] for r in df.select(texts.categorical(F.col("k"), F.col("t")).alias("x")).collect()] == ["3", "3.5", "true", "A b", None]
    keys = spark.createDataFrame([(None,), (["COPD II"],), (["COPD", "ILD"],)], "k array<string>")
    assert [r["x"] for r in keys.select(texts.diagnosis_class(F.col("k")).alias("x")).collect()] == ["Unknown", "COPD only", "COPD + other"]


def book(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    fill = lambda inner: f'<fill><patternFill patternType="solid">{inner}</patternFill></fill>'
    fills = fill("") + fill("") + fill('<fgColor rgb="FFC6EFCE"/>') + fill('<fgColor rgb="FFFFEB9C"/>') + fill('<fgColor rgb="FFFFC7CE"/>') + fill('<fgColor theme="9"/>')
    xfs = "".join(f'<xf fillId="{i}"/>' for i in (0, 2, 3, 4, 5))
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>157</v></c><c r="B2" s="2" t="s"><v>2</v></c></row><row r="3"><c r="A3" s="4"><v>158</v></c><c r="B3" s="3"><v>7</v></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>cov_nr</t></si><si><r><t>a</t></r><r><t>ge</t></r></si><si><t>65 -&gt; 66</t></si></sst>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}><fills>{fills}</fills><cellXfs>{xfs}</cellXfs></styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


def test_coloured_cells(spark, tmp_path):
    book(tmp_path / "a.xlsx")
    got = {(r["row"], r["field_name"]): (r["value"], r["error_type"], r["severity"], r["note"]) for r in sheets.read_coloured(spark, str(tmp_path / "a.xlsx")).collect()}
    assert got == {(1, "cov_nr"): ("157", "none", "none", None), (1, "age"): ("65", "rule_misapplication", "low", "66"), (2, "cov_nr"): ("158", "superior_extraction", "none", None), (2, "age"): ("7", "hallucinated_value", "high", None)}
    assert all(r["note"] is None for r in sheets.read_coloured(spark, str(tmp_path / "a.xlsx"), ["cov_nr"]).collect())


def test_results_of_versions(spark, tmp_path):
    for version, body in (("copd_v9", '[{"arm": "a", "_metadata": {"prompt_version": "v9"}}, {"arm": "b", "completed": "FALSE"}]'), ("copd_v11", '[{"arm": "a"}]'), ("copd_v2", "{bad")):
        (tmp_path / version).mkdir()
        (tmp_path / version / "0157.json").write_text(body)
    (tmp_path / "copd_v2" / "0158.json").write_text("{bad")
    all_ = sheets.read_results(spark, str(tmp_path))
    assert {(r["paper_id"], r["version"]): (r["n_arms"], r["prompt_version"]) for r in all_.collect()} == {("0157", 9): (2, "v9"), ("0157", 11): (1, None), ("0157", 2): (None, None), ("0158", 2): (None, None)}
    assert {r["paper_id"]: r["version"] for r in sheets.newest(all_).collect()} == {"0157": 11, "0158": 2}
    assert [r["version"] for r in sheets.incomplete(all_).collect()] == [9]


def test_wide_tables(spark, tmp_path):
    (tmp_path / "prior.csv").write_text('cov_nr,arm,age,note\n0157,treat,65,"a ""b""\nc"\n')
    mapping = spark.createDataFrame([("age", "A_reference"), ("note", "no"), ("gone", "B_triangulation")], "field_name string, tier1_prior_extraction string")
    assert [tuple(r) for r in sheets.read_prior(spark, str(tmp_path / "prior.csv"), mapping).collect()] == [("0157", "treat", "age", "65")]
    assert sheets.read_prior(spark, str(tmp_path / "prior.csv"), mapping.limit(0)).count() == 0
    (tmp_path / "arms.csv").write_text("cov_nr,arm,healthcare_setting\n1,a,2\n1,b,9\n5108,a,1\n")
    arms = sheets.read_arms(spark, str(tmp_path / "arms.csv"), ["arm"], ("5108",), trials=1, rows=(2, 2))
    assert [r["healthcare_setting_label"] for r in arms.collect()] == ["Secondary", None]
    with pytest.raises(ValueError):
        sheets.read_arms(spark, str(tmp_path / "arms.csv"), ["n"])
    with pytest.raises(ValueError):
        sheets.read_arms(spark, str(tmp_path / "arms.csv"), ["arm"], trials=1)
    (tmp_path / "rev.csv").write_text("﻿paper_id,resolution_note\n1,x\n")
    assert sheets.read_reviewed(spark, str(tmp_path / "rev.csv")).columns == ["paper_id", "resolution_note"]


def test_records_of_broken_answers(spark):
    """No crash, nothing out of a broken object, and time in proportion to the text."""
    import time

    from studygrid.functions import texts

    cases = {
        "[" * 100_000: [], '{"a":' * 5000: [], 'note {bad: {"x": 1}} end': [], 'x {bad} {"y": 2} z': ['{"y": 2}'], '{"a": "}{"} and {"b": [1]}': ['{"a": "}{"}', '{"b": [1]}'],
        '{"never": 1 {"c": 3}': [], "} {}": ["{}"], "{" + '"k": [' * 50_000 + "} tail {\"q\": 1}": ['{"q": 1}'], '```json\n[{"a": 1}, {"b": 2}]\n```': ['{"a": 1}', '{"b": 2}'], "prose": [], "": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    began = time.time()
    assert {r["t"]: r["r"] for r in df.select("t", texts.records(F.col("t")).alias("r")).collect()} == cases
    assert time.time() - began < 30
