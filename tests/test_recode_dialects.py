"""Recoding by JSON type, files of many dialects, and wide tables."""

import json

import pytest
from pyspark.sql import functions as F

from studygrid import dealing
from studygrid.operators import recode
from studygrid.sources import dialects, runs


def test_recoding_by_type(spark):
    cases = [
        # field, bucket, a, b -> bucket, a, b
        (("ethnicity", "structured_string_array", '["NA", " n/a "]', '"Dutch 40"'), ("boolean", "false", "true")),
        (("ethnicity", "structured_string_array", "[]", "null"), ("boolean", "false", "false")),
        (("educational_level", "free_text", '["High: 40%"]', "12.5"), ("boolean", "true", "false")),
        (("health_literacy", "categorical", "2", '" NaN "'), ("boolean", "true", "false")),
        (("health_literacy", "categorical", "0", None), ("boolean", "false", "false")),
        (("health_literacy", "categorical", "true", '"yes"'), ("boolean", "true", "true")),
        (("health_literacy", "categorical", '{"a": 1}', '"x"'), ("boolean", "false", "true")),
        (("ses", "boolean", '["NA"]', '"Regular users (%) 20"'), ("boolean", "false", "true")),
        (("ses", "boolean", "true", '"na"'), ("boolean", "true", "false")),
        (("ses", "boolean", '"yes"', "1"), ("boolean", "yes", "false")),
        (("diagnosis", "structured_string_array", '"COPD"', '"COPD: 3"'), ("structured_string_array", "COPD", "COPD: 3")),
        (("diagnosis", "structured_string_array", '["a: 1", "b: 2"]', "null"), ("structured_string_array", "a: 1~b: 2", None)),
        (("age", "numerical", "65.5", '"65,5"'), ("numerical", "65.5", "65,5")),
        (("age", "numerical", "not json", None), ("numerical", "not json", None)),
    ]
    df = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(cases)], "i int, field_name string, bucket string, a string, b string")
    got = {r["i"]: (r["bucket"], r["a"], r["b"]) for r in recode.recoded(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_queue_of_reference_fields(spark):
    found = spark.createDataFrame([("age", "categorical", 1, "a", "b"), ("sex", "categorical", 2, "x", None)], "field string, bucket string, k int, value_a string, value_b string")
    mapping = spark.createDataFrame([("age", "A_reference"), ("sex", "no")], "field_name string, tier1_prior_extraction string")
    assert [tuple(r) for r in recode.adjudication_queue(found, mapping, ["k"]).collect()] == [("age", 1, "a", "b", "", "")]
    assert recode.adjudication_queue(found, mapping, ["k"], None).count() == 2


@pytest.fixture()
def sheets(tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿cov_nr;arm;age\n12;control;65,5\n\n13;treat1;\n".encode())
    (tmp_path / "b.csv").write_bytes('cov_nr,arm,note\n14,control,"caf\xe9, \n""two"" lines"\n'.encode("latin-1"))
    (tmp_path / "c.tsv").write_bytes("age\tcov_nr\n70\t15\n71\t16\textra\n".encode())
    (tmp_path / "d.txt").write_text("cov_nr\n17\n")
    return tmp_path


def test_files_of_many_dialects_by_one_format(spark, sheets):
    dialects.register(spark)
    df = spark.read.format("sheets").load(str(sheets))
    assert df.columns == ["cov_nr", "arm", "age", "note"] and df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("12", "control", "65,5", None), ("13", "treat1", None, None), ("14", "control", None, 'café, \n"two" lines'), ("15", None, "70", None), ("16", None, "71", None), ("17", None, None, None)], key=str)
    one = spark.read.format("sheets").load(f"file://{sheets}/*.csv")
    assert one.columns == ["cov_nr", "arm", "age", "note"] and one.count() == 3
    cells = dialects.read_sheets(spark, str(sheets))
    assert {(r["row"], r["place"], r["field_name"], r["value"]) for r in cells.where("path LIKE '%a.csv'").collect()} == {(0, 0, "cov_nr", "12"), (0, 1, "arm", "control"), (0, 2, "age", "65,5"), (1, 0, "cov_nr", "13"), (1, 1, "arm", "treat1")}


def test_delimiters():
    assert [dialects.delimiter(t) for t in ("a;b,c\n1;2,5\n3;4,5\n", "a,b\n1,2\n", "a\tb\n", "x|y\n1|2", "one\n", "", 'a,"b;c;d;e"\n1,"2;3;4;5"\n')] == [";", ",", "\t", "|", ",", ",", ","]


def test_gold_records(spark):
    df = spark.createDataFrame([(" 12 ", "control ", "172.0", "65.0", "25,9", None, 'say "x"', "m")], "cov_nr string, arm string, n string, age_mean string, bmi string, ses string, note string, _metadata string")
    got = json.loads(dialects.gold_records(df, ["age_mean"]).first()[0])
    assert got == {"cov_nr": "12", "arm": "control", "n": 172, "age_mean": 65.0, "bmi": "25,9", "ses": None, "note": 'say "x"'}


def test_prior_rows(spark):
    cells = [("w", 1, "Cov nr", "#157 "), ("w", 1, "Group", " Control"), ("w", 1, "Age", "65"), ("w", 1, "Other", "x"), ("w", 2, "Cov nr", "12345"), ("w", 2, "Group", "treat1"), ("w", 3, "Cov nr", "9"), ("w", 3, "Group", "total"), ("w", 4, "Group", "control"), ("w", 5, "Cov nr", "9"), ("w", 5, "Group", "TREAT2")]
    df = spark.createDataFrame(cells, "path string, row long, field_name string, value string")
    assert [tuple(r) for r in dialects.prior_rows(df, {"Cov nr": "cov_nr", "Group": "arm", "Age": "age_mean"}).collect()] == [("0009", "treat2", None), ("0157", "control", "65"), ("12345", "treat1", None)]


def test_wide_records_sort_bounded_tasks(spark):
    """No value is sorted before its shuffle or for the header, and a task's share does not grow with the run."""
    assert [dealing.tasks(n) for n in (0, 50_000, 50_001, 10_000_000, 800_000_000, 800_000_001)] == [1, 1, 2, 200, 200, 201]
    df = spark.createDataFrame([("1", "control", 0, "b", "1"), ("2", "treat1", 1, "a", "2")], "cov_nr string, arm string, place int, field_name string, value string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    header, wide = plan(runs._first_places(df, "place")), plan(runs.wide_records(df, place="place"))
    assert "SortAggregate" not in header and "ObjectHashAggregate" in header
    assert wide.count("Exchange ") == wide.count("REPARTITION_BY_NUM") == 1
    assert "Sort" not in wide[wide.index("Exchange "):]


def test_wide_records_find_their_header(spark, tmp_path):
    rows = [("1", "control", 2, "z", '"last"'), ("1", "control", 0, "b", "1.5"), ("1", "control", 1, "a", '["x", 2, null]'), ("1", "treat1", 0, "new", "true"), ("1", "treat1", 1, "a", "null"), ("0", "treat1", 5, "c", '{"k": 1}')]
    df = spark.createDataFrame(rows, "cov_nr string, arm string, place int, field_name string, value string")
    wide = runs.wide_records(df, place="place")
    assert wide.columns == ["cov_nr", "arm", "c", "b", "a", "z", "new"]
    assert sorted(map(tuple, wide.collect())) == [("0", "treat1", '{"k":1}', "", "", "", ""), ("1", "control", "", "1.5", "x~2~None", "last", ""), ("1", "treat1", "", "", "", "", "True")]
    runs.write_wide_csv(df, str(tmp_path / "out"), place="place")
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == wide.columns
    with pytest.raises(Exception, match="b repeats in 1 control"):
        runs.wide_records(df.unionByName(df.where("field_name = 'b'").withColumn("value", F.lit("2")))).collect()
    assert runs.wide_records(df, ["a", "missing"]).columns == ["cov_nr", "arm", "a", "missing"]
