"""Tables merged in place, incremental runs, and comparisons of many runs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from studygrid.operators import compare, selection, tables
from studygrid.streaming import findings
from studygrid.streaming.tables import merge_into, part_of, read_table

FOUND = "paper_id string, category string, message string, severity string"


def files(path):
    return {d: sorted(os.listdir(path / d)) for d in os.listdir(path) if d.startswith("part=")}


def ledger(spark, path):
    return sorted((r["paper_id"], r["category"], r["status"]) for r in findings.read_ledger(spark, str(path)).collect())


def test_a_batch_rewrites_its_partitions_alone(spark, tmp_path):
    path = tmp_path / "ledger"
    papers = spark.range(300).select(F.col("id").cast("string").alias("paper_id"))
    found = papers.select("paper_id", F.lit("c").alias("category"), F.lit("m").alias("message"), F.lit("ERROR").alias("severity"))
    assert len(findings.sync_ledger(spark, str(path), found, papers)) == 64
    before = files(path)
    one = papers.where("paper_id = '7'")
    more = spark.createDataFrame([("7", "c", "m", "ERROR"), ("7", "d", "m", "ERROR")], FOUND)
    wrote = findings.sync_ledger(spark, str(path), more, one)
    after = files(path)
    assert len(wrote) == 1 and {d for d in after if after[d] != before.get(d)} == {f"part={wrote[0]}"}
    assert len(ledger(spark, path)) == 301 and ("7", "d", "open") in ledger(spark, path)
    # The same batch again changes nothing, not even a file.
    assert findings.sync_ledger(spark, str(path), more, one) == [] and files(path) == after
    # Findings that are gone leave a partition that may be empty.
    findings.sync_ledger(spark, str(path), found.limit(0), papers)
    assert ledger(spark, path) == [] and findings.sync_ledger(spark, str(path), found.limit(0), papers) == []
    assert findings.sync_ledger(spark, str(path), found.limit(0), papers.limit(0)) == []


def test_reviewed_findings_stay(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), findings.LEDGER
    keys = spark.createDataFrame([("1",), ("2",), ("3",)], "paper_id string")
    start = spark.createDataFrame([("1", "c", "m", "ERROR", "accepted"), ("2", "c", "m", "ERROR", "open"), ("3", "c", "m", "ERROR", "open")], schema)
    merge_into(spark, path, schema, "paper_id", keys, lambda before: before.unionByName(start), 4)
    findings.sync_ledger(spark, path, spark.createDataFrame([("1", "n", "m", "INFO")], FOUND), keys.where("paper_id <> '3'"), 4)
    assert ledger(spark, path) == [("1", "c", "accepted"), ("1", "n", "open"), ("3", "c", "open")]
    with pytest.raises(ValueError):
        merge_into(spark, path, schema, "paper_id", keys.where("paper_id = '1'"), lambda before: before.withColumn("paper_id", F.lit("2" if part(spark, "1") != part(spark, "2") else "3")), 4)


def part(spark, key):
    return spark.createDataFrame([(key,)], "k string").select(part_of("k", 4)).first()[0]


def test_run_records_are_replaced(spark, tmp_path):
    path, schema = str(tmp_path / "runs"), "run_id string, cost double"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    findings.record_runs(spark, path, schema, rows(("a", 1.0), ("b", 2.0)))
    findings.record_runs(spark, path, schema, rows(("b", 5.0), ("c", 3.0)))
    assert sorted(map(tuple, read_table(spark, path, schema, "run_id").collect())) == [("a", 1.0), ("b", 5.0), ("c", 3.0)]
    with pytest.raises(ValueError):
        findings.record_runs(spark, path, schema, rows(("d", 1.0), ("d", 2.0)))


def test_a_second_run_does_no_work(spark, tmp_path):
    manifest, outputs, schema, worked = str(tmp_path / "manifest"), str(tmp_path / "outputs"), "key string, result string", []

    def work(todo):
        worked.append(sorted(r["key"] for r in todo.collect()))
        return todo.select("key", F.upper("content").alias("result"))

    def run(*rows):
        return selection.process_new(spark, spark.createDataFrame(list(rows), "key string, version string, content string"), manifest, outputs, schema, work)

    assert run(("a", "v1", "x"), ("b", "v1", "y"), ("c", None, None)) == 3
    assert run(("a", "v1", "x"), ("b", "v1", "y"), ("c", None, None)) == 0 and len(worked) == 1
    assert run(("a", "v2", "x"), ("b", "v1", "changed"), ("c", None, None), ("d", "v1", "new")) == 3
    assert worked[1] == ["a", "b", "d"]
    assert sorted(map(tuple, read_table(spark, outputs, schema, "key").collect()), key=str) == [("a", "X"), ("b", "CHANGED"), ("c", None), ("d", "NEW")]
    with pytest.raises(ValueError):
        run(("a", "v3", "x"), ("a", "v3", "y"))


def test_sample_is_equal_for_any_partitioning(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    one = selection.seeded_sample(df, "id", 40, 3)
    assert {r["id"] for r in one.collect()} == {r["id"] for r in selection.seeded_sample(df.repartition(13), "id", 40, 3).collect()}
    assert {r["id"] for r in one.collect()} != {r["id"] for r in selection.seeded_sample(df, "id", 40, 4).collect()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert [r["id"] for r in selection.seeded_sample(df.repartition(7), "id", 3).collect()] == [0, 1, 2]
    assert selection.seeded_sample(df, "id", 5, 1, "g").groupBy("g").count().where("count = 5").count() == 3


def brute_pairs(rows):
    by = {}
    for run, p, a, f, v in rows:
        cell = by.setdefault(p, {}).setdefault(run, {}).setdefault(a, {})
        cell[f] = min(x for x in (cell.get(f, v), v))
    out = []
    for p, runs in by.items():
        for x in sorted(runs):
            for y in sorted(runs):
                if x < y:
                    for a in set(runs[x]) | set(runs[y]):
                        if a not in runs[x] or a not in runs[y]:
                            out.append((p, x, y, a, "_status", "present" if a in runs[x] else "missing", "present" if a in runs[y] else "missing"))
                            continue
                        out += [(p, x, y, a, f, runs[x][a].get(f), runs[y][a].get(f)) for f in set(runs[x][a]) | set(runs[y][a]) if runs[x][a].get(f) != runs[y][a].get(f)]
    return sorted(out, key=str)


def test_pairs_of_runs_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(r, p, a, f, str(rng.randint(0, 2))) for r in "wxyz" for p in ("1", "2", "3") for a in ("control", "treat1", "treat2") for f in ("n", "age", "sex") if rng.random() < 0.7 and not (p == "3" and r == "w")]
    rows += [("w", "4", "control", "_metadata", "m"), ("x", "5", "control", "n", "1")]
    df = spark.createDataFrame(rows, "run string, paper_id string, arm string, field_name string, value string")
    found = compare.diff_pairs(df)
    assert sorted(map(tuple, found.collect()), key=str) == brute_pairs([r for r in rows if r[3] != "_metadata"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    records = [x for x in plan.split("\n") if "Exchange hashpartitioning(p#" in x and "REPARTITION_BY_COL" in x]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert len({x.split("hashpartitioning(")[1].split("plan_id")[0].replace("#", "").translate({ord(d): None for d in "0123456789"}) for x in records}) == 1


def test_arms_by_place(spark):
    schema = "paper_id string, place int, field_name string, value string"
    a = [("1", 0, "n", "1"), ("1", 1, "n", "2"), ("1", 2, "n", "3"), ("1", 0, "old", "x"), ("2", 0, "n", "5"), ("1", 0, "same", "")] + [(f"{i}", 0, "n", "1") for i in range(10, 17)]
    b = [("1", 0, "n", "1"), ("1", 1, "n", "9"), ("2", 0, "n", None), ("1", 0, "new", "x"), ("3", 0, "n", "1"), ("1", 1, "same", None)] + [(f"{i}", 0, "n", "2") for i in range(10, 17)]
    got = {r["field_name"]: tuple(r)[1:] for r in compare.compare_by_place(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert got == {"n": ("common", "DIFF", 1, 9, ["1_1", "10_0", "11_0", "12_0", "13_0"]), "same": ("common", "SAME", 10, 0, []), "old": ("removed", None, None, None, None), "new": ("new", None, None, None, None)}


def test_arms_by_place_meet_without_a_shuffle_of_values(spark):
    """Against brute force with repeated fields and null keys; of runs that are dealt by paper only rows of samples and counts shuffle."""
    rng = random.Random(5)
    run = lambda: [(rng.choice(("1", "2", "3", None)), rng.choice((0, 1, 2, None)), rng.choice("xyz"), rng.choice(("", "1", "2", None))) for _ in range(60)]
    a, b = run() + [("1", 0, "arm", "1")], [r for r in run() if r[0] != "3"]
    dealt = lambda rows: spark.createDataFrame(rows, "paper_id string, place int, field_name string, value string").repartition("paper_id")
    found = compare.compare_by_place(dealt(a), dealt(b), sample=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    at = lambda rows: {(p, i) for p, i, *_ in rows if p is not None and i is not None}
    arms, want = at(a) & at(b), {}
    for f in "xyz":
        of = lambda rows, p, i: [r[3] or "" for r in rows if r[:3] == (p, i, f)] or [""]
        differ = [f"{p}_{i}" for p, i in sorted(arms) for x in of(a, p, i) for y in of(b, p, i) if x != y]
        want[f] = ("common", "DIFF", len(arms) - len(differ), len(differ), differ)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
    shuffles = [x for x in plan.split("\n") if "Exchange " in x]
    assert sum("REPARTITION_BY_COL" in x for x in shuffles) == 4 and not any("hashpartitioning(p#" in x or "hashpartitioning(field_name" not in x and "SinglePartition" not in x for x in shuffles if "REPARTITION_BY_COL" not in x)


def test_lookups_and_counts(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    joined, gaps = selection.with_lookup(rows, spark.createDataFrame([(1, 2020), (None, 1999)], "k int, year int"), "k", "year")
    assert sorted(map(tuple, joined.collect()), key=str) == [(1, 2020), (2, None), (None, None)] and tuple(gaps.first()) == (3, 2)
    with pytest.raises(ValueError):
        selection.with_lookup(rows, spark.createDataFrame([(1, 1), (1, 2)], "k int, year int"), "k", "year")
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "v string")
    assert [tuple(r)[:2] for r in selection.value_counts(df, "v").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert [tuple(r)[:2] for r in selection.value_counts(df, "v", True).collect()] == [("b", 2), ("a", 1), ("c", 1), (None, 1)]
    assert tuple(selection.members_of(spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "k int, n int"), rows.where("k = 1"), "k", "n").first()) == (1, 11)


def test_baseline_table(spark):
    pooled = spark.createDataFrame([("age", 69.787, 0.717, 68.351, 71.2235, 59), ("bmi", 26.46, None, None, None, 1)], "variable string, mean double, se double, ci_low double, ci_high double, n int")
    cohorts = spark.createDataFrame([("ECLIPSE", "age", 63.4, 7.1, 2164), ("Nijmegen", "age", 60.0, None, 168)], "cohort string, variable string, mean double, sd double, n int")
    got = {r["variable"]: tuple(r)[1:] for r in tables.baseline_comparison(pooled, cohorts, ["ECLIPSE", "Nijmegen"]).collect()}
    assert got["age"] == ("69.8", "[68.4, 71.2]", "0.72", 59, "63.4 (7.1)", "2164", "60.0", "168")
    assert got["bmi"] == ("26.5", "—", "—", 1, "—", "—", "—", "—")


def test_diff_pairs_shuffles_records_once_and_has_no_lambda(spark):
    df = spark.createDataFrame([("r1", "1", "t", "x", "a"), ("r2", "1", "t", "x", "b")], "run string, paper_id string, arm string, field_name string, value string")
    plan = compare.diff_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    assert plan.count("REPARTITION_BY_COL") == 1


def test_diff_runs_meets_without_a_join_of_fields(spark):
    schema = "p string, a string, field_name string, value string"
    one = spark.createDataFrame([("1", "t", "x", "1"), ("1", "t", "x", "2"), ("1", None, "x", "1"), ("1", "t", "y", None), ("1", "t", "z", "5")], schema)
    two = spark.createDataFrame([("1", "t", "x", "1"), ("1", "t", "x", "3"), ("1", None, "x", "9"), ("1", "u", "y", "1"), ("2", "t", "x", "1")], schema)
    got = compare.diff_runs(one, two, "p", "a")
    want = [("1", "t", "x", "1", "3"), ("1", "t", "x", "2", "1"), ("1", "t", "x", "2", "3"), ("1", "t", "z", "5", None), ("1", "u", "_status", "missing", "present"), ("2", None, "_status", "missing", "present")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
