"""Comparing two runs of the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_runs(a: DataFrame, b: DataFrame, paper: str, arm: str, ignore: tuple[str, ...] = ("_metadata",)) -> DataFrame:
    """``(paper, arm, field, value_a, value_b)`` of long runs ``(paper, arm, field_name, value)``.

    A paper or arm that one side lacks gives one ``_status`` row in place of its
    fields. Fields shuffle once, to their arm, where both sides meet by one sort;
    what is there is told on a row for each arm. Repeated fields give all pairs.
    """
    side = lambda df, in_a: df.where(~F.col("field_name").isin(*ignore)).select(paper, arm, "field_name", F.col("value").cast("string").alias("value"), F.lit(in_a).alias("in_a"))
    long, mine = side(a, True).unionByName(side(b, False)), F.col("in_a")
    values = lambda own: F.collect_list(F.when(own, F.struct("value")))
    cells = long.repartition(paper, arm).groupBy(paper, arm, "field_name").agg(values(mine).alias("xs"), values(~mine).alias("ys"))
    of_arm = Window.partitionBy(paper, arm)
    shared = cells.withColumns({"aa": F.max(F.size("xs") > 0).over(of_arm), "ab": F.max(F.size("ys") > 0).over(of_arm)}).where(F.col("aa") & F.col("ab") & F.col(paper).isNotNull() & F.col(arm).isNotNull())
    pairs = shared.select(paper, arm, "field_name", "ys", F.explode_outer("xs").alias("x")).select(paper, arm, "field_name", "x", F.explode_outer("ys").alias("y"))
    fields = pairs.select(paper, F.col(arm).cast("string").alias(arm), F.col("field_name").alias("field"), F.col("x.value").alias("value_a"), F.col("y.value").alias("value_b")).where(~F.col("value_a").eqNullSafe(F.col("value_b")))
    arms = long.groupBy(paper, arm).agg(F.bool_or(mine).alias("aa"), F.bool_or(~mine).alias("ab"))
    papers = arms.groupBy(paper).agg(F.bool_or("aa").alias("pa"), F.bool_or("ab").alias("pb"))
    word = lambda c: F.when(F.col(c), "present").otherwise("missing")
    one_paper = papers.where("pa <> pb").select(paper, F.lit(None).cast("string").alias(arm), F.lit("_status").alias("field"), word("pa").alias("value_a"), word("pb").alias("value_b"))
    one_arm = arms.where("aa <> ab").join(papers.where("pa and pb").select(paper), paper)
    one_arm = one_arm.select(paper, F.col(arm).cast("string").alias(arm), F.lit("_status").alias("field"), word("aa").alias("value_a"), word("ab").alias("value_b"))
    return one_paper.unionByName(one_arm).unionByName(fields)


def diff_common(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields that differ as texts in rows that both sides have; null and empty are the same."""
    wide = a.select(*keys, *[F.col(c).cast("string").alias(f"a_{i}") for i, c in enumerate(fields)]).join(b.select(*keys, *[F.col(c).cast("string").alias(f"b_{i}") for i, c in enumerate(fields)]), keys)
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(f"a_{i}", F.lit("")).alias("value_a"), F.coalesce(f"b_{i}", F.lit("")).alias("value_b")) for i, c in enumerate(fields)])
    return wide.select(*keys, F.explode(F.filter(items, lambda x: x["value_a"] != x["value_b"])).alias("d")).select(*keys, "d.field", "d.value_a", "d.value_b")


def field_presence(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(field_name, presence)``: new, removed or common."""
    left = a.select("field_name").distinct().withColumn("in_a", F.lit(True))
    right = b.select("field_name").distinct().withColumn("in_b", F.lit(True))
    presence = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "removed").otherwise("common")
    return left.join(right, "field_name", "full_outer").select("field_name", presence.alias("presence"))


def long_form(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``(keys, field_name, value)`` of wide records, values as text."""
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(keys, fields, "field_name", "value")


def pair_up(a: DataFrame, b: DataFrame, keys: list[str], pad: int | None = None) -> DataFrame:
    """All fields of two long runs side by side by one join: ``(field_name, keys, a, b)``; ids padded with zeros on request."""
    key = lambda k: (F.lpad(F.trim(F.col(k).cast("string")), pad, "0") if pad else F.col(k)).alias(k)
    left = a.select("field_name", *map(key, keys), F.col("value").alias("a"))
    right = b.select("field_name", *map(key, keys), F.col("value").alias("b"))
    return left.join(right, ["field_name", *keys])


def diff_pairs(runs: DataFrame, paper: str = "paper_id", arm: str = "arm", run: str = "run", ignore: tuple[str, ...] = ("_metadata",)) -> DataFrame:
    """``(paper, run_a, run_b, arm, field, value_a, value_b)`` for each two runs of ``runs(run, paper, arm, field_name, value)`` in which a paper is, by name.

    An arm that one of the two lacks gives a ``_status`` row, a field that one
    lacks a null. Records shuffle once, to their arm, and pairs are made inside
    it, of its own runs; which runs have a paper is settled on a row for each arm.
    Repeated fields of an arm keep the least value.
    """
    long = runs.where(~F.col("field_name").isin(*ignore)).select(F.col(paper).alias("p"), F.col(arm).alias("a"), F.col(run).alias("r"), F.col("field_name").alias("f"), F.col("value").cast("string").alias("v"))
    # Dealt by arm, records need no other exchange for their fields, nor to meet the runs of their arm.
    dealt = long.repartition("p", "a")
    arms = long.groupBy("p", "a").agg(F.sort_array(F.collect_set("r")).alias("runs"))
    cells = dealt.groupBy("p", "a", "f").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("cells")).select("p", "a", "f", F.col("cells.r").alias("rs"), F.col("cells.v").alias("vs"))
    fields = cells.withColumn("runs", F.sort_array(F.array_distinct(F.flatten(F.collect_set("rs").over(Window.partitionBy("p", "a"))))))
    # Pairs by two explodes and values by place, not by lambdas, whose evaluation is interpreted.
    spread = lambda df, names, *keep: df.select(*keep, F.explode(names).alias("x")).select("*", F.explode(names).alias("y")).where("x < y")
    at = lambda r: F.get("vs", F.array_position("rs", r).cast("int") - 1)
    may_differ = (F.size("rs") < F.size("runs")) | (F.size(F.array_distinct("vs")) > 1)
    pairs = spread(fields.where(may_differ), F.col("runs"), "p", "a", "f", "rs", "vs", "runs").select("p", "a", "f", "x", "y", at(F.col("x")).alias("value_a"), at(F.col("y")).alias("value_b"))
    differ = pairs.where(~F.col("value_a").eqNullSafe(F.col("value_b"))).select(F.col("p").alias(paper), F.col("x").alias("run_a"), F.col("y").alias("run_b"), F.col("a").cast("string").alias(arm), F.col("f").alias("field"), "value_a", "value_b")
    of_paper = arms.select(F.col("p").alias("q"), F.explode("runs").alias("r")).groupBy("q").agg(F.sort_array(F.collect_set("r")).alias("every"))
    lacking = arms.join(of_paper, F.col("p") == F.col("q")).where(F.size("runs") < F.size("every"))
    sides = spread(lacking, F.col("every"), "p", "a", "runs", "every").where(F.array_contains("runs", F.col("x")) != F.array_contains("runs", F.col("y")))
    word = lambda r: F.when(F.array_contains("runs", r), "present").otherwise("missing")
    status = sides.select(F.col("p").alias(paper), F.col("x").alias("run_a"), F.col("y").alias("run_b"), F.col("a").cast("string").alias(arm), F.lit("_status").alias("field"), word(F.col("x")).alias("value_a"), word(F.col("y")).alias("value_b"))
    return differ.unionByName(status)


def compare_by_place(a: DataFrame, b: DataFrame, paper: str = "paper_id", place: str = "place", ignore: tuple[str, ...] = ("cov_nr", "arm", "_metadata"), sample: int = 5) -> DataFrame:
    """``(field_name, presence, status, same, diff, sample)`` of long runs ``(paper, place, field_name, value)`` whose arms are paired by place.

    The arms of a paper that both have, from 0 on, are compared; a value that is
    missing is an empty text, so a field that both lack is the same. ``sample``
    has the first ``paper_place`` that differ, by paper and place. Fields that are
    new or removed have no counts.

    Both runs meet in their arm by one sort; where they are already dealt by paper
    or arm, nothing shuffles but the differing rows that may be in a sample, and
    counts. Repeated fields give all pairs.
    """
    # Ignored fields have no name here, but tell that their arm is there.
    field = F.when(~F.col("field_name").isin(*ignore), F.col("field_name")).alias("field_name")
    side = lambda df, in_a: df.select(F.col(paper).alias("p"), F.col(place).alias("i"), field, F.coalesce(F.col("value").cast("string"), F.lit("")).alias("v"), F.lit(in_a).alias("in_a"))
    of_arm = Window.partitionBy("p", "i").orderBy("field_name")
    whole = of_arm.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mine, there = F.col("in_a"), F.col("p").isNotNull() & F.col("i").isNotNull()
    rows = side(a, True).unionByName(side(b, False)).withColumns({"aa": F.max("in_a").over(whole), "ab": F.max(~mine).over(whole), "k": F.row_number().over(of_arm)})
    cells = rows.groupBy("p", "i", "field_name").agg(F.collect_list(F.when(mine, F.col("v"))).alias("xs"), F.collect_list(F.when(~mine, F.col("v"))).alias("ys"), F.min("k").alias("k"), F.bool_and(F.col("aa") & F.col("ab") & there).alias("both"))
    # What is missing is an empty text; all pairs are made only of repeated fields.
    or_empty = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("")))
    unlike = F.aggregate(F.transform(or_empty("xs"), lambda x: F.size(F.filter(or_empty("ys"), lambda y: x != y))), F.lit(0), lambda n, x: n + x)
    one = (F.coalesce(F.get("xs", F.lit(0)), F.lit("")) != F.coalesce(F.get("ys", F.lit(0)), F.lit(""))).cast("int")
    cells = cells.withColumn("n", F.when(~F.col("both"), 0).when((F.size("xs") < 2) & (F.size("ys") < 2), one).otherwise(unlike))
    first = Window.partitionBy("field_name").orderBy("p", "i")
    differ = cells.where("n > 0 and field_name is not null").select("field_name", "p", "i", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("_one"))
    few = differ.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
    name = F.concat_ws("_", F.col("p").cast("string"), F.col("i").cast("string"))
    samples = few.groupBy("field_name").agg(F.array_sort(F.collect_list(F.struct("k", name.alias("x")))).alias("s"))
    found = cells.groupBy("field_name").agg(F.bool_or(F.size("xs") > 0).alias("in_a"), F.bool_or(F.size("ys") > 0).alias("in_b"), F.sum("n").alias("diff"), F.count_if(F.col("both") & (F.col("k") == 1)).alias("own"))
    # Rows of ``found`` are the fields; each arm is counted at its first.
    found = found.withColumn("arms", F.sum("own").over(Window.partitionBy())).where("field_name is not null")
    out = found.join(samples, "field_name", "left")
    presence = F.when(~F.col("in_a"), "new").when(~F.col("in_b"), "removed").otherwise("common")
    common = presence == "common"
    when = lambda x: F.when(common, x)
    return out.select("field_name", presence.alias("presence"), when(F.when(F.col("diff") == 0, "SAME").otherwise("DIFF")).alias("status"), when(F.col("arms") - F.col("diff")).alias("same"), when(F.col("diff")).alias("diff"), when(F.coalesce(F.transform("s", lambda s: s["x"]), F.array().cast("array<string>"))).alias("sample"))
