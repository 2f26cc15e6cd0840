"""Repairing runs in long form (paper, arm, field_name, value as JSON text), with an audit, and applying reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studygrid.operators import review
from studygrid.operators.ledger import KEY, resolve

#: Fixed value: names of arms without the intervention.
CONTROL = r"(?i)(control|usual|standard|placebo|sham|waitlist)"
#: Fields that get another name.
RENAMES = {
    "instrument_name": "health_literacy_instrument_name",
    "instrument_value": "health_literacy_instrument_value",
    "instrument_other": "health_literacy_instrument_other",
    "digital_literacy_freq_use": "digital_literacy_frequency",
}
#: Invented fields that get another name unless that is there.
INVENTED = {"ses_employment": "ses_job_status", "ses_marital_status": "ses_relationship_status"}
#: Fields that go.
REMOVES = ("gender_intermediate_n", "gender_intermediate_pct")
#: Notes of reviewers and what they decide; no rule leaves the finding open.
NOTE_RULES = tuple((pattern, status) for pattern, status, *_ in review.NOTE_RULES)

LIST = "array<string>"


def rename_arms(df: DataFrame, paper: str, arm: str, position: str) -> DataFrame:
    """Arms ``(paper, arm, position)`` with ``new_arm``: names of neither kind become control, or the next free treatN.

    Numbers go on from the greatest of the paper, in order of position. Null is
    left alone.
    """
    named = F.col(arm).rlike("^(treat|control)")
    loose = ~named & ~F.col(arm).rlike(CONTROL)
    number = F.regexp_extract(F.col(arm), r"^treat(\d+)", 1).try_cast("int")
    # One order for both frames, so that rows are sorted once.
    w = Window.partitionBy(paper).orderBy(position, arm)
    nth = F.sum(F.coalesce(loose, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    greatest = F.max(number).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fresh = F.concat(F.lit("treat"), (F.coalesce(greatest, F.lit(0)) + nth).cast("string"))
    return df.withColumn("new_arm", F.when(named | F.col(arm).isNull(), F.col(arm)).when(loose, fresh).otherwise("control"))


def _is_na(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin("null", '"NA"', '["NA"]', '""', "[]")


def rename_fields(run: DataFrame, renames: dict[str, str] = RENAMES, careful: dict[str, str] = INVENTED, removes: tuple[str, ...] = REMOVES, paper: str = "cov_nr", arm: str = "arm") -> DataFrame:
    """The run with fields renamed and removed.

    A field of ``renames`` replaces what has its new name. One of ``careful``
    takes its new name only if it has a value and the other has none; else it
    stays. All in one window over the fields of an arm that share a new name.
    """
    literal = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")
    always, perhaps = F.try_element_at(literal(renames), F.col("field_name")), F.try_element_at(literal(careful), F.col("field_name"))
    rows = run.where(~F.col("field_name").isin(*removes)).withColumn("_to", F.coalesce(always, perhaps, F.col("field_name"))).withColumn("_kind", F.when(always.isNotNull(), 2).when(perhaps.isNotNull(), 1).otherwise(0))
    w = Window.partitionBy(paper, arm, "_to")
    taken = F.coalesce(F.max(F.when((F.col("_kind") != 1) & ~_is_na(F.col("value")), 1)).over(w), F.lit(0)) == 1
    moves = (F.col("_kind") == 1) & ~taken & ~_is_na(F.col("value"))
    rows = rows.withColumn("_name", F.when((F.col("_kind") == 1) & ~moves, F.col("field_name")).otherwise(F.col("_to"))).withColumn("_rank", F.when(F.col("_kind") == 2, 2).when(moves, 1).otherwise(0))
    best = F.row_number().over(Window.partitionBy(paper, arm, "_name").orderBy(F.col("_rank").desc(), "field_name"))
    return rows.withColumn("_best", best).where("_best = 1").withColumn("field_name", F.col("_name")).select(*run.columns)


def fold_orphans(run: DataFrame, known: list[str], into: str, prefixes: tuple[str, ...] = ("fev1_", "nyha_", "hba1c_", "needs_discussion_", "pack_years_", "_"), paper: str = "cov_nr", arm: str = "arm") -> DataFrame:
    """Moves fields that are not known into the list ``into`` as ``other: field: value``; those whose name the list has as a prefix just go.

    Arms whose ``into`` is no list stay as they are. One shuffle on the arm.
    """
    keys = [paper, arm]
    listed = F.when(F.col("field_name") == into, F.from_json("value", LIST))
    odd = ~F.col("field_name").isin(*known, into) & F.col("field_name").rlike(r"^[a-zA-Z][a-zA-Z0-9]*(_[a-zA-Z][a-zA-Z0-9]*)*$")
    for p in prefixes:
        odd = odd & ~F.col("field_name").startswith(p)
    w = Window.partitionBy(*keys)
    rows = run.withColumn("_list", F.max(listed).over(w)).withColumn("_odd", odd & F.col("_list").isNotNull())
    plain = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v"), F.lit("null"))
    there = F.exists("_list", lambda x: F.contains(x, F.lit(":")) & (F.lower(F.trim(F.substring_index(x, ":", 1))) == F.lower("field_name")))
    moved = F.when(F.col("_odd") & ~F.coalesce(there, F.lit(False)), F.concat(F.lit("other: "), F.col("field_name"), F.lit(": "), plain))
    rows = rows.withColumn("_moved", F.array_sort(F.collect_list(moved).over(w)))
    value = F.when((F.col("field_name") == into) & F.col("_list").isNotNull() & (F.size("_moved") > 0), F.to_json(F.concat("_list", "_moved"))).otherwise(F.col("value"))
    return rows.where(~F.col("_odd")).withColumn("value", value).select(*run.columns)


def apply_fixes(run: DataFrame, fixes: DataFrame, items_field: str, paper: str = "cov_nr", arm: str = "arm") -> tuple[DataFrame, DataFrame]:
    """The repaired run, and its audit ``(paper, arm, field_name, old_value, new_value, category)``.

    ``fixes`` are findings with ``fix_field`` and ``fix_value``. By category:
    ``array_sum_count_low`` appends the item to the list, ``severity_prefix_casing``
    replaces items of the wrong prefix in ``items_field``, all others set the
    value as text. Of several texts for one value the least counts. Fixes without
    an arm hold for all arms of the paper.
    """
    casing, low = F.col("category") == "severity_prefix_casing", F.col("category") == "array_sum_count_low"
    fx = fixes.where("fix_field is not null and fix_value is not null").select(
        F.col("paper_id").alias(paper), F.col("arm").alias("_arm"), F.when(casing, F.lit(items_field)).otherwise(F.col("fix_field")).alias("field_name"), "category", F.col("fix_field"), F.col("fix_value")
    )
    def grouped(rows: DataFrame, by: list[str], tag: str) -> DataFrame:
        swaps = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("category") == "severity_prefix_casing", F.struct("fix_value", F.concat("fix_field", F.lit(":")).alias("p"))))))
        return rows.groupBy(*by).agg(
            F.array_sort(F.collect_set(F.when(low, F.col("fix_value")))).alias(f"_add{tag}"),
            swaps.alias(f"_swap{tag}"),
            F.min(F.when(~casing & ~low, F.col("fix_value"))).alias(f"_set{tag}"),
            F.min("category").alias(f"_cat{tag}"),
        )

    of_arm = grouped(fx.where("_arm is not null").withColumn(arm, F.col("_arm")), [paper, arm, "field_name"], "1")
    of_paper = grouped(fx.where("_arm is null"), [paper, "field_name"], "2")
    rows = run.withColumn(paper, F.col(paper).cast("string")).join(of_arm, [paper, arm, "field_name"], "left").join(of_paper, [paper, "field_name"], "left")
    parsed = F.from_json("value", LIST)
    none_map, none_list = F.create_map().cast("map<string,string>"), F.array().cast(LIST)
    swaps = F.concat(F.map_entries(F.coalesce("_swap1", none_map)), F.map_entries(F.coalesce("_swap2", none_map)))
    adds = F.array_distinct(F.concat(F.coalesce("_add1", none_list), F.coalesce("_add2", none_list)))

    def swapped(x: Column) -> Column:
        hit = F.filter(swaps, lambda s: x.startswith(s["value"]))
        # The finding carries the whole corrected item; only its own prefix is taken, as another item may share the wrong one.
        right = F.substring_index(F.try_element_at(hit, F.lit(1))["key"], ":", 1)
        return F.when(F.size(hit) > 0, F.concat(right, F.substring(x, F.length(F.substring_index(x, ":", 1)) + 1, F.length(x)))).otherwise(x)

    listed = F.to_json(F.concat(F.transform(parsed, swapped), adds))
    set_ = F.coalesce("_set1", "_set2")
    # Numbers and booleans stay bare, everything else becomes a JSON string.
    as_json = F.when(set_.rlike(r"^(-?(0|[1-9]\d*)(\.\d+)?|true|false)$"), set_).otherwise(F.substring(F.to_json(F.struct(set_.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(set_.alias("v")))) - 6))
    has_list = parsed.isNotNull() & ((F.size(swaps) > 0) | (F.size(adds) > 0))
    new = F.when(set_.isNotNull(), as_json).when(has_list, listed).otherwise(F.col("value"))
    rows = rows.withColumn("_new", new)
    changed = ~F.col("_new").eqNullSafe(F.col("value"))
    audit = rows.where(changed).select(paper, arm, "field_name", F.col("value").alias("old_value"), F.col("_new").alias("new_value"), F.coalesce("_cat1", "_cat2").alias("category"))
    return rows.withColumn("value", F.col("_new")).select(*run.columns), audit


def decision(note: Column, rules: tuple[tuple[str, str], ...] = NOTE_RULES) -> Column:
    """What a reviewer's note decides, by the first rule found in it; null note is empty, no rule leaves it open (null)."""
    n, out = F.trim(F.coalesce(note, F.lit(""))), F
    for pattern, status in rules:
        out = out.when(n.rlike(pattern), status)
    return out.otherwise(F.lit(None).cast("string"))


def decision_by_prefix(note: Column, prefixes: list[tuple[str, str]], skip: tuple[str, ...] = ("Manual check",), empty: str = "accepted") -> Column:
    """The same by beginnings of the note; ``skip`` leaves it open and an empty note decides ``empty``."""
    n = F.trim(F.coalesce(note, F.lit("")))
    out = F.when(n == "", empty)
    for prefix, status in prefixes:
        out = out.when(n.startswith(prefix), status)
    for prefix in skip:
        out = out.when(n.startswith(prefix), F.lit(None).cast("string"))
    return out.otherwise(F.lit(None).cast("string"))


def apply_review(ledger: DataFrame, reviewed: DataFrame, decide: Callable[[Column], Column] = decision) -> tuple[DataFrame, DataFrame]:
    """The ledger after ``reviewed(paper_id, category, message, resolution_note)``, and ``(outcome, n)`` over reviewed keys.

    Outcomes: conflict (several different notes), undecided, not_found,
    already_resolved, applied.
    """
    notes = reviewed.withColumn("decision", decide(F.col("resolution_note"))).groupBy(*KEY).agg(F.count_distinct(F.trim(F.coalesce("resolution_note", F.lit("")))).alias("notes"), F.min("decision").alias("decision"))
    state = ledger.groupBy(*KEY).agg(F.max((F.col("status") == "open").cast("int")).alias("open"))
    seen = notes.join(state, KEY, "left")
    outcome = F.when(F.col("notes") > 1, "conflict").when(F.col("decision").isNull(), "undecided").when(F.col("open").isNull(), "not_found").when(F.col("open") == 0, "already_resolved").otherwise("applied")
    usable = notes.where("notes = 1 and decision is not null").select(*KEY, "decision")
    return resolve(ledger, usable), seen.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def quarantine(files: DataFrame, findings: DataFrame, least: int = 5) -> DataFrame:
    """``(paper_id, action)`` of files ``(paper_id, n_arms)`` to set aside: delete if not readable (null), back_up if of one arm or with ``least`` errors."""
    bad = findings.where("severity = 'ERROR'").groupBy("paper_id").agg(F.count("*").alias("errors"))
    action = F.when(F.col("n_arms").isNull(), "delete").when((F.col("n_arms") == 1) | (F.coalesce("errors", F.lit(0)) >= least), "back_up")
    return files.join(bad, "paper_id", "left").select("paper_id", action.alias("action")).where("action is not null")


def rerun(run: Callable[[int], None], errors: Callable[[], int], most: int) -> int:
    """Runs until no errors are left, at most ``most`` times; returns the runs made. Each is a job of its own; only the count comes to the driver."""
    for i in range(most):
        run(i)
        if errors() == 0:
            return i + 1
    return most
