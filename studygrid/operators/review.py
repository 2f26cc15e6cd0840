"""Applying reviewers' notes: decisions with their resolution, proposed fixes written into a run, the ledger closed, and dry runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studygrid.dealing import dealt
from studygrid.operators.ledger import KEY

#: Patterns of notes, the status they decide (None leaves the finding open), its resolution, and whether the proposed value is written.
NOTE_RULES = (
    (r"Correct autofix", "accepted", "Correct autofix.", False),
    (r"(?i)rerun", "rejected", "Catastrophic error, needs rerun.", False),
    (r"(?i)manual check", "accepted", "Manual check OK.", False),
    (r"(?i)fix to|proposed fix", "fixed", "Fixed from proposed value.", True),
    (r"(?i)ignore|expected", "accepted", "Expected behaviour, no action needed.", False),
    (r"^$", "accepted", "Correct autofix (empty note).", False),
)
#: Beginnings of notes, the status they decide, and its resolution.
NOTE_PREFIXES = (
    ("Catastrophic error, rerun paper.", "rejected", "Catastrophic extraction error, needs rerun."),
    ("Correct autofix to will infer non-smoking/missing (inferred)", "accepted", "Correct autofix."),
    ("Inconvenience, minor prompt issue, backlog flag.", "accepted", "Minor prompt issue, backlog."),
    ("Autofix to Moderate", "accepted", "Autofix to Moderate."),
    ("Cross reference if diagnosis in results/old/dm_v* is also NA", "accepted", "Cross-reference old extraction needed."),
    ("Does the validator expect a string or an array for this field? Check the prompt, match validator to prompt", "accepted", "Array format correct — commas are label parts."),
    ("Round to nearest INT that conforms to 1w=7d, 1m=60d, 1y=365d", "accepted", "Round to nearest INT."),
    ("Still caught by gender_match_count_sum", "accepted", "Redundant — already caught by gender_math_count_sum."),
    ("Minor miss, manual check.", "accepted", "Minor miss, manual check."),
    ("Ignore warning, expected behaviour", "accepted", "1w=7d, 1m=30d, 1y=365d. Expected behaviour."),
)
#: Fixed value: the category whose proposed value is one more item of a list.
LOW_SUM = "array_sum_count_low"

VERDICT = "struct<status:string,resolution:string,apply_fix:boolean>"


def _verdict(status: str, resolution: str, apply_fix: bool) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(resolution).alias("resolution"), F.lit(apply_fix).alias("apply_fix"))


def _note(note: Column) -> Column:
    return F.regexp_replace(F.coalesce(note, F.lit("")), r"^\s+|\s+$", "")


def verdict(note: Column, rules: tuple = NOTE_RULES) -> Column:
    """``(status, resolution, apply_fix)`` by the first rule found in the note, null if none is; a null note is an empty one."""
    out = F
    for pattern, *rest in rules:
        out = out.when(_note(note).rlike(pattern), _verdict(*rest))
    return out.otherwise(F.lit(None).cast(VERDICT))


def verdict_by_prefix(note: Column, prefixes: tuple = NOTE_PREFIXES, empty: tuple[str, str] = ("accepted", "Correct autofix.")) -> Column:
    """The same by beginnings of the note; an empty one decides ``empty``, and nothing is written."""
    out = F.when(_note(note) == "", _verdict(*empty, False))
    for prefix, *rest in prefixes:
        out = out.when(_note(note).startswith(prefix), _verdict(*rest, False))
    return out.otherwise(F.lit(None).cast(VERDICT))


def planned(reviewed: DataFrame, decide: Callable[[Column], Column] = verdict) -> DataFrame:
    """What each reviewed row is to do: ``(paper_id, category, message, arm, place, proposed, status, resolution, apply_fix)``.

    ``reviewed(paper_id, category, message, resolution_note)`` may have ``arm``,
    ``proposed_fix`` (or ``corrected_value``) and ``place``, the order of its
    rows. Rows without a paper, without note and proposal, and those whose note
    decides nothing are left out. An empty arm means all arms of the paper.
    """
    text = lambda c: _note(F.col(c).cast("string")) if c in reviewed.columns else F.lit("")
    proposed = text("proposed_fix") if "proposed_fix" in reviewed.columns else text("corrected_value")
    place = F.col("place").cast("long") if "place" in reviewed.columns else F.lit(0).cast("long")
    rows = reviewed.select(
        text("paper_id").alias("paper_id"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("message", F.lit("")).alias("message"), text("arm").alias("arm"),
        place.alias("place"), proposed.alias("proposed"), _note(F.col("resolution_note")).alias("_note"), decide(F.col("resolution_note")).alias("_v"),
    )
    return rows.where("paper_id <> '' and (_note <> '' or proposed <> '') and _v is not null").select("paper_id", *KEY[1:], "arm", "place", "proposed", "_v.*")


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def written_fixes(run: DataFrame, plan: DataFrame, items_field: str = "smoking_status", paper: str = "cov_nr", arm: str = "arm") -> tuple[DataFrame, DataFrame]:
    """The run ``(paper, arm, field_name, value)`` with the plan's proposed values, and its audit ``(paper, arm, field_name, old_value, new_value, fix_rule)``.

    The category of a row names the field. A proposal becomes one more item where
    the value is a list, and takes its place elsewhere, also where the arm has no
    such field; of several for one value that is no list the last holds, by place,
    then text. Those of ``array_sum_count_low`` go to the list ``items_field``,
    or make it where there is none, but leave alone what is no list. Values are
    JSON text; proposals are written as strings.

    Values are counted and shuffle once, to the tasks of their paper, where they
    meet its fixes; an arm's own task finds which fields it lacks.
    """
    fixes = plan.where(F.col("apply_fix") & (F.col("proposed") != "") & (F.col("category") != ""))
    low = F.col("category") == LOW_SUM
    fix = F.struct(F.nullif("arm", F.lit("")).alias("arm"), F.when(low, F.lit(items_field)).otherwise(F.col("category")).alias("name"), F.struct("place", "proposed", low.alias("low"), "status").alias("f"))
    n = run.count()
    of_paper = dealt(fixes.select("paper_id", fix.alias("_x")), n, "paper_id").groupBy("paper_id").agg(F.collect_list("_x").alias("_x"))
    rows = dealt(run.select(paper, arm, "field_name", "value"), n, F.col(paper).cast("string"))
    met = rows.join(of_paper, F.col(paper).cast("string") == F.col("paper_id"), "left")
    # Of the paper's fixes a value has its own; the first value of an arm brings those of fields that the arm lacks.
    in_arm = Window.partitionBy(paper, arm)
    of_arm = F.filter("_x", lambda x: x["arm"].isNull() | (x["arm"] == F.col(arm).cast("string")))
    met = met.withColumn("_x", F.when(F.col("_x").isNotNull(), of_arm))
    held = F.when(F.col("_x").isNotNull(), F.collect_set("field_name").over(in_arm.orderBy("field_name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    met = met.withColumns({"_held": held, "_first": F.row_number().over(in_arm.orderBy("field_name")) == 1})
    lacks = F.array_except(F.transform("_x", lambda x: x["name"]), "_held")
    own = F.array(F.struct("field_name", "value", F.lit(True).alias("was")))
    added = F.transform(lacks, lambda name: F.struct(name.alias("field_name"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("was")))
    cells = F.when(F.col("_first") & (F.size(lacks) > 0), F.concat(own, added)).otherwise(own)
    spread = met.select(paper, arm, "_x", F.explode(cells).alias("c")).select(paper, arm, "_x", "c.*")
    mine = F.array_sort(F.transform(F.filter("_x", lambda x: x["name"] == F.col("field_name")), lambda x: x["f"]))
    both = spread.withColumn("_f", F.when(F.col("_x").isNotNull(), mine)).withColumn("_f", F.when(F.size("_f") > 0, F.col("_f")))
    value = F.try_parse_json("value")
    items = F.try_variant_get(value, "$", "array<variant>")
    is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
    more = F.transform("_f", lambda f: F.parse_json(_quoted(f["proposed"])))
    plain = F.filter("_f", lambda f: ~f["low"])
    last = F.when(F.size(plain) > 0, F.element_at(plain, -1)["proposed"])
    lows = F.transform(F.filter("_f", lambda f: f["low"]), lambda f: f["proposed"])
    made = F.when(last.isNotNull(), _quoted(last)).when(~F.col("was"), F.to_json(lows)).otherwise(F.col("value"))
    new = F.when(F.col("_f").isNull(), F.col("value")).when(is_list, F.to_json(F.concat(items, more))).otherwise(made)
    rule = F.concat(F.lit("apply_reviewed:"), F.element_at("_f", -1)["status"])
    done = lambda df: df.select(paper, arm, "field_name", F.col("value").alias("old_value"), new.alias("new_value"), rule.alias("fix_rule"))
    audit = done(both.where(F.col("_f").isNotNull())).where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return both.select(paper, arm, "field_name", new.alias("value")), audit


def closed(ledger: DataFrame, plan: DataFrame, reviewer: str) -> DataFrame:
    """The ledger with ``resolution``, ``reviewer`` and ``corrected_value``: open findings take the status of the first row of their key in the plan, and a fixed one its proposal."""
    order = F.struct("place", "status", "resolution", "proposed")
    first = plan.groupBy(*KEY).agg(F.min(order).alias("_d"))
    old = lambda c: F.col(c) if c in ledger.columns else F.lit(None).cast("string")
    hit = (F.col("status") == "open") & F.col("_d").isNotNull()
    new = {
        "status": F.when(hit, F.col("_d.status")).otherwise(F.col("status")),
        "resolution": F.when(hit, F.col("_d.resolution")).otherwise(old("resolution")),
        "reviewer": F.when(hit, F.lit(reviewer)).otherwise(old("reviewer")),
        "corrected_value": F.when(hit, F.when(F.col("_d.status") == "fixed", F.col("_d.proposed")).otherwise("")).otherwise(old("corrected_value")),
    }
    return ledger.join(first, KEY, "left").withColumns(new).drop("_d")


def apply_reviewed(ledger: DataFrame, run: DataFrame, reviewed: DataFrame, decide: Callable[[Column], Column] = verdict, items_field: str = "smoking_status", dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(ledger, run, audit, summary)`` after a review; a dry run gives ledger and run as they are, and what would be done as audit and summary.

    The summary is one row ``(total_rows, papers_affected, papers_missing,
    findings_resolved, values_fixed)``. Reviewed papers that the run lacks are
    missing; nothing of theirs is applied.
    """
    papers = run.select(F.col("cov_nr").cast("string").alias("paper_id")).distinct()
    plan = planned(reviewed, decide).join(papers, "paper_id", "left_semi")
    new_run, audit = written_fixes(run, plan, items_field)
    asked = reviewed.select(_note(F.col("paper_id").cast("string")).alias("paper_id"))
    named = asked.where("paper_id <> ''").distinct()
    resolved = ledger.where("status = 'open'").join(plan.select(*KEY).distinct(), KEY, "left_semi")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    # Each side is one aggregated row.
    summary = n(asked, "total_rows").crossJoin(n(named, "papers_affected")).crossJoin(n(named.join(papers, "paper_id", "left_anti"), "papers_missing")).crossJoin(n(resolved, "findings_resolved")).crossJoin(n(audit, "values_fixed"))
    if dry_run:
        return ledger, run, audit, summary
    return closed(ledger, plan, "apply_reviewed"), new_run, audit, summary


def batch_review(ledger: DataFrame, reviewed: DataFrame, decide: Callable[[Column], Column] = verdict_by_prefix, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The ledger after a review by beginnings of notes, and one row ``(matched, applied, already_resolved, not_found, conflicts)``.

    A key with several different notes is a conflict and changes nothing.
    ``matched`` and ``not_found`` count keys, ``applied`` and
    ``already_resolved`` findings. A dry run counts and leaves the ledger.
    """
    rows = reviewed.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in KEY], _note(F.col("resolution_note")).alias("_note"))
    keys = rows.groupBy(*KEY).agg(F.count_distinct("_note").alias("notes"), F.min("_note").alias("_note")).withColumn("_v", decide(F.col("_note")))
    usable = keys.where("notes = 1 and _v is not null").select(*KEY, F.lit(0).cast("long").alias("place"), F.lit("").alias("proposed"), "_v.*")
    state = ledger.groupBy(*KEY).agg(F.count_if(F.col("status") == "open").alias("open"), F.count("*").alias("all"))
    usable_state = usable.join(state, KEY, "left")
    counts = usable_state.agg(
        F.count("all").alias("matched"), F.coalesce(F.sum("open"), F.lit(0)).alias("applied"), F.coalesce(F.sum(F.col("all") - F.col("open")), F.lit(0)).alias("already_resolved"), F.count_if(F.col("all").isNull()).alias("not_found")
    )
    counts = counts.crossJoin(keys.agg(F.count_if(F.col("notes") > 1).alias("conflicts")))
    return (ledger if dry_run else closed(ledger, usable, "batch")), counts


def open_findings(ledger: DataFrame, paper: str | None = None) -> DataFrame:
    """Open findings, of one paper if given, by paper and id."""
    rows = ledger.where("status = 'open'")
    return (rows.where(F.col("paper_id") == paper) if paper is not None else rows).orderBy("paper_id", "id")


def numbered(ledger: DataFrame) -> DataFrame:
    """The ledger with a stable ``id`` from 1 a paper, in order of category and message, where it has none of its own."""
    if "id" in ledger.columns:
        return ledger
    return ledger.withColumn("id", F.row_number().over(Window.partitionBy("paper_id").orderBy(*KEY[1:])))
