"""Checks of arm records that need more than one value: sums, list items, vocabularies, flags, whole papers.

A check of a record is a Column: an array of findings, empty if all is well. All
checks of a run go into one projection and one explode. Nulls pass every check
that does not ask for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the count of ``Label: N (P%)`` or ``Label: N``, among items with ``BREAK`` between them.
BREAK = "\x1e"
COUNT = r"(?<=^|\x1e)[^:\x1e]*:\s*(\d+)\s*(?:\(\d+\.?\d*\s*%\)\s*)?(?=\x1e|$)"
#: Endings that name a statistic.
STATISTICS = ("mean", "sd", "se", "median", "iqr", "range", "n", "pct", "category", "distribution", "total")
#: Fixed value: prefixes of any comorbidity.
COMORBIDITY = r"^comorbid_[a-zA-Z][a-zA-Z0-9_]+_(pct|n)$"
#: Fixed value: free names that are allowed.
SNAKE_CASE = r"^[a-zA-Z][a-zA-Z0-9]*(_[a-zA-Z0-9]+)*$"
#: Bands of long-term blood sugar, as upper bounds that belong to the band or not.
SUGAR_BANDS = ((7.5, False, "Mild"), (9.0, True, "Moderate"), (None, True, "Severe"))

ITEM = "struct<severity:string,category:string,message:string,fix_field:string,fix_value:string>"


def _text(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string")


def finding(severity: str, category: str, message: Column, fix_field=None, fix_value=None) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.coalesce(message, F.lit(category)).alias("message"), _text(fix_field).alias("fix_field"), _text(fix_value).alias("fix_value"))


def only(*tests: tuple[Column, Column]) -> Column:
    """The findings whose test holds; an unknown test does not."""
    # Arrays put together without a lambda, which would leave its whole argument to interpreted evaluation.
    none = F.array().cast(f"array<{ITEM}>")
    return F.concat(*[F.when(F.coalesce(test, F.lit(False)), F.array(item.cast(ITEM))).otherwise(none) for test, item in tests])


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def collect(df: DataFrame, paper: str, arm: str, checks: list[Column]) -> DataFrame:
    """``(paper_id, arm, severity, category, message, fix_field, fix_value)`` of all checks, in one pass."""
    all_ = F.flatten(F.array(*[F.coalesce(c, F.array().cast(f"array<{ITEM}>")) for c in checks]))
    return df.select(F.col(paper).cast("string").alias("paper_id"), F.col(arm).cast("string").alias("arm"), F.explode(all_).alias("f")).select("paper_id", "arm", "f.*")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, as lambdas share no common parts."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def arm_name(arm: Column) -> Column:
    """Names begin with control or treat and hold no parentheses; null counts as empty."""
    a = F.coalesce(arm, F.lit(""))
    return only(
        (~a.rlike("^(control|treat)"), finding("ERROR", "schema_arm_naming", _say("arm ", a, " is neither control nor treat"))),
        (a.rlike("[()]"), finding("WARNING", "schema_arm_naming", _say("arm ", a, " has parentheses"))),
    )


def shares(n: Column, female: Column, male: Column, female_pct: Column, male_pct: Column, tolerance: float = 1.0) -> Column:
    """Counts of two sexes against ``n`` and against the stated percentages; without a positive ``n`` nothing is checked."""
    both = female.isNotNull() & male.isNotNull()
    again = lambda part: F.round(part / F.nullif(n, F.lit(0)) * 100, 2)
    off = lambda part, pct: both & (F.abs(again(part) - pct) > tolerance)
    tests = only(
        (female + male != n, finding("WARNING", "gender_math_count_sum", _say("counts ", female, " + ", male, " are not ", n))),
        (off(female, female_pct), finding("WARNING", "gender_math_pct_mismatch", _say("female: stated ", female_pct, ", counted ", again(female)))),
        (off(male, male_pct), finding("WARNING", "gender_math_pct_mismatch", _say("male: stated ", male_pct, ", counted ", again(male)))),
        (both & (F.abs(female_pct + male_pct - 100) > tolerance), finding("WARNING", "gender_math_pct_sum", _say("percentages sum to ", female_pct + male_pct))),
    )
    return F.when(n > 0, tests)


def item_format(field: str, items: Column, commas: bool = True) -> Column:
    """List items with a pipe, or (if ``commas``) with several categories: two % signs or more and a comma."""
    pipe = F.transform(F.filter(items, lambda x: F.contains(x, F.lit("|"))), lambda x: finding("ERROR", "array_format_pipe", _say(f"{field}: ", x)))
    if not commas:
        return pipe
    several = lambda x: (F.length(x) - F.length(F.replace(x, F.lit("%"), F.lit(""))) >= 2) & F.contains(x, F.lit(", "))
    return F.concat(pipe, F.transform(F.filter(items, several), lambda x: finding("WARNING", "array_format_comma", _say(f"{field}: ", x))))


def item_sum(field: str, items: Column, n: Column, missing: str | None = None) -> Column:
    """Counts of ``Label: N (P%)`` items against ``n``.

    Too few is a finding only where ``missing`` names the label of those left
    over, and then has the missing item as its fix. Items without a count do not
    take part; a list without any is not checked.
    """
    # One pattern over all items of a list.
    counts = F.regexp_extract_all(F.array_join(items, BREAK), F.lit(COUNT), F.lit(1))

    def judge(total: Column) -> Column:
        low = finding("WARNING", "array_sum_count_low", _say(f"{field}: ", total, " of ", n), field, _say(f"{missing}: ", (n - total).cast("long")) if missing else None)
        high = finding("WARNING", "array_sum_count_high", _say(f"{field}: ", total, " of only ", n))
        return F.when(total > 0, only((F.lit(missing is not None) & (total < n), low), (total > n, high)))

    return F.when(n > 0, _once(F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x.try_cast("long"), F.lit(0))), judge))


def _lookup(words: list[str]) -> Column:
    """Lower case -> the word, as a literal map; of words that differ by case alone the first counts."""
    table: dict[str, str] = {}
    for w in words:
        table.setdefault(w.lower(), w)
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def canonical(prefix: Column, vocabulary: list[str]) -> Column:
    """The vocabulary's spelling of a prefix: itself, then without one statistic, then as a mean; null if there is none."""
    words = _lookup(vocabulary)
    find = lambda key: F.try_element_at(words, F.lower(key))
    bare = lambda word: F.substring(word, F.lit(1), F.length(word) - 5)
    mean = lambda key: bare(find(F.concat(key, F.lit("_mean"))))

    def without(ending: Column) -> Column:
        base = F.when(ending != "", F.substring(prefix, F.lit(1), F.length(prefix) - F.length(ending)))
        return F.concat(F.coalesce(find(base), mean(base)), ending)

    return F.coalesce(find(prefix), _once(F.regexp_extract(prefix, f"(_(?:{'|'.join(STATISTICS)}))$", 1), without), mean(prefix))


def item_prefixes(items: Column, vocabulary: list[str]) -> Column:
    """Prefixes (before the colon) of list items against a vocabulary.

    Wrong case has the corrected item as its fix; a name that is no snake case
    is unknown. ``other``, ``NA`` and notes for discussion pass. The vocabulary is
    a literal of the plan, so it is meant for hundreds of words.
    """

    def judge(x: Column, p: Column, right: Column) -> Column:
        skipped = (p == "") | (p == "other") | (p == "NA") | p.startswith("Needs Discussion") | p.rlike(COMORBIDITY)
        fixed = F.concat(right, F.substring(x, F.instr(x, ":"), F.length(x)))
        casing = finding("WARNING", "severity_prefix_casing", _say(p, " should be ", right), p, fixed)
        unknown = finding("WARNING", "severity_prefix_unknown", _say(p, " is not known"))
        return F.when((right == p) | skipped, None).when(right.isNotNull(), casing).when(~p.rlike(SNAKE_CASE), unknown)

    def each(x: Column) -> Column:
        return _once(F.trim(F.substring_index(x, ":", 1)), lambda p: _once(canonical(p, vocabulary), lambda right: judge(x, p, right)))

    return F.array_compact(F.transform(F.filter(items, lambda x: F.contains(x, F.lit(":"))), each))


def graded(field: str, value: Column, label: Column, bands=SUGAR_BANDS) -> Column:
    """A label against the band of its value; the band's label is the fix."""
    right = F
    for top, closed, name in bands:
        right = right.otherwise(name) if top is None else right.when((value <= top) if closed else (value < top), name)
    return only((value.isNotNull() & (label != "NA") & (label != right), finding("WARNING", f"{field}_mismatch", _say(value, ": ", label, " should be ", right), field, right)))


def discussion(flags: dict[str, tuple[Column, Column]], many: int = 3) -> Column:
    """Flags ``{name: (raised, explanation)}``: raised without an explanation (null or NA), and ``many`` raised or more."""
    mute = [(raised & (F.coalesce(why, F.lit("NA")) == "NA"), finding("ERROR", "needs_discussion_flag", F.lit(f"{name} has no explanation"))) for name, (raised, why) in flags.items()]
    n = sum((F.coalesce(raised, F.lit(False)).cast("int") for raised, _ in flags.values()), F.lit(0))
    return only(*mute, (n >= many, finding("WARNING", "needs_discussion_flag", _say(n, " flags"))))


def nothing_but_na(items: Column) -> Column:
    return (F.size(items) == 1) & (F.try_element_at(items, F.lit(1)) == "NA")


def missing_class(field: str, items: Column, flagged: Column) -> Column:
    """``["NA"]`` without a flag for discussion."""
    return only((nothing_but_na(items) & ~flagged, finding("INFO", f"needs_discussion_{field}_na", F.lit(f"{field} is NA and not flagged"))))


def sentinel(df: DataFrame, paper: str, arm: str, field: str, history: DataFrame) -> DataFrame:
    """Findings of arms whose list ``field`` is ``["NA"]``, told by ``history(paper, version, field)`` of prior runs.

    The message says whether all prior runs lack it too, or names the first that had it.
    """
    old = history.groupBy(paper).agg(
        F.count("*").alias("runs"),
        F.coalesce(F.bool_and(F.coalesce(nothing_but_na(F.col(field)), F.lit(False))), F.lit(False)).alias("never"),
        F.min(F.when((F.size(field) > 0) & ~nothing_but_na(F.col(field)), F.col("version"))).alias("had"),
    )
    bad = df.where(nothing_but_na(F.col(field))).select(paper, arm)
    note = F.when(F.col("never"), _say("; so in ", F.col("runs"), " prior runs")).when(F.col("had").isNotNull(), _say("; run ", F.col("had"), " had it")).otherwise("")
    out = finding("WARNING", f"{field}_na", F.concat(F.lit(f"{field} is NA"), note))
    return bad.join(old, paper, "left").select(F.col(paper).cast("string").alias("paper_id"), F.col(arm).cast("string").alias("arm"), out.alias("f")).select("paper_id", "arm", "f.*")


def whole_paper(df: DataFrame, paper: str, arm: str, equal: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Findings of papers: fields that differ across arms, no control or treatment arm, another number of arms than expected.

    Only papers of two arms or more are compared; null and NA are equal.
    ``expected(paper, n_arms)`` with null or zero is not checked. One shuffle on
    the paper serves all of them.
    """
    same = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    g = df.groupBy(paper).agg(
        F.count("*").alias("_n"),
        F.coalesce(F.bool_or(F.col(arm) == "control"), F.lit(False)).alias("_control"),
        F.coalesce(F.bool_or(F.col(arm).startswith("treat")), F.lit(False)).alias("_treat"),
        *[(F.min(same(c)) != F.max(same(c))).alias(f"_e{i}") for i, c in enumerate(equal)],
    )
    tests = [((F.col("_n") >= 2) & F.col(f"_e{i}"), finding("ERROR", "cross_arm_time", F.lit(f"{c} differs across arms"))) for i, c in enumerate(equal)]
    tests.append(((F.col("_n") >= 2) & ~F.col("_treat"), finding("WARNING", "cross_arm_missing_treat", F.lit("no treatment arm"))))
    tests.append(((F.col("_n") >= 2) & ~F.col("_control"), finding("WARNING", "cross_arm_missing_control", F.lit("no control arm"))))
    if expected is not None:
        g = g.join(expected.groupBy(paper).agg(F.max("n_arms").alias("_expected")), paper, "left")
        tests.append(((F.col("_expected") > 0) & (F.col("_expected") != F.col("_n")), finding("ERROR", "arm_count_mismatch", _say("expected ", F.col("_expected"), " arms, found ", F.col("_n")))))
    return collect(g.withColumn("_arm", F.lit(None).cast("string")), paper, "_arm", [only(*tests)])


def json_kind(value: Column) -> Column:
    """string, array, object, boolean, null or number, by the first character of JSON text."""
    c = F.substring(F.ltrim(value), 1, 1)
    return F.when(c == '"', "string").when(c == "[", "array").when(c == "{", "object").when(c.isin("t", "f"), "boolean").when(c == "n", "null").when(c.rlike("[-0-9]"), "number")


def field_types(run: DataFrame, kinds: dict[str, str], paper: str = "cov_nr", arm: str = "arm") -> DataFrame:
    """Findings of long JSON values of another kind than declared; null and ``"NA"`` pass. Booleans are warnings, the rest errors."""
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    rows = run.withColumn("_want", F.try_element_at(table, F.col("field_name"))).withColumn("_is", json_kind(F.col("value")))
    bad = rows.where((F.col("_want") != F.col("_is")) & (F.col("_is") != "null") & (F.col("value") != '"NA"'))
    return bad.select(
        F.col(paper).cast("string").alias("paper_id"),
        F.col(arm).cast("string").alias("arm"),
        F.when(F.col("_want") == "boolean", "WARNING").otherwise("ERROR").alias("severity"),
        F.concat(F.lit("type_"), F.when(F.col("_want") == "number", "numeric").otherwise(F.col("_want"))).alias("category"),
        _say(F.col("field_name"), " is of kind ", F.col("_is")).alias("message"),
    )


def field_sets(run: DataFrame, required: list[str], allowed: list[str], paper: str = "cov_nr", arm: str = "arm") -> DataFrame:
    """Findings of arms that lack a required field, or have one that is neither allowed nor required (``_`` names pass)."""
    have = F.collect_set("field_name")
    g = run.groupBy(F.col(paper).cast("string").alias("paper_id"), F.col(arm).cast("string").alias("arm")).agg(have.alias("have"))
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    gone = F.transform(F.array_except(lit(required), "have"), lambda x: finding("ERROR", "schema_missing_field", x))
    extra = F.transform(F.filter(F.array_except("have", lit([*required, *allowed])), lambda x: ~x.startswith("_")), lambda x: finding("ERROR", "schema_extra_field", x))
    return g.select("paper_id", "arm", F.explode(F.concat(gone, extra)).alias("f")).select("paper_id", "arm", "f.severity", "f.category", "f.message")
