"""Validating result files of several diseases by one table of rules.

A catalogue gives each disease its fields, kinds, ranges, enums and vocabularies.
``compiled`` turns it into rows, so that rules are data: one join on the disease
lays each record beside its rules, and one expression dispatches by the rule's
kind. Records stay typed (VARIANT), so a number written as text is told from a
number. All checks of a file, of structure, types, ranges, sums and arms, end in
one table of findings, stamped with the version that made the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studygrid.functions.values import nearest_multiple
from studygrid.operators import checks
from studygrid.scratch import written

RULES = "disease string, field string, kind string, low double, high double, whole boolean, allowed array<string>, other string"
#: Numeric fields of days, whose fractions are mended to weeks, months or years.
DAYS = ("time_intervention_days", "time_followup_days", "time_total_days")
#: Fixed value: what a vocabulary item begins with.
PREFIX = "^([a-zA-Z0-9_-]+)"


def compiled(spark: SparkSession, catalogue: dict[str, dict]) -> DataFrame:
    """The rules of ``catalogue`` as rows ``RULES``.

    A disease has any of: ``required`` names, ``boolean`` and ``array`` names,
    ``enum`` and ``text_enum`` as field to allowed values, ``numeric`` as field to
    (low, high, whole), ``above`` and ``below`` as pairs of fields, and ``sum`` as
    (part, part, whole field).
    """
    rows = []
    for disease, have in catalogue.items():
        unknown = set(have) - {"required", "boolean", "array", "enum", "text_enum", "numeric", "above", "below", "sum"}
        if unknown:
            raise ValueError(f"{disease}: no kind of rule {sorted(unknown)}")
        add = lambda field, kind, low=None, high=None, whole=None, allowed=None, other=None, d=disease: rows.append((d, field, kind, low, high, whole, allowed, other))
        for kind in ("required", "boolean", "array"):
            for field in have.get(kind, ()):
                add(field, kind)
        for kind in ("enum", "text_enum"):
            for field, allowed in have.get(kind, {}).items():
                add(field, kind, allowed=[str(a) for a in allowed])
        for field, (low, high, whole) in have.get("numeric", {}).items():
            add(field, "numeric", None if low is None else float(low), None if high is None else float(high), whole)
        for kind in ("above", "below"):
            for field, other in have.get(kind, ()):
                add(field, kind, other=other)
        for one, two, whole in have.get("sum", ()):
            add(one, "sum", allowed=[whole], other=two)
    return spark.createDataFrame(rows, RULES)


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df``, to be broadcast if it is counted to have at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def records(files: DataFrame, paper: str = "paper_id", disease: str = "disease", text: str = "text") -> DataFrame:
    """``(paper_id, disease, prompt_version, position, kind, record)`` of each item of a file's list; invalid JSON is left out.

    A file that is no list gives one row without a position. ``kind`` is that of
    the file or item, of an item that is an object just OBJECT; ``record`` maps
    names to typed values, null if it is no object. Schemas of whole files and
    objects cost more than parsing them, so they are worked out for other kinds alone.
    """
    doc = files.select(F.col(paper).cast("string").alias("paper_id"), F.col(disease).alias("disease"), F.try_parse_json(F.col(text)).alias("doc")).where(F.col("doc").isNotNull())
    version = F.coalesce(F.try_variant_get("doc", "$[0]._metadata.prompt_version", "string"), F.lit(""))
    doc = doc.withColumns({"prompt_version": version, "items": F.try_variant_get("doc", "$", "array<variant>")})
    kind = F.when(F.col("items").isNull(), F.schema_of_variant("doc"))
    listed = doc.select("paper_id", "disease", "prompt_version", kind.alias("kind"), F.posexplode_outer("items").alias("position", "item"))
    rows = listed.where(F.col("position").isNotNull() | ~F.col("kind").startswith("ARRAY")).withColumn("record", F.try_variant_get("item", "$", "map<string,variant>"))
    item_kind = F.when(F.col("record").isNotNull(), "OBJECT").when(F.col("item").isNotNull(), F.schema_of_variant("item")).otherwise(F.when(F.col("position").isNull(), F.col("kind")).otherwise("VOID"))
    return rows.select("paper_id", "disease", "prompt_version", "position", item_kind.alias("kind"), "record")


def text_of(record: Column, field: str | Column) -> Column:
    return F.try_variant_get(F.try_element_at(record, F.lit(field) if isinstance(field, str) else field), "$", "string")


def _number(value: Column, kind: Column) -> Column:
    """The number of a value that is one; null for texts and booleans."""
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))


def _kind(value: Column) -> Column:
    return F.when(value.isNull(), "VOID").otherwise(F.schema_of_variant(value))


def number_of(record: Column, field: str) -> Column:
    value = F.try_element_at(record, F.lit(field))
    return _number(value, _kind(value))


def structure(found: DataFrame) -> DataFrame:
    """Findings of ``records`` that are no list, or no object."""
    bad = found.where(F.col("record").isNull())
    category = F.when(F.col("position").isNull(), "schema_not_list").otherwise("schema_not_dict")
    arm = F.when(F.col("position").isNotNull(), F.concat(F.lit("index_"), F.col("position").cast("string")))
    none = F.lit(None).cast("string")
    return bad.select("paper_id", arm.alias("arm"), F.lit("ERROR").alias("severity"), category.alias("category"), F.concat(F.lit("found "), F.lower("kind")).alias("message"), none.alias("fix_field"), none.alias("fix_value"), "prompt_version")


def _judged() -> Column:
    """Findings of one value ``v`` under its rule; ``vk`` and ``vn`` are its kind and number, ``vt`` its text, ``on`` the other field's number."""
    kind, text, number, say = F.col("vk"), F.col("vt"), F.col("vn"), lambda *x: F.concat(F.col("field"), F.lit(": "), *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("nothing")) for p in x])
    missing = (kind == "VOID") | ((kind == "STRING") & (text == "NA")) | F.coalesce(F.col("vj").isin("[]", '["NA"]'), F.lit(False))
    known = ~missing
    rule = F.col("rule")
    same_number = F.exists("allowed", lambda a: a.try_cast("double") == number)
    as_bool = F.when(kind == "BOOLEAN", F.array_contains("allowed", F.when(text == "true", "1").otherwise("0")))
    allowed = F.array_contains("allowed", text) | F.coalesce(same_number, F.lit(False)) | F.coalesce(as_bool, F.lit(False))
    whole = F.when(F.col("field").isin(*DAYS), nearest_multiple(number)).otherwise(F.bround(number)).cast("long")
    f = checks.finding
    by_kind = {
        "boolean": checks.only((known & (kind != "BOOLEAN"), f("WARNING", "type_boolean", say("no boolean but ", text)))),
        "enum": checks.only((known & ~F.coalesce(allowed, F.lit(False)), f("ERROR", "type_enum", say("not allowed: ", text)))),
        "text_enum": checks.only((known & ~((kind == "STRING") & F.array_contains("allowed", text)), f("ERROR", "type_enum", say("not allowed: ", text)))),
        "array": checks.only(((kind != "VOID") & ~kind.startswith("ARRAY") & ~((kind == "STRING") & (text == "NA")), f("ERROR", "type_array", say("no list but ", F.lower(kind))))),
        "numeric": checks.only(
            (known & number.isNull(), f("ERROR", "type_numeric", say("no number but ", text))),
            (F.col("whole") & (number != F.floor(number)), f("WARNING", "type_integer", say("no whole number: ", number), F.col("field"), whole)),
            (number < F.col("low"), f("ERROR", "range_violation", say(number, " is below ", F.col("low")))),
            (number > F.col("high"), f("ERROR", "range_violation", say(number, " is above ", F.col("high")))),
        ),
        "above": checks.only((number <= F.col("on"), f("WARNING", "range_order", say(number, " is not above ", F.col("other"))))),
        "below": checks.only((number >= F.col("on"), f("WARNING", "range_order", say(number, " is not below ", F.col("other"))))),
        "sum": checks.only((F.abs(number + F.col("on") - F.col("wn")) > 1, f("WARNING", "time_math", say(number, " and ", F.col("on"), " are not ", F.col("wn"))))),
    }
    out = F
    for name, found in by_kind.items():
        out = out.when(rule == name, found)
    return out


def rule_findings(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of all rules on values of each record's disease: one join on the disease, one projection, one explode."""
    side = few(rules.where("kind <> 'required'").withColumnsRenamed({"disease": "_d", "kind": "rule"}))
    objects = found.where(F.col("record").isNotNull())
    beside = objects.join(side, F.col("disease") == F.col("_d"))
    of = lambda field: F.try_element_at("record", field)
    sums = F.col("rule") == "sum"
    values = beside.select("paper_id", text_of(F.col("record"), "arm").alias("arm"), "prompt_version", "field", "rule", "low", "high", "whole", "allowed", "other", of(F.col("field")).alias("v"), F.when(F.col("other").isNotNull(), of(F.col("other"))).alias("o"), F.when(sums, of(F.get("allowed", F.lit(0)))).alias("w"))
    kinds = values.withColumns({"vk": _kind(F.col("v")), "vt": F.try_variant_get("v", "$", "string"), "on": _number(F.col("o"), _kind(F.col("o"))), "wn": _number(F.col("w"), _kind(F.col("w")))})
    kinds = kinds.withColumns({"vn": _number(F.col("v"), F.col("vk")), "vj": F.when(F.col("vk").startswith("ARRAY"), F.to_json("v"))})
    return kinds.select("paper_id", "arm", "prompt_version", F.explode(_judged()).alias("f")).select("paper_id", "arm", "f.*", "prompt_version")


def known_fields(rules: DataFrame) -> DataFrame:
    """``(_d, known)``: the fields that a disease requires, as often as it has the rule."""
    return rules.where("kind = 'required'").groupBy(F.col("disease").alias("_d")).agg(F.sort_array(F.collect_list("field")).alias("known"))


def field_checks(record: Column, known: Column) -> list[Column]:
    """Required fields that the record lacks, and fields that its disease does not require; ``_metadata`` is known to all."""
    known, names = F.coalesce(known, F.array().cast("array<string>")), F.map_keys(record)
    extra, lacking = F.array_except(names, F.concat(known, F.array(F.lit("_metadata")))), F.filter(known, lambda x: ~F.array_contains(names, x))
    return [
        F.transform(lacking, lambda x: checks.finding("ERROR", "schema_missing_field", F.concat(x, F.lit(": is missing")))),
        F.transform(extra, lambda x: checks.finding("ERROR", "schema_extra_field", x)),
    ]


def record_checks(record: Column, paper: Column) -> list[Column]:
    """The checks that every disease shares: the key is the file's name, the arm's name, counts of two sexes."""
    key, number = F.coalesce(text_of(record, "cov_nr"), F.lit("")), lambda name: number_of(record, name)
    return [
        checks.only((key != paper, checks.finding("ERROR", "schema_cov_nr_mismatch", F.concat(F.lit("key "), key)))),
        checks.arm_name(F.coalesce(text_of(record, "arm"), F.lit(""))),
        checks.shares(number("n"), number("gender_female_n"), number("gender_male_n"), number("gender_pct_female"), number("gender_pct_male")),
    ]


def validate_files(files: DataFrame, rules: DataFrame, equal: tuple[str, ...] = ("time_total_days",), more: Callable[[Column, Column], list[Column]] = record_checks) -> DataFrame:
    """All findings ``(paper_id, arm, severity, category, message, fix_field, fix_value, prompt_version)`` of ``files(paper_id, disease, text)``.

    ``more(record, paper_id)`` gives the checks of one record beside the rules;
    fields of ``equal`` must not differ across a paper's arms, and a stated number
    of arms (``_metadata.study_info.n_arms``) is that of the records. Files are
    parsed once, into a table of typed records that all layers read; only the
    checks across arms shuffle.
    """
    record, none = F.col("record"), F.lit(None).cast("string")
    stated = F.try_variant_get(F.try_element_at(record, F.lit("_metadata")), "$.study_info.n_arms", "int")
    # What the checks across arms ask for has its own columns, so that they read no records.
    asked = {"arm": text_of(record, "arm"), "n_arms": F.when(F.col("position") == 0, stated)} | {f"equal_{i}": text_of(record, c) for i, c in enumerate(equal)}
    found = written(records(files).withColumns(asked), "records")
    objects = found.where(record.isNotNull()).join(few(known_fields(rules)), F.col("disease") == F.col("_d"), "left")
    own = [F.coalesce(c, F.array().cast(f"array<{checks.ITEM}>")) for c in [*field_checks(record, F.col("known")), *more(record, F.col("paper_id"))]]
    # Worked out before the explode, where parts that checks share are worked out once.
    single = objects.select("paper_id", "arm", "prompt_version", F.flatten(F.array(*own)).alias("own")).select("paper_id", "arm", "prompt_version", F.explode("own").alias("f")).select("paper_id", "arm", "f.*", "prompt_version")
    arms = found.where(F.col("kind") == "OBJECT").select("paper_id", "arm", "prompt_version", "n_arms", *(F.col(f"equal_{i}").alias(c) for i, c in enumerate(equal)))
    across = checks.whole_paper(arms, "paper_id", "arm", list(equal), arms.select("paper_id", "n_arms"))
    versions = arms.groupBy("paper_id").agg(F.max("prompt_version").alias("prompt_version"))
    across = across.join(versions, "paper_id").select("paper_id", none.alias("arm"), "severity", "category", "message", "fix_field", "fix_value", "prompt_version")
    parts = [structure(found), rule_findings(found, rules), single, across]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def detected_disease(path: Column, record: Column) -> Column:
    """The disease by the path's folder (``copd/`` or ``copd_v9/``), else by fields that only its records have; null if neither tells."""
    out = F
    for name in ("copd", "cvd", "dm"):
        out = out.when(F.contains(path, F.lit(f"/{name}/")) | path.startswith(f"{name}/") | F.contains(path, F.lit(f"/{name}_v")), name)
    has = lambda *names: F.coalesce(F.map_contains_key(record, names[0]), F.lit(False)) if len(names) == 1 else has(names[0]) & has(*names[1:])
    return out.when(has("hba1c_pct_mean", "hba1c_severity"), "dm").when(has("nyha_class") | has("needs_discussion_nyha"), "cvd").when(has("fev1_pct_mean"), "copd")


def study_info(text: Column) -> Column:
    """The JSON text of the first record's ``_metadata.study_info``; ``{}`` on any fault."""
    return F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(text), "$[0]._metadata.study_info", "variant")), F.lit("{}"))


def vocabulary_issues(items: DataFrame, vocabulary: DataFrame, paper: str = "paper_id", arm: str = "arm") -> DataFrame:
    """``(paper_id, arm, value, prefix, issue, expected)`` of ``items(paper, arm, disease, value)`` against ``vocabulary(disease, word)``.

    ``case`` where a word differs in case alone, ``similar`` where the prefix
    begins with a word (the longest, then the first by name), else ``invalid``.
    "NA" and null pass. Each distinct prefix is looked up once, under all that it
    begins with, so that no pair of prefix and word is compared.
    """
    prefix = F.coalesce(F.nullif(F.regexp_extract("value", PREFIX, 1), F.lit("")), F.col("value"))
    asked = items.where("value <> 'NA'").select(F.col(paper).alias("paper_id"), F.col(arm).alias("arm"), "disease", "value", prefix.alias("prefix"))
    words = vocabulary.groupBy(F.col("disease").alias("d"), F.lower("word").alias("key")).agg(F.collect_set("word").alias("words"))
    distinct = asked.select("disease", "prefix").distinct()
    starts = distinct.select("disease", "prefix", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("prefix")), lambda n: F.lower(F.substring(F.col("prefix"), F.lit(1), n)))).alias("start"))
    met = starts.join(words, (F.col("disease") == F.col("d")) & (F.col("start") == F.col("key")))
    best = F.max_by(F.struct("start", "words"), F.char_length("start"))
    found = met.groupBy(F.col("disease").alias("d"), F.col("prefix").alias("p")).agg(best.alias("best"))
    joined = asked.join(found, (F.col("disease") == F.col("d")) & (F.col("prefix") == F.col("p")), "left")
    word, whole = F.array_min("best.words"), F.lower("prefix") == F.col("best.start")
    right = F.coalesce(F.array_contains("best.words", F.col("prefix")), F.lit(False))
    issue = F.when(whole, "case").when(F.col("best").isNotNull(), "similar").otherwise("invalid")
    return joined.where(~right).select("paper_id", "arm", "value", "prefix", issue.alias("issue"), word.alias("expected"))
