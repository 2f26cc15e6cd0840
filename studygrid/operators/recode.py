"""Making values of two extractions comparable by their JSON types, and the queue of what people must settle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that are compared as reported or not, and words for nothing.
REPORT_ONLY = ("educational_level", "ethnicity", "health_literacy")
NOTHING = ("na", "n/a", "nan", "")
NOTHING_ITEM = ("NA", "N/A", "")


def _says(text: Column) -> Column:
    return ~F.lower(F.trim(text)).isin(*NOTHING)


def _kind(value: Column) -> Column:
    """list, number, boolean, string or null of a typed value."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | (kind == "VOID"), "null").when(kind.startswith("ARRAY"), "list").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("OBJECT"), "object").otherwise("number")


def _items(value: Column) -> Column:
    """Items of a list as texts."""
    return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x), F.lit("null")))


def _content(value: Column) -> Column:
    """Whether a list has an item that says something."""
    return F.coalesce(F.exists(_items(value), lambda x: ~F.upper(F.trim(x)).isin(*NOTHING_ITEM)), F.lit(False))


def recoded(pairs: DataFrame, report_only: tuple[str, ...] = REPORT_ONLY) -> DataFrame:
    """``pairs(field_name, bucket, a, b)``, values as JSON texts, with the three recoded for comparison as plain texts.

    ``a`` is the model's value, ``b`` the earlier one. Fields of ``report_only``
    become boolean: ``a`` by its type (a list that says something, a number other
    than zero, a text other than a word for nothing), ``b`` only if it is such a
    text. In other boolean fields a list of ``a`` and any ``b`` are recoded so. A
    single text of a structured field is a list of one; lists are joined by ``~``.
    A text that is no JSON counts as a string.
    """
    typed = lambda c: F.coalesce(F.try_parse_json(F.col(c)), F.col(c).cast("string").cast("variant"))
    rows = pairs.withColumns({"_a": typed("a"), "_b": typed("b")})
    rows = rows.withColumns({"_ak": _kind(F.col("_a")), "_bk": _kind(F.col("_b")), "_at": F.try_variant_get("_a", "$", "string"), "_bt": F.try_variant_get("_b", "$", "string")})
    reported, boolean = F.col("field_name").isin(*report_only), F.col("bucket") == "boolean"
    number = F.when(F.col("_ak") == "boolean", F.col("_at") == "true").otherwise(F.col("_at").try_cast("double") != 0)
    of_a = F.when(F.col("_ak") == "list", _content(F.col("_a"))).when(F.col("_ak").isin("number", "boolean"), number).when(F.col("_ak") == "string", _says(F.col("_at"))).otherwise(False)
    of_b = (F.col("_bk") == "string") & _says(F.coalesce("_bt", F.lit("")))
    plain = lambda c: F.when(F.col(f"_{c}k") == "list", F.array_join(_items(F.col(f"_{c}")), "~")).when(F.col(f"_{c}k") != "null", F.coalesce(f"_{c}t", F.to_json(f"_{c}")))
    a = F.when(reported | (boolean & (F.col("_ak") == "list")), of_a.cast("string")).otherwise(plain("a"))
    b = F.when(reported | boolean, of_b.cast("string")).otherwise(plain("b"))
    changed = rows.withColumns({"_na": a, "_nb": b, "_bucket": F.when(reported, "boolean").otherwise(F.col("bucket"))})
    new = {"a": "_na", "b": "_nb", "bucket": "_bucket"}
    return changed.select(*(F.col(new.get(c, c)).alias(c) for c in pairs.columns))


def adjudication_queue(disagreements: DataFrame, mapping: DataFrame, keys: list[str], tier: str | None = "A_reference") -> DataFrame:
    """``(field_name, keys, llm_value, prior_value, adjudication, adjudicator_note)``, the last two empty: disagreements of the fields whose ``tier1_prior_extraction`` is ``tier``, or of all."""
    rows = disagreements.withColumnRenamed("field", "field_name")
    if tier is not None:
        rows = rows.join(mapping.where(F.col("tier1_prior_extraction") == tier).select("field_name").distinct(), "field_name", "left_semi")
    empty = F.lit("")
    return rows.select("field_name", *keys, F.col("value_a").alias("llm_value"), F.col("value_b").alias("prior_value"), empty.alias("adjudication"), empty.alias("adjudicator_note"))
