"""Whole analyses put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studygrid.functions import values as v
from studygrid.functions.texts import composed
from studygrid.operators import agreement, compare
from studygrid.scratch import written


#: Primary and secondary metric of each bucket.
METRICS = {
    "boolean": ("gwet_ac1", "percent_agreement"),
    "categorical": ("gwet_ac1", "percent_agreement"),
    "numerical": ("icc_2_1", "na_concordance_rate"),
    "structured_string_array": ("key_jaccard", "value_agreement_on_matched_keys"),
    "free_text": ("token_f1", None),
    "identifier": ("exact_match_rate", None),
    "EXCLUDED": ("excluded", None),
}
#: Numbers this near are no disagreement.
CLOSE = 0.01


def _typed(pairs: DataFrame) -> DataFrame:
    """``pairs`` with both sides normalised by bucket, missing tokens first: as text, number and (key, value) array, and whether each is missing."""

    def side(c: str) -> dict[str, Column]:
        text = F.when(~v.is_na(F.col(c)), composed(F.col(c)))
        bucket = F.col("bucket")
        plain = F.when(bucket == "boolean", v.boolean(text).cast("string")).when(bucket == "free_text", v.free_text(text)).when(bucket.isin("categorical", "identifier"), v.basic_string(text))
        number = F.when(bucket == "numerical", v.numeric(text))
        items = F.when(bucket == "structured_string_array", v.pairs_of_string(text))
        missing = plain.isNull() & number.isNull() & items.isNull()
        return {f"{c}_text": plain, f"{c}_number": number, f"{c}_items": items, f"{c}_na": missing}

    known = F.col("bucket").isin(*METRICS)
    return pairs.withColumn("bucket", F.when(known, F.col("bucket")).otherwise(F.raise_error(F.concat(F.lit("Unknown bucket: "), F.coalesce("bucket", F.lit("null")))))).select("*", *(x.alias(k) for c in ("a", "b") for k, x in side(c).items()))


def _paired(a: DataFrame, b: DataFrame, mapping: DataFrame, keys: list[str], name: str = "field") -> DataFrame:
    """Typed pairs of the mapping's fields; the mapping is broadcast if it is counted to be small."""
    fields = mapping.select("field_name", "bucket")
    fields = F.broadcast(fields) if fields.count() <= 10_000 else fields
    return _typed(compare.pair_up(a, b, keys).join(fields, "field_name")).withColumnRenamed("field_name", name)


def agreement_results(a: DataFrame, b: DataFrame, mapping: DataFrame, keys: list[str], thresholds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """``(field, bucket, n_compared, n_both_na, n_one_na, primary_name, primary_value, secondary_name, secondary_value, kappa, flagged, reason)``.

    ``kappa`` is Cohen's, of boolean and categorical fields. One row for each field of ``mapping(field_name, bucket)`` that both runs have.
    ``thresholds`` gives the least primary and secondary value of a bucket. A
    field without complete pairs has no values and is not flagged; an excluded
    field has neither counts; an unknown bucket raises.
    """
    # Paired and typed once, in a table that the metrics of all buckets read.
    pairs = written(_paired(a, b, mapping, keys), "pairs")
    some = pairs.where(F.col("bucket") != "EXCLUDED")
    whole = ~F.col("a_na") & ~F.col("b_na")
    # Means over rows and counts of all buckets come from one aggregation.
    equal = F.when(F.col("bucket") == "identifier", (F.col("a_text") == F.col("b_text")).cast("double"))
    shared = F.when(F.col("bucket") == "free_text", agreement.token_f1(F.col("a_text"), F.col("b_text")))
    counts = pairs.groupBy("field", "bucket").agg(
        F.count_if(whole & (F.col("bucket") != "EXCLUDED")).alias("n_compared"),
        F.count_if(F.col("a_na") & F.col("b_na") & (F.col("bucket") != "EXCLUDED")).alias("n_both_na"),
        F.count_if((F.col("a_na") != F.col("b_na")) & (F.col("bucket") != "EXCLUDED")).alias("n_one_na"),
        F.avg(F.when(whole, F.coalesce(equal, shared))).alias("mean"),
    )
    texts = some.where(F.col("bucket").isin("boolean", "categorical")).select("field", F.col("a_text").alias("a"), F.col("b_text").alias("b"))
    numbers = some.where(F.col("bucket") == "numerical").select("field", F.col("a_number").alias("a"), F.col("b_number").alias("b"))
    items = some.where(F.col("bucket") == "structured_string_array").select("field", F.col("a_items").alias("a"), F.col("b_items").alias("b"))
    found = agreement.categorical(texts).select("field", F.col("ac1").alias("p"), F.col("percent_agreement").alias("s"), "kappa")
    found = found.unionByName(agreement.numerical(numbers).select("field", F.col("icc").alias("p"), F.col("na_concordance").alias("s"), F.lit(None).cast("double").alias("kappa")))
    found = found.unionByName(agreement.structured(items).select("field", F.col("key_jaccard").alias("p"), F.col("value_agreement").alias("s"), F.lit(None).cast("double").alias("kappa")))
    names = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in (kv[0], kv[1][0])]), F.create_map(*[F.lit(x) for kv in METRICS.items() if kv[1][1] for x in (kv[0], kv[1][1])])
    out = counts.join(found, "field", "left")
    has = F.col("n_compared") > 0
    out = out.select("field", "bucket", "n_compared", "n_both_na", "n_one_na", names[0][F.col("bucket")].alias("primary_name"), F.when(has, F.coalesce("p", "mean")).alias("primary_value"), names[1][F.col("bucket")].alias("secondary_name"), F.when(has, F.col("s")).alias("secondary_value"), F.when(has, F.col("kappa")).alias("kappa"))
    reason = F.lit(None).cast("string")
    for bucket, (least, second) in thresholds.items():
        if least is None:
            continue
        own = (F.col("bucket") == bucket) & (F.col("n_compared") > 0)
        first, other = METRICS[bucket]
        why = F.when(F.col("primary_value").isNull(), f"{first} undefined").when(F.col("primary_value") < least, F.format_string(f"{first}=%.3f < {least}", "primary_value"))
        if second is not None and other:
            why = why.when(F.col("secondary_value").isNull(), f"{other} undefined").when(F.col("secondary_value") < second, F.format_string(f"{other}=%.3f < {second}", "secondary_value"))
        reason = F.when(own, why).otherwise(reason)
    return out.withColumn("reason", reason).withColumn("flagged", F.col("reason").isNotNull()).withColumn("reason", F.when((F.col("n_compared") == 0) & (F.col("bucket") != "EXCLUDED"), "no comparable cases").otherwise(F.col("reason")))


def disagreements(a: DataFrame, b: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """``(field, bucket, keys, value_a, value_b, only_in_a, only_in_b, mismatch)``: complete pairs that differ, after normalising.

    Numbers differ beyond ``CLOSE``; arrays by their sets of keys, else with a row
    for each key whose values do not match, the last of repeated keys counting.
    Free text and excluded fields have none.
    """
    pairs = _paired(a, b, mapping, keys, "field_name").where(~F.col("a_na") & ~F.col("b_na")).withColumnRenamed("field_name", "field")
    none, text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    plain = (F.col("bucket").isin("boolean", "categorical", "identifier") & (F.col("a_text") != F.col("b_text"))) | ((F.col("bucket") == "numerical") & (F.abs(F.col("a_number") - F.col("b_number")) > CLOSE))
    value = lambda c: F.coalesce(f"{c}_text", F.col(f"{c}_number").cast("string")).alias(f"value_{c}")
    simple = pairs.where(plain).select("field", "bucket", *keys, value("a"), value("b"), none.alias("only_in_a"), none.alias("only_in_b"), text.alias("mismatch"))
    items = pairs.where(F.col("bucket") == "structured_string_array").withColumns({"ka": F.array_distinct(F.col("a_items.key")), "kb": F.array_distinct(F.col("b_items.key"))})
    items = items.withColumns({"only_in_a": F.sort_array(F.array_except("ka", "kb")), "only_in_b": F.sort_array(F.array_except("kb", "ka"))})
    last = lambda c, k: F.element_at(F.filter(F.col(c), lambda x: x["key"] == k), -1)["value"]
    unlike = F.filter("ka", lambda k: ~agreement.values_match(last("a_items", k), last("b_items", k)))
    same = (F.size("only_in_a") == 0) & (F.size("only_in_b") == 0)
    shown = lambda c: F.array_join(F.transform(f"{c}_items", lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "~").alias(f"value_{c}")
    by_keys = items.where(~same).select("field", "bucket", *keys, shown("a"), shown("b"), "only_in_a", "only_in_b", text.alias("mismatch"))
    by_value = items.where(same).select("field", "bucket", *keys, shown("a"), shown("b"), none.alias("only_in_a"), none.alias("only_in_b"), F.explode(unlike).alias("mismatch"))
    return simple.unionByName(by_keys).unionByName(by_value)


def one_sided(a: DataFrame, b: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """``(field, bucket, keys, missing_in)``: pairs of which one side alone is missing after normalising."""
    pairs = _paired(a, b, mapping, keys, "field_name").where((F.col("bucket") != "EXCLUDED") & (F.col("a_na") != F.col("b_na")))
    return pairs.select(F.col("field_name").alias("field"), "bucket", *keys, F.when(F.col("a_na"), "a").otherwise("b").alias("missing_in"))


def undersampled(results: DataFrame, least: int = 5) -> DataFrame:
    """Results of ``agreement_results`` with ``undersampled``: fewer than ``least`` complete pairs."""
    return results.withColumn("undersampled", F.col("n_compared") < least)
