"""Reading and writing runs: records as JSON or JSON lines, mappings, cohorts, wide CSV."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studygrid.dealing import dealt

KEYS = ("cov_nr", "arm")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``(cov_nr, arm, field_name, value)`` of a run, values as JSON text of their own type.

    ``.jsonl``: one record or list a line, blank lines skipped; ``.json``: a
    record, a list, or a list of lists a file. ``needs_discussion_*`` fields are
    left out. A record without ``cov_nr`` is an error.
    """
    lines = spark.read.text(path, wholetext=not path.rstrip("*/").endswith(".jsonl")).where(F.trim("value") != "")
    kind = "array<variant>"
    doc = F.parse_json("value")
    listed = F.when(F.schema_of_variant(doc).startswith("ARRAY"), F.try_variant_get(doc, "$", kind)).otherwise(F.array(doc))
    items = lines.select(F.explode(listed).alias("v"))
    nested = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", kind)).otherwise(F.array("v"))
    arms = items.select(F.explode(nested).alias("v"))
    cov = F.try_variant_get("v", "$.cov_nr", "string")
    arms = arms.select(F.when(cov.isNull(), F.raise_error(F.lit("a record has no cov_nr"))).otherwise(cov).alias("cov_nr"), F.try_variant_get("v", "$.arm", "string").alias("arm"), F.to_json("v").alias("j"))
    keys = F.json_object_keys("j")
    fields = arms.select("cov_nr", "arm", F.explode(F.filter(keys, lambda k: ~k.isin(*KEYS) & ~k.startswith("needs_discussion_"))).alias("field_name"), "j")
    value = F.to_json(F.try_variant_get(F.parse_json("j"), "$", "map<string,variant>")[F.col("field_name")])
    return fields.select("cov_nr", "arm", "field_name", value.alias("value"))


def read_mapping(spark: SparkSession, path: str, key: str = "field_name") -> DataFrame:
    """A CSV whose ``key`` must be unique."""
    table = spark.read.csv(path, header=True)
    repeated = table.groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} repeats: {repeated[0][key]}")
    return table


def read_cohort(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``(cohort, variable, n, mean, sd, note)`` from a CSV with # comments and decimal commas."""
    table = spark.read.csv(path, header=True, comment="#")
    number = lambda c: F.replace(F.trim(F.col(c)), F.lit(","), F.lit(".")).try_cast("double").alias(c)
    return table.where(F.trim("variable") != "").select(F.lit(name).alias("cohort"), "variable", F.col("n").try_cast("int").alias("n"), number("mean"), number("sd"), "note")


def read_cohorts(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame:
    """``read_cohort`` of each file of ``files`` (cohort to name) that is in ``folder``; those that are missing are skipped."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = lambda p: hadoop.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(p))
    found = [read_cohort(spark, f"{folder}/{file}", name) for name, file in files.items() if there(f"{folder}/{file}")]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "cohort string, variable string, n int, mean double, sd double, note string")


def schema_hash(df: DataFrame) -> str:
    """Eight digits that change with the column names, whatever their order: SHA-256 of their sorted JSON list."""
    return hashlib.sha256(json.dumps(sorted(df.columns)).encode()).hexdigest()[:8]


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """``(cov_nr, publication_year, country)`` from a ``;`` CSV: byte-order mark, tabs, # and outer blanks are dropped."""
    table = spark.read.csv(path, header=True, sep=";")
    clean = lambda c: F.trim(F.translate(F.col(f"`{c}`"), "﻿\t", ""))
    found = {}
    for c in table.columns:
        for prefix, name in (("cov", "cov_nr"), ("year", "publication_year"), ("country", "country")):
            if c.replace("﻿", "").strip().lower().startswith(prefix):
                found.setdefault(name, clean(c))
    return table.select(F.ltrim(found["cov_nr"], F.lit("#")).try_cast("int").alias("cov_nr"), found["publication_year"].try_cast("int").alias("publication_year"), found["country"].alias("country"))


def read_papers(spark: SparkSession, folder: str, diseases: tuple[str, ...] | None = None) -> DataFrame:
    """``(path, disease, cov_nr, text)`` of the ``*.md`` files of one folder, not of those below it; with ``diseases``, a folder of another name is an error."""
    table = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    disease = F.element_at(F.split(path, "/"), -2)
    if diseases is not None:
        disease = F.when(disease.isin(*diseases), disease).otherwise(F.raise_error(F.concat(F.lit("unknown disease: "), disease)))
    return table.select(path.alias("path"), disease.alias("disease"), F.substring(F.regexp_replace(F.url_decode(stem), "^#", ""), 1, 4).alias("cov_nr"), F.col("value").alias("text"))


def _first_places(run: DataFrame, place: str | None) -> DataFrame:
    """``(field_name, at, n, names)``: where each field comes first and how many values it has; with the set, of one name each, fields are found by hash and not by a sort of all values."""
    at = F.struct(*KEYS, *([place] if place else []), "field_name")
    return run.groupBy("field_name").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"), F.collect_set("field_name").alias("names"))


def wide_records(run: DataFrame, fields: list[str] | None = None, place: str | None = None) -> DataFrame:
    """A row for each record of a long run with JSON values, lists joined by ``~``, null as empty text, booleans as True and False.

    The columns are ``fields``, or all of the run in the order of their first
    place: by key, then the column ``place`` if there is one, then name. A field
    that repeats in a record is an error. The run's values are counted, and dealt
    to so many tasks that none sorts more than ``dealing.LARGE`` of them.
    """
    if fields is None:
        found = _first_places(run, place).orderBy("at").limit(10_001).collect()
        if len(found) > 10_000:
            raise ValueError("more than 10,000 fields")
        fields, n = [r["field_name"] for r in found], sum(r["n"] for r in found)
    else:
        n = run.where(F.col("field_name").isin(*fields)).count()
    value = F.try_parse_json("value")
    kind = lambda x: F.schema_of_variant(x)
    plain = lambda x: F.when(kind(x) == "BOOLEAN", F.initcap(F.try_variant_get(x, "$", "string"))).otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.when(kind(x) == "VOID", "None").otherwise(plain(x)))
    text = F.coalesce(F.array_join(listed, "~"), F.when(value.isNull(), F.col("value")).when(kind(value) != "VOID", plain(value)))
    cells = dealt(run.where(F.col("field_name").isin(*fields)).select(*KEYS, "field_name", text.alias("value")), n, *KEYS)
    wide = cells.groupBy(*KEYS).pivot("field_name", fields).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    cell = lambda c: F.when(F.col(f"`{c}_n`") > 1, F.raise_error(F.concat(F.lit(f"{c} repeats in "), F.concat_ws(" ", *KEYS)))).otherwise(F.coalesce(F.col(f"`{c}_v`"), F.lit("")))
    return wide.select(*KEYS, *(cell(c).alias(c) for c in fields))


def write_wide_csv(run: DataFrame, path: str, fields: list[str] | None = None, place: str | None = None) -> None:
    """``wide_records`` as CSV with a header."""
    wide_records(run, fields, place).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_records(df: DataFrame, path: str, metadata: dict[str, str], keys: tuple[str, ...] = ("disease", "version")) -> None:
    """JSON lines with ``_metadata`` on every record, partitioned by ``keys``."""
    df.withColumn("_metadata", F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])).write.mode("append").partitionBy(*keys).json(path)
