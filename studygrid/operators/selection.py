"""Choosing what a run works on: lookups with their gaps counted, seeded samples, value counts, and work that is not done yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studygrid.scratch import written
from studygrid.streaming.tables import PARTITIONS, merge_into, part_of, read_table

MANIFEST = "key string, version string, hash string"


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str, needed: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the columns of ``lookup``, and one row ``(rows, unmatched)``: how many have no ``needed`` value.

    A key that repeats in ``lookup`` is an error, as it would multiply rows.
    """
    repeated = lookup.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).limit(1).collect()
    if repeated:
        raise ValueError(f"{key} repeats: {repeated[0][key]}")
    joined = rows.join(lookup.where(F.col(key).isNotNull()), key, "left")
    return joined, joined.agg(F.count("*").alias("rows"), F.count_if(F.col(needed).isNull()).alias("unmatched"))


def with_group_values(members: DataFrame, groups: DataFrame, key: str, columns: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Members with their group's ``columns``, those left out that lack one of them or of their own columns ``also``."""
    joined = members.drop(*columns).join(groups.select(key, *columns), key, "left")
    return joined.na.drop(subset=[*columns, *also])


def value_counts(df: DataFrame, column: str, missing: bool = False) -> DataFrame:
    """``(value, n, pct)`` as texts with the most frequent first, ties by value; nulls and NaN count as one value if ``missing``, else not at all."""
    text = F.col(column).cast("string")
    value = F.when(F.isnan(F.col(column)), None).otherwise(text) if df.schema[column].dataType.simpleString() in ("double", "float") else text
    rows = df.select(value.alias("value"))
    counted = (rows if missing else rows.where(F.col("value").isNotNull())).groupBy("value").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("value", "n", (100.0 * F.col("n") / F.col("total")).alias("pct")).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())


def draw(key: str, seed: int) -> Column:
    """A number of each key that depends on it and the seed alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int | None = None, by: str | None = None) -> DataFrame:
    """The ``n`` rows of lowest draw, or of lowest key without a seed; with ``by``, of each group.

    Each task keeps its own ``n`` and these merge, so rows are neither sorted as a
    whole nor gathered, and any partitioning gives the same sample.
    """
    order = [draw(key, seed), F.col(key)] if seed is not None else [F.col(key)]
    if by is None:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("_nth") <= n).drop("_nth")


def distinct_keys(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def members_of(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """One row ``(groups, n)``: how many groups of ``groups(key)`` have rows, and the sum of ``n`` over these."""
    return rows.join(groups.select(key).distinct(), key, "left_semi").agg(F.count_distinct(key).alias("groups"), F.coalesce(F.sum(n), F.lit(0)).alias("n"))


def unprocessed(spark: SparkSession, inputs: DataFrame, manifest: str, key: str, version: str, content: str, partitions: int = PARTITIONS) -> DataFrame:
    """The rows of ``inputs`` that no committed output stands for: of a new key, another version or other content.

    The manifest has a row for each key and only those partitions are read that
    inputs fall into.
    """
    digest = F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")).cast("binary"), 256)
    parts = [r["p"] for r in inputs.select(part_of(key, partitions).alias("p")).distinct().collect()]
    done = read_table(spark, manifest, MANIFEST, "key").where(part_of("key", partitions).isin(parts)).select(F.col("key").alias("_k"), F.col("version").alias("_v"), F.col("hash").alias("_h"))
    same = (F.col(key).cast("string") == F.col("_k")) & (F.col(version).cast("string").eqNullSafe(F.col("_v"))) & (digest == F.col("_h"))
    return inputs.join(done, same, "left_anti")


def process_new(spark: SparkSession, inputs: DataFrame, manifest: str, outputs: str, schema: str, work: Callable[[DataFrame], DataFrame], key: str = "key", version: str = "version", content: str = "content", partitions: int = PARTITIONS) -> int:
    """Runs ``work`` on what is not done yet, puts its rows (of ``schema``, with ``key``) in place of those of the same keys in the table ``outputs``, then commits the manifest; gives back how many inputs it worked on.

    A run that breaks off before its commit is done again whole. Inputs without a
    key are an error; of a key that repeats, too.
    """
    bad = inputs.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{key} is missing or repeats: {bad[0][key]}")
    todo = written(unprocessed(spark, inputs, manifest, key, version, content, partitions), "todo")
    n = todo.count()
    if n:
        made = written(work(todo), "outputs")
        keys = todo.select(F.col(key).cast("string").alias(key))
        again = lambda before: before.join(keys, key, "left_anti").unionByName(made)
        merge_into(spark, outputs, schema, key, keys, again, partitions)
        digest = F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")).cast("binary"), 256)
        rows = todo.select(F.col(key).cast("string").alias("key"), F.col(version).cast("string").alias("version"), digest.alias("hash"))
        merge_into(spark, manifest, MANIFEST, "key", rows, lambda before: before.join(rows.select("key"), "key", "left_anti").unionByName(rows), partitions)
    return n
