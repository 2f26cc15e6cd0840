"""Tables that are merged in place by hash partitions.

A table is Parquet, dealt by a hash of its key into a fixed number of partitions.
A merge reads the partitions of the keys it is given, and writes those that it
changes by dynamic partition overwrite; all others stay the files they are. A
merge that is run again finds nothing to change, so a batch that failed half way
can be repeated. A partition that is left without rows keeps one without a key.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studygrid.scratch import written

PARTITIONS = 64


def part_of(key: str, partitions: int = PARTITIONS):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(partitions)).cast("int")


def _files(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, part int")
    return spark.read.schema(f"{schema}, part int").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The rows of the table; none if it was never written."""
    return _files(spark, path, schema, key).where(F.col(key).isNotNull()).drop("part")


def merge_into(spark: SparkSession, path: str, schema: str, key: str, touched: DataFrame, merge: Callable[[DataFrame], DataFrame], partitions: int = PARTITIONS) -> list[int]:
    """Replaces the rows of the partitions of ``touched(key)`` by ``merge(rows)`` and gives back the partitions that were written.

    ``merge`` gets all rows of these partitions, also of keys that are not
    touched, and must give them back. Only partition numbers reach the driver.
    """
    parts = sorted(r["p"] for r in touched.where(F.col(key).isNotNull()).select(part_of(key, partitions).alias("p")).distinct().collect())
    if not parts:
        return []
    columns = spark.createDataFrame([], schema).columns
    before = _files(spark, path, schema, key).where(F.col("part").isin(parts))
    rows = before.where(F.col(key).isNotNull())
    after = written(merge(rows.drop("part")).select(*columns).withColumn("part", part_of(key, partitions)), "merged")
    stray = after.where(~F.col("part").isin(parts)).limit(1).count()
    if stray:
        raise ValueError("a merge made rows of keys outside its partitions")
    mark = lambda df: df.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("h"))
    old = {r["part"]: (r["n"], r["h"]) for r in mark(rows).collect()}
    new = {r["part"]: (r["n"], r["h"]) for r in mark(after).collect()}
    changed = [p for p in parts if old.get(p) != new.get(p)]
    if changed:
        nothing = spark.createDataFrame([(p,) for p in changed if p not in new], "part int")
        kept = after.where(F.col("part").isin(changed)).unionByName(nothing, allowMissingColumns=True)
        dealt = kept.repartition(len(changed), "part").sortWithinPartitions("part", key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return changed
