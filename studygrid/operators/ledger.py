"""The review ledger: findings with a status, as snapshots that a merge turns into the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["paper_id", "category", "message"]
STATES = ("accepted", "rejected", "fixed")


def sync(ledger: DataFrame, current: DataFrame, validated: DataFrame) -> DataFrame:
    """The next ledger ``(paper_id, category, message, severity, status)``.

    New findings come in as open; open ones of a validated paper that are not
    found now go; reviewed ones stay as they are.
    """
    old = ledger.select(*KEY, "severity", "status")
    new = current.groupBy(*KEY).agg(F.min("severity").alias("severity_new"))
    seen = validated.select("paper_id").distinct().withColumn("validated", F.lit(True))
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("now", F.lit(True)), KEY, "full_outer").join(seen, "paper_id", "left")
    stale = F.col("was").isNotNull() & (F.col("status") == "open") & F.col("now").isNull() & F.col("validated").isNotNull()
    return both.where(~F.coalesce(stale, F.lit(False))).select(*KEY, F.coalesce("severity", "severity_new").alias("severity"), F.coalesce("status", F.lit("open")).alias("status"))


def resolve(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sets the status of open findings by ``decisions(paper_id, category, message, decision)``.

    Keys with several different decisions, and decisions that are no state, change nothing.
    """
    one = decisions.groupBy(*KEY).agg(F.count_distinct("decision").alias("n"), F.min("decision").alias("decision")).where(F.col("n") == 1).where(F.col("decision").isin(*STATES))
    open_ = (F.col("status") == "open") & F.col("decision").isNotNull()
    return ledger.join(one.drop("n"), KEY, "left").withColumn("status", F.when(open_, F.col("decision")).otherwise(F.col("status"))).drop("decision")


def replace_by_key(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of equal key replaced."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def stats(ledger: DataFrame) -> DataFrame:
    """``(severity, total, open, accepted, rejected, fixed, blocking_papers)``."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return ledger.groupBy("severity").agg(F.count("*").alias("total"), count("open"), *map(count, STATES), F.count_distinct(F.when(F.col("status") == "open", F.col("paper_id"))).alias("blocking_papers"))
