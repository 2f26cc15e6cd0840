"""Keeping the ledger and the record of runs in step with result files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studygrid.operators.ledger import replace_by_key, sync
from studygrid.operators.rules import Rule, validate
from studygrid.scratch import written
from studygrid.streaming.tables import PARTITIONS, merge_into, read_table

LEDGER = "paper_id string, category string, message string, severity string, status string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, LEDGER, "paper_id")


def sync_ledger(spark: SparkSession, path: str, findings: DataFrame, papers: DataFrame, partitions: int = PARTITIONS) -> list[int]:
    """Merges ``findings`` of the validated ``papers(paper_id)`` into the ledger at ``path``; gives back the partitions it wrote."""
    return merge_into(spark, path, LEDGER, "paper_id", papers, lambda before: sync(before, findings, papers), partitions)


def record_runs(spark: SparkSession, path: str, schema: str, rows: DataFrame, key: str = "run_id", partitions: int = PARTITIONS) -> list[int]:
    """Inserts ``rows`` into the table of runs at ``path``, in place of those of equal key; rows that repeat a key in ``rows`` are an error."""
    repeated = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} repeats: {repeated[0][key]}")
    return merge_into(spark, path, schema, key, rows, lambda before: replace_by_key(before, rows, key), partitions)


def follow(spark: SparkSession, source: str, schema: str, ledger_path: str, checkpoint: str, rules: list[Rule], paper: str, arm: str, partitions: int = PARTITIONS):
    """Starts a stream that validates new JSON records and merges each batch into the ledger at ``ledger_path``.

    A batch rewrites the partitions of its papers that change; one that is run
    again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = written(batch, f"batch-{number}")
        sync_ledger(rows.sparkSession, ledger_path, validate(rows, rules, paper, arm), rows.select(F.col(paper).cast("string").alias("paper_id")).distinct(), partitions)

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
