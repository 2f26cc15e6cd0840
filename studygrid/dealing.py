"""Rows dealt to tasks whose size does not grow with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Rows that a task holds at most on average, those of a small table, and how many tasks need no buffer for each row that they deal.
LARGE, SMALL, DIRECT = 4_000_000, 50_000, 200


def tasks(rows: int) -> int:
    """How many tasks share ``rows`` rows: ``SMALL`` each up to ``DIRECT`` tasks, then as many as hold ``LARGE``."""
    return max(1, min(DIRECT, -(-rows // SMALL)), -(-rows // LARGE))


def dealt(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``df`` by hash of ``keys`` to the tasks for ``rows`` rows; adaptive execution would join tasks up to 64 MB of compressed rows, which take ten times that in a sort."""
    return df.repartition(tasks(rows), *keys)
