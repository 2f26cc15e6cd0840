"""Validating records against declared rules; findings are rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "paper_id string, arm string, severity string, category string, message string"


@dataclass(frozen=True)
class Rule:
    """``kind``: required, range, integer, enum, order (field <= other), less (field < other) or sum (field + other = whole)."""

    field: str
    kind: str
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()
    other: str | None = None
    whole: str | None = None
    severity: str | None = None


#: Category and severity of each kind of rule.
KINDS = {
    "required": ("schema_missing_field", "ERROR"),
    "range": ("range_violation", "ERROR"),
    "integer": ("type_integer", "WARNING"),
    "enum": ("type_enum", "ERROR"),
    "order": ("range_order", "WARNING"),
    "less": ("range_order", "WARNING"),
    "sum": ("time_math", "WARNING"),
}


def _broken(r: Rule) -> Column:
    x = F.col(r.field)
    n = x.cast("double")
    if r.kind == "required":
        return x.isNull()
    if r.kind == "range":
        return (n < r.low) | (n > r.high)
    if r.kind == "integer":
        return n != F.floor(n)
    if r.kind == "enum":
        return ~x.cast("string").isin(*r.allowed)
    if r.kind == "order":
        return n > F.col(r.other)
    if r.kind == "less":
        return n >= F.col(r.other)
    if r.kind == "sum":
        return F.abs(n + F.col(r.other) - F.col(r.whole)) > 1
    raise ValueError(f"no kind of rule {r.kind!r}")


def validate(df: DataFrame, rules: list[Rule], paper: str, arm: str) -> DataFrame:
    """One finding for each rule a record breaks: ``(paper_id, arm, severity, category, message)``; one pass, no join."""
    found = [
        F.when(F.coalesce(_broken(r), F.lit(False)), F.struct(F.lit(r.severity or KINDS[r.kind][1]).alias("severity"), F.lit(KINDS[r.kind][0]).alias("category"), F.concat(F.lit(f"{r.field}: "), F.coalesce(F.col(r.field).cast("string"), F.lit("missing"))).alias("message")))
        for r in rules
    ]
    rows = df.select(F.col(paper).cast("string").alias("paper_id"), F.col(arm).cast("string").alias("arm"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("paper_id", "arm", "f.*")


def cross_arm(df: DataFrame, paper: str, arm: str, field: str) -> DataFrame:
    """Findings of papers with two arms or more whose ``field`` differs; null equals null."""
    g = df.groupBy(F.col(paper).cast("string").alias("paper_id")).agg(F.count_distinct(arm).alias("arms"), F.count_distinct(F.coalesce(F.col(field).cast("string"), F.lit("NA"))).alias("values"))
    return g.where("arms >= 2 and values > 1").select("paper_id", F.lit(None).cast("string").alias("arm"), F.lit("ERROR").alias("severity"), F.lit("cross_arm").alias("category"), F.concat(F.lit(f"{field}: "), F.col("values").cast("string"), F.lit(" values")).alias("message"))


def summary(findings: DataFrame) -> DataFrame:
    """``(severity, category, n, papers)``."""
    return findings.groupBy("severity", "category").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))


def worst_papers(findings: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` papers of highest weighted count: errors 3, warnings 1."""
    weight = F.when(F.col("severity") == "ERROR", 3).when(F.col("severity") == "WARNING", 1).otherwise(0)
    return findings.groupBy("paper_id").agg(F.sum(weight).alias("score")).orderBy(F.col("score").desc(), "paper_id").limit(k)


def crowded(findings: DataFrame, least: int = 5) -> DataFrame:
    return findings.where("severity = 'ERROR'").groupBy("paper_id").agg(F.count("*").alias("errors")).where(F.col("errors") >= least)


def clean_papers(papers: DataFrame, findings: DataFrame, paper: str) -> DataFrame:
    """Papers without errors and warnings."""
    bad = findings.where(F.col("severity").isin("ERROR", "WARNING")).select(F.col("paper_id"))
    return papers.select(F.col(paper).cast("string").alias("paper_id")).distinct().join(bad, "paper_id", "left_anti")
