"""Writing findings, field lists and diffs: CSV of fixed columns, diffs as JSON and as Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of exported findings.
FINDING_COLUMNS = ("id", "cov_nr", "disease", "severity", "category", "arm", "message", "prompt_version", "auto_fixable", "created_at", "status", "resolution", "resolved_at", "corrected_value", "proposed_fix")


def exported_findings(findings: DataFrame, diseases: DataFrame | None = None, disease: str | None = None, severity: str | None = None, category: str | None = None, status: str | None = None) -> DataFrame:
    """The columns of ``FINDING_COLUMNS`` as texts, of a ledger or of findings that are in none; what a table lacks is empty.

    ``diseases(paper_id, disease)`` says what papers are of, and with ``disease``
    only those of it are kept. A paper of ``diseases`` counts once. Filters reach
    the scan of the findings.
    """
    rows = findings
    for column, wanted in (("severity", severity), ("category", category), ("status", status)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if diseases is not None:
        of = diseases.groupBy(F.col("paper_id").cast("string").alias("_p")).agg(F.max("disease").alias("_d"))
        of = of.where(F.col("_d") == disease) if disease is not None else of
        rows = rows.join(of, F.col("paper_id").cast("string") == F.col("_p"), "inner" if disease is not None else "left")
    elif disease is not None:
        rows = rows.withColumn("_d", F.lit(disease))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    flag = F.initcap(F.coalesce(F.col("auto_fixable").cast("boolean"), F.lit(False)).cast("string")) if "auto_fixable" in rows.columns else F.lit("False")
    special = {"cov_nr": text("paper_id"), "disease": text("_d"), "auto_fixable": flag, "proposed_fix": text("fix_value")}
    return rows.select(*[special.get(c, text(c)).alias(c) for c in FINDING_COLUMNS])


def write_findings_csv(findings: DataFrame, path: str, overwrite: bool = False, **filters) -> None:
    """``exported_findings`` as CSV with a header; what is there already is an error unless ``overwrite``."""
    exported_findings(findings, **filters).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, emptyValue="", quoteAll=False, escape='"')


def fixed_columns(wide: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns in that order: others go, and those that are not there are empty."""
    return wide.select(*[F.col(f"`{c}`") if c in wide.columns else F.lit("").alias(c) for c in columns])


def diff_documents(diffs: DataFrame, paper: str = "paper_id") -> DataFrame:
    """``(paper, run_a, run_b, n, document, markdown)`` of ``compare.diff_pairs``: a JSON list of the differences of two runs of a paper, and a table of them.

    It lists the fields of one paper, so a row is as long as the paper's differences.
    """
    shown = lambda c, width: F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)
    word = lambda c: F.coalesce(c, F.lit("None"))
    cells = lambda a, f, x, y: F.concat(F.lit("| "), shown(a, 25), F.lit(" | "), shown(f, 35), F.lit(" | "), shown(x, 25), F.lit(" | "), y, F.lit(" |"))
    names = ("arm", "field", "value_a", "value_b")
    # Lines are made of rows that are dealt to their pair already, so they do not shuffle.
    dealt = diffs.select(paper, "run_a", "run_b", *names).repartition(paper, "run_a", "run_b")
    line = cells(word(F.col("arm")), F.col("field"), word(F.col("value_a")), word(F.col("value_b")))
    listed = dealt.withColumn("line", line).groupBy(paper, "run_a", "run_b").agg(F.sort_array(F.collect_list(F.struct(*names, "line"))).alias("d"))
    n = F.size("d")
    title = F.concat(F.lit("## "), F.col("run_a"), F.lit(" vs "), F.col("run_b"), F.lit(" ("), n.cast("string"), F.lit(" difference"), F.when(n == 1, "").otherwise("s"), F.lit(")\n"))
    head = F.array(title, cells(F.lit("ARM"), F.lit("FIELD"), F.col("run_a"), F.col("run_b")), F.lit("|" + "|".join("-" * k for k in (27, 37, 27, 20)) + "|"))
    plain = F.arrays_zip(*[F.col(f"d.{c}") for c in names]).cast("array<struct<" + ",".join(f"{c}:string" for c in names) + ">>")
    return listed.select(paper, "run_a", "run_b", n.alias("n"), F.to_json(plain, {"ignoreNullFields": "false"}).alias("document"), F.concat(F.array_join(F.concat(head, F.col("d.line")), "\n"), F.lit("\n")).alias("markdown"))
