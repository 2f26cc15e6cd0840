"""Coloured workbooks, results of many versions, prior extractions, arms and reviewed lists."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studygrid.functions.texts import with_note

#: Fills of reviewed cells, and what they mean (kind of error, severity).
FILLS = {
    "FFC6EFCE": ("none", "none"),
    "FFFFEB9C": ("rule_misapplication", "low"),
    "FFFFC7CE": ("hallucinated_value", "high"),
}
#: Fixed value: number of the fill of a theme colour that marks what is better than the reference.
SUPERIOR_FILL = 5
#: Places of care by code.
SETTINGS = {1: "Primary", 2: "Secondary", 3: "Community"}

CELL = "path string, row int, field_name string, raw string, fill int, rgb string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cells(path: str, content: bytes) -> Iterator[tuple]:
    """Cells of the first sheet below its header row, with the number and colour of their fill."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part = lambda name: ET.fromstring(book.read(name)) if name in book.namelist() else ET.Element("none")
        words = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in part("xl/sharedStrings.xml").iter(_MAIN + "si")]
        styles = part("xl/styles.xml")
        colours = [next((c.get("rgb") for c in f.iter(_MAIN + "fgColor")), None) for f in styles.iterfind(f".//{_MAIN}fills/{_MAIN}fill")]
        formats = [int(x.get("fillId") or 0) for x in styles.iterfind(f".//{_MAIN}cellXfs/{_MAIN}xf")]
        names: dict[str, str] | None = None
        for number, row in enumerate(part("xl/worksheets/sheet1.xml").iter(_MAIN + "row")):
            found = {}
            for cell in row.iterfind(_MAIN + "c"):
                value = cell.findtext(_MAIN + "v") or "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                if cell.get("t") == "s" and value.isdigit() and int(value) < len(words):
                    value = words[int(value)]
                style = int(cell.get("s") or 0)
                found[re.sub(r"\d", "", cell.get("r") or "")] = (value, formats[style] if style < len(formats) else 0)
            if names is None:
                names = {column: value for column, (value, _) in found.items()}
                continue
            for column, (value, fill) in found.items():
                yield path, number, names.get(column, column), value, fill, colours[fill] if fill < len(colours) else None


def read_coloured(spark: SparkSession, path: str, noted: list[str] | None = None) -> DataFrame:
    """``(path, row, field_name, value, error_type, severity, note)`` of the workbooks at ``path``, one row a cell.

    ``value->note`` cells are split; notes are kept for the fields of ``noted``
    (all, if it is None). A workbook is read by one task, as it is one archive.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(_cells(p, content), columns=["path", "row", "field_name", "raw", "fill", "rgb"])

    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, CELL)
    kinds = F.create_map(*[x for k, (e, s) in FILLS.items() for x in (F.lit(k), F.struct(F.lit(e).alias("e"), F.lit(s).alias("s")))])
    kind, note = F.try_element_at(kinds, F.col("rgb")), with_note(F.col("raw"))
    superior = F.col("rgb").isNull() & (F.col("fill") == SUPERIOR_FILL)
    keep = F.lit(True) if noted is None else F.col("field_name").isin(*noted)
    return cells.select(
        "path", "row", "field_name", note["value"].alias("value"),
        F.when(superior, "superior_extraction").otherwise(F.coalesce(kind["e"], F.lit("none"))).alias("error_type"),
        F.coalesce(kind["s"], F.lit("none")).alias("severity"),
        F.when(keep, F.nullif(note["note"], F.lit(""))).alias("note"),
    )


def read_results(spark: SparkSession, *folders: str) -> DataFrame:
    """``(paper_id, folder, version, value, n_arms, prompt_version)`` of result files; null ``n_arms`` marks those that are not JSON.

    The version is the number in ``_v<number>`` of the folder's path, 0 if there is none.
    """
    table = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(list(folders), wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    doc = F.try_parse_json("value")
    listed = F.try_variant_get(doc, "$", "array<variant>")
    version = F.coalesce(F.regexp_extract(folder, r"_v(\d+)[^/]*(?:/[^/]*)?$", 1).try_cast("int"), F.lit(0))
    arms = F.when(doc.isNotNull(), F.coalesce(F.size(listed), F.lit(1)))
    prompt = F.coalesce(F.try_variant_get(doc, "$[0]._metadata.prompt_version", "string"), F.try_variant_get(doc, "$._metadata.prompt_version", "string"))
    return table.select(stem.alias("paper_id"), folder.alias("folder"), version.alias("version"), "value", arms.alias("n_arms"), prompt.alias("prompt_version"))


def _of_folder(results: DataFrame, diseases: tuple[str, ...]) -> DataFrame:
    """Results with ``_d`` and ``_v``, the disease and the label that their folder is named by; others go."""
    name = F.regexp_extract(F.col("folder"), "([^/]+)/?$", 1)
    label = F.regexp_extract(name, r"_(v\d+.*)$", 1)
    return results.withColumn("_v", label).withColumn("_d", F.regexp_replace(name, r"_v\d+.*$", "")).where(F.col("_d").isin(*diseases))


def _best(rows: DataFrame) -> DataFrame:
    """The folder of the greatest version of each disease; of equal versions the one of the least label."""
    order = F.struct("version", (-F.length("_v")).alias("shorter"), "folder")
    found = rows.where("_v <> ''").groupBy(F.col("_d").alias("_bd")).agg(F.max_by("folder", order).alias("_best"))
    return F.broadcast(found)  # A row for each of ``diseases``.


def discovered(results: DataFrame, disease: str | None = None, paper: str | None = None, output_version: str | None = None, diseases: tuple[str, ...] = ("copd", "cvd", "dm")) -> DataFrame:
    """The results to validate: those of a disease's own folder and of its folder of the greatest version, or of the one labelled ``output_version``."""
    rows = _of_folder(results, (disease.lower(),) if disease else diseases)
    if output_version is not None:
        rows = rows.where(F.col("_v") == output_version)
    else:
        rows = rows.join(_best(rows), F.col("_d") == F.col("_bd"), "left").where((F.col("_v") == "") | (F.col("folder") == F.col("_best"))).drop("_bd", "_best")
    rows = rows.where(F.col("paper_id") == paper.strip()) if paper is not None else rows
    return rows.drop("_d", "_v")


def disease_map(results: DataFrame, diseases: tuple[str, ...] = ("copd", "cvd", "dm")) -> DataFrame:
    """``(paper_id, disease)`` of numbered papers in the newest folder of each disease; of several the last of ``diseases`` holds."""
    rows = _of_folder(results, diseases).where(F.col("paper_id").rlike("^[0-9]+$"))
    rows = rows.join(_best(_of_folder(results, diseases)), (F.col("_d") == F.col("_bd")) & (F.col("folder") == F.col("_best")))
    at = F.array_position(F.array(*map(F.lit, diseases)), F.col("_d"))
    return rows.groupBy("paper_id").agg(F.max_by("_d", at).alias("disease"))


def newest(results: DataFrame, by: str = "paper_id") -> DataFrame:
    """The row of the greatest version of each paper; versions are compared as numbers, ties by folder."""
    best = F.max_by(F.struct(*[c for c in results.columns if c != by]), F.struct("version", "folder"))
    return results.groupBy(by).agg(best.alias("r")).select(by, "r.*")


def incomplete(results: DataFrame) -> DataFrame:
    """Results with an arm that says it is not completed, which are not to be reused."""
    said = F.transform(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), lambda a: F.lower(F.try_variant_get(a, "$.completed", "string")))
    return results.where(F.coalesce(F.exists(said, lambda x: x == "false"), F.lit(False)))


def read_prior(spark: SparkSession, path: str, mapping: DataFrame, tiers: tuple[str, ...] = ("A_reference", "B_triangulation")) -> DataFrame:
    """``(cov_nr, arm, field_name, value)`` of a wide CSV, for the fields whose tier the mapping lists and that are there."""
    wide = spark.read.csv(path, header=True, multiLine=True, escape='"')
    lost = [c for c in ("cov_nr", "arm") if c not in wide.columns]
    if lost:
        raise ValueError(f"no column {', '.join(lost)}")
    eligible = {r["field_name"] for r in mapping.where(F.col("tier1_prior_extraction").isin(*tiers)).select("field_name").collect()}
    fields = [c for c in wide.columns if c in eligible]
    if not fields:
        return wide.select("cov_nr", "arm", F.lit("").alias("field_name"), F.lit("").alias("value")).limit(0)
    return wide.select("cov_nr", "arm", *fields).unpivot(["cov_nr", "arm"], fields, "field_name", "value")


def read_arms(spark: SparkSession, path: str, required: list[str], excluded: tuple[str, ...] = (), trials: int | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """A wide CSV of arms with ``healthcare_setting_label``; excluded trials are left out and the expected sizes checked."""
    table = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=True)
    lost = [c for c in required if c not in table.columns]
    if lost:
        raise ValueError(f"no column {', '.join(lost)}")
    table = table.where(~F.col("cov_nr").cast("string").isin(*excluded)) if excluded else table
    if trials is not None or rows is not None:
        size = table.agg(F.count_distinct("cov_nr").alias("trials"), F.count("*").alias("n")).first()
        if trials is not None and size["trials"] != trials:
            raise ValueError(f"{size['trials']} trials, not {trials}")
        if rows is not None and not rows[0] <= size["n"] <= rows[1]:
            raise ValueError(f"{size['n']} rows, not {rows[0]} to {rows[1]}")
    if "healthcare_setting" not in table.columns:
        return table
    names = F.create_map(*[F.lit(x) for kv in SETTINGS.items() for x in kv])
    return table.withColumn("healthcare_setting_label", F.try_element_at(names, F.col("healthcare_setting").cast("int")))


def read_reviewed(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed list of findings, as CSV with or without a byte-order mark; it must have ``resolution_note``."""
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    table = table.toDF(*[c.replace("﻿", "").strip() for c in table.columns])
    if "resolution_note" not in table.columns:
        raise ValueError("no column resolution_note")
    return table
