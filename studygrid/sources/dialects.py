"""Tables of text files that each find their own delimiter and encoding.

``register`` adds the format ``sheets`` to a session: one partition a file, the
columns all files' in the order of their first place, all texts. Its workers open
the files themselves; ``read_sheets`` reads the same files through Spark, from any
store, as long cells.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DELIMITERS = (",", "|", "\t", ";")
#: Characters and lines that the dialect of a file is told by.
HEAD, RECORDS = 1 << 16, 20
CELLS = "path string, row long, place int, field_name string, value string"


def decoded(content: bytes) -> str:
    """UTF-8, with or without its mark, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def delimiter(text: str) -> str:
    """What splits the first lines into the most fields alike, outside quotes; a comma, which may be a decimal sign, only if no other does as well."""
    lines = [x for x in re.sub(r'"(?:[^"]|"")*"', "", text[:HEAD]).splitlines() if x.strip()]
    lines = (lines[:-1] if len(text) > HEAD else lines)[:RECORDS]
    best = (0.0, 0, ",")
    for i, one in enumerate(DELIMITERS):
        width = lines[0].count(one) if lines else 0
        if width:
            best = max(best, (width * sum(x.count(one) == width for x in lines) / len(lines), i, one))
    return best[2]


def parsed(content: bytes) -> tuple[list[str], Iterator[list[str]]]:
    """The header, trimmed, and the records of a file."""
    text = decoded(content)
    rows = (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text)) if any(x.strip() for x in r))
    return [x.strip() for x in next(rows, [])], rows


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str]):
        self.paths, self.names = paths, names

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            header, rows = parsed(f.read())
        at = [header.index(n) if n in header else None for n in self.names]
        for r in rows:
            yield tuple(None if i is None or i >= len(r) or r[i] == "" else r[i] for i in at)


class SheetSource(DataSource):
    """``spark.read.format("sheets").load(path)``: a file, a folder, or a pattern."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def _paths(self) -> list[str]:
        import glob
        import os

        path = self.options["path"].removeprefix("file:")
        path = "/" + path.lstrip("/") if self.options["path"].startswith("file:") else path
        found = sorted(glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path))
        return [p for p in found if os.path.isfile(p)]

    def schema(self) -> str:
        names: dict[str, None] = {}
        for p in self._paths():
            with open(p, "rb") as f:
                names |= dict.fromkeys(parsed(f.read(HEAD).rpartition(b"\n")[0] or open(p, "rb").read())[0])
        if not names:
            raise ValueError(f"no file with a header at {self.options['path']}")
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._paths(), schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row, place, field_name, value)``, one row a cell that is not empty; a file is read by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                header, rows = parsed(content)
                for some in _lots(rows):
                    cells = [(p, i, k, header[k], x) for i, r in some for k, x in enumerate(r) if k < len(header) and x != ""]
                    yield pd.DataFrame(cells, columns=["path", "row", "place", "field_name", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, CELLS)


def _lots(rows: Iterator[list[str]], size: int = 1000) -> Iterator[list]:
    lot: list = []
    for i, r in enumerate(rows):
        lot.append((i, r))
        if len(lot) >= size:
            yield lot
            lot = []
    if lot:
        yield lot


def gold_records(sheet: DataFrame, keep: list[str], keys: tuple[str, ...] = ("cov_nr", "arm"), skip: tuple[str, ...] = ("_metadata",)) -> DataFrame:
    """One column ``value``: each row as a JSON text, keys trimmed; numbers as numbers, whole ones without a fraction but for the columns of ``keep``."""
    items = []
    for c in sheet.columns:
        if c in skip:
            continue
        text = F.col(f"`{c}`")
        name = F.to_json(F.lit(c).cast("variant"))
        if c in keys:
            value = F.to_json(F.coalesce(F.trim(text), F.lit("nan")).cast("variant"))
        else:
            number = F.when(text.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), text.try_cast("double"))
            whole = F.when((number == F.floor(number)) & F.lit(c not in keep), F.format_string("%.0f", number))
            value = F.coalesce(whole, F.to_json(number.cast("variant")), F.to_json(text.cast("variant")), F.lit("null"))
        items.append(F.concat(name, F.lit(": "), value))
    return sheet.select(F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}")).alias("value"))


def prior_rows(cells: DataFrame, names: dict[str, str], arms: tuple[str, ...] = ("control", "treat1", "treat2")) -> DataFrame:
    """A wide row for each row of ``cells(path, row, field_name, value)`` of a workbook or sheet: columns renamed by ``names``, others left out.

    Keys lose their # and are filled to four places, arms are trimmed and in lower
    case; rows of other arms are left out. Ordered by key and arm.
    """
    renamed = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    rows = cells.withColumn("field_name", F.try_element_at(renamed, F.col("field_name"))).where(F.col("field_name").isNotNull())
    new = list(dict.fromkeys(names.values()))
    wide = rows.groupBy("path", "row").pivot("field_name", new).agg(F.max("value"))
    key, arm = F.trim(F.ltrim(F.trim("cov_nr"), F.lit("#"))), F.lower(F.trim("arm"))
    filled = F.when(F.char_length(key) < 4, F.lpad(key, 4, "0")).otherwise(key)
    clean = wide.withColumns({"cov_nr": filled, "arm": arm}).where((F.col("cov_nr") != "") & F.col("arm").isin(*arms))
    return clean.select(*new).orderBy("cov_nr", "arm")
