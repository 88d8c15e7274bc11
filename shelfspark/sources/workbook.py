"""Spreadsheet grids: .xlsx parsed in Arrow batches of Spark's file reader, delimited text by Spark's line reader.

Both give (file, sheet, row_index, cells array<string>), rows counted from 1 as a spreadsheet shows them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

READABLE = (".xlsx", ".xlsm", ".csv", ".tsv", ".txt")
SCHEMA = "file string, sheet string, row_index int, cells array<string>"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The file standard's number formats that show dates or times.
DATE_FORMATS = (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(value: str | None) -> str | None:
    value = (value or "").strip()
    if re.fullmatch(r"-?\d+\.0+", value):
        value = value.split(".")[0]
    return value or None


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date: by a format of the standard, or one of the file's own with date letters."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.parse(z.open("xl/styles.xml")).getroot()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "") for f in root.iter(f"{{{_NS['m']}}}numFmt")}
    shown = [int(x.get("numFmtId") or 0) for x in root.iterfind("m:cellXfs/m:xf", _NS)]
    return {i for i, n in enumerate(shown) if (re.search("(?i)[ymdhs]", own[n]) if n in own else n in DATE_FORMATS)}


def _date(serial: str, since_1904: bool) -> str | None:
    """The ISO time of a day number. Day 60 of the older calendar is a day that never was, so days before it lie one later."""
    try:
        days = float(serial)
        first = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31 if days < 60 else 30)
        return (first + timedelta(milliseconds=round(days * 86_400_000))).isoformat(timespec="milliseconds") + "Z"
    except (ValueError, OverflowError):
        return _text(serial)


def sheets(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook; rows are padded to their sheet's width."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        dates, book = _date_styles(z), ElementTree.parse(z.open("xl/workbook.xml")).getroot()
        since_1904 = any(p.get("date1904") in ("1", "true") for p in book.iterfind("m:workbookPr", _NS))
        for s in book.find("m:sheets", _NS):
            path = targets[s.get(_REL)].lstrip("/")
            rows: list[tuple[int, dict[int, str | None]]] = []
            for row in ElementTree.parse(z.open(path if path.startswith("xl/") else f"xl/{path}")).getroot().iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, str | None] = {}
                for c in row.findall("m:c", _NS):
                    v, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif kind == "s":
                        value = shared[int(v.text)] if v is not None else None
                    else:
                        value = v.text if v is not None else None
                        if value and kind in (None, "n") and int(c.get("s") or 0) in dates:
                            value = _date(value, since_1904)
                    cells[_column(c.get("r"))] = _text(value)
                rows.append((int(row.get("r")), cells))
            width = max((max(c, default=-1) + 1 for _, c in rows), default=0)
            for number, cells in rows:
                yield s.get("name"), number, [cells.get(i) for i in range(width)]


def _parse(path: str, content: bytes) -> Iterator[Row]:
    for sheet, number, cells in sheets(content):
        yield Row(file=path.rsplit("/", 1)[-1], sheet=sheet, row_index=number, cells=cells)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks through Spark's own file reader, so any store Spark reads will do; a workbook is one task's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!~]*.xls[xm]").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in _parse(p, c)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.file for r in rows], pa.string()), pa.array([r.sheet for r in rows], pa.string()), pa.array([r.row_index for r in rows], pa.int32()), pa.array([r.cells for r in rows], pa.list_(pa.string()))],
                ["file", "sheet", "row_index", "cells"],
            )

    return files.mapInArrow(run, SCHEMA)


def lines(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """file, path, row_index and line of text files, rows counted from 1 in each file.

    Files are split as Spark's reader splits them, and a task holds a line at a time. A line's number is its
    place in its split and the lines of the file's earlier splits; these are counted in a first pass, a row a split.
    """
    at = F.col("_metadata.file_block_start")
    rows = spark.read.option("pathGlobFilter", names).option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"), F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file"), at.alias("_at"), F.monotonically_increasing_id().alias("_n")
    )
    splits = rows.groupBy("path", "_at").agg(F.count("*").alias("_lines"), F.min("_n").alias("_first"))
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("path", "_at", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(offsets, ["path", "_at"]).select("file", "path", (F.col("_n") + F.col("_shift")).cast("int").alias("row_index"), "line")


def read_delimited(spark: SparkSession, path: str, separator: str = ",", names: str = "*") -> DataFrame:
    """Lines with their number inside a file; a file is one sheet named like it. Quoted fields may not hold line ends."""
    sep = re.escape(separator)
    raw = F.regexp_extract_all(F.concat(F.lit(separator), F.col("line")), F.lit(sep + r'("(?:[^"]|"")*"|[^' + separator + r"]*)"), F.lit(1))
    clean = F.transform(raw, lambda c: F.nullif(F.trim(F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))), F.lit("")))
    return lines(spark, path, names).select("file", F.regexp_replace("file", r"\.[^.]*$", "").alias("sheet"), "row_index", clean.alias("cells"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending; others are refused. Of a folder all files that can be read are, others are left alone."""
    low = path.lower()
    if not re.search(r"\.[a-z]+$", low):
        comma, tab = read_delimited(spark, path, ",", "[!~]*.{csv,CSV,txt,TXT}"), read_delimited(spark, path, "\t", "[!~]*.{tsv,TSV}")
        return read_xlsx(spark, path).unionByName(comma).unionByName(tab)
    if low.endswith((".xlsx", ".xlsm")):
        return read_xlsx(spark, path)
    if low.endswith((".csv", ".txt")):
        return read_delimited(spark, path)
    if low.endswith(".tsv"):
        return read_delimited(spark, path, "\t")
    raise ValueError(f"cannot read {path}; readable are {', '.join(READABLE)}")
