"""Workbooks as a data source of Spark: `spark.read.format("workbook")` and `df.write.format("workbook")`.

Reading makes one partition for each sheet of each file. A sheet's XML is read as a stream, twice: once
for its width, once for its rows, of which a batch is held at a time. Writing takes rows (sheet, cells) in
the order of their partitions: every task writes its rows as XML to a part beside the target, and the
commit copies the parts into one workbook, of which it holds a buffer at a time. Files are reached through
Arrow's file systems, so driver and executors may use any store that those know.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from shelfspark.sources.workbook import _NS, _REL, _column, _date, _date_styles, _text

#: The endings that each way in takes: files on disk, uploads, and catalog folders.
GATES = {"file": (".xlsx", ".xlsm", ".csv", ".tsv", ".txt"), "upload": (".xlsx", ".xlsm", ".csv"), "folder": (".xlsx", ".xlsm")}
SCHEMA = "file string, sheet string, width int, row_index int, cells array<string>"
_OUT = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("width", pa.int32()), ("row_index", pa.int32()), ("cells", pa.list_(pa.string()))])
_MAIN = f"{{{_NS['m']}}}"
BUFFER = 1 << 20


def supported(name: str, gate: str = "file") -> bool:
    """Whether a gate takes a file by its ending; .xls is none that can be read."""
    return name.lower().endswith(GATES[gate])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def _files(path: str) -> list[str]:
    """The workbooks that a path or, one level deep, a folder names; temporary ones of an office program are none."""
    store, at = _open(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        if not supported(at, "folder"):
            raise ValueError(f"cannot read {path}; readable are {', '.join(GATES['folder'])}")
        return [at]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and supported(x.path, "folder") and not x.base_name.startswith("~"))


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    entry: str


def sheet_list(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, entry of the archive) of a workbook's sheets, in their order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
    found = []
    for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().find("m:sheets", _NS):
        at = targets[s.get(_REL)].lstrip("/")
        found.append((s.get("name"), at if at.startswith("xl/") else f"xl/{at}"))
    return found


def _shared(z: zipfile.ZipFile) -> list[str]:
    """The strings that cells name by number, read as a stream."""
    out: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_MAIN}si":
                    out.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                    e.clear()
    return out


def _rows(z: zipfile.ZipFile, entry: str) -> Iterator[ElementTree.Element]:
    """The row elements of a sheet, each freed when the next one is asked for."""
    with z.open(entry) as f:
        data = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start" and e.tag == f"{_MAIN}sheetData":
                data = e
            elif event == "end" and e.tag == f"{_MAIN}row":
                yield e
                if data is not None:
                    data.clear()


def stream(z: zipfile.ZipFile, entry: str) -> Iterator[tuple[int, int, list[str | None]]]:
    """(width, row number, cells) of a sheet, rows padded to its width; rows and cells may go without their numbers."""
    width = 0
    for row in _rows(z, entry):
        at = -1
        for c in row.iterfind("m:c", _NS):
            at = _column(c.get("r")) if c.get("r") else at + 1
        width = max(width, at + 1)
    shared, dates = _shared(z), _date_styles(z)
    book = ElementTree.parse(z.open("xl/workbook.xml")).getroot()
    since_1904 = any(p.get("date1904") in ("1", "true") for p in book.iterfind("m:workbookPr", _NS))
    number = 0
    for row in _rows(z, entry):
        number = int(row.get("r")) if row.get("r") else number + 1
        cells: list[str | None] = [None] * width
        at = -1
        for c in row.iterfind("m:c", _NS):
            at = _column(c.get("r")) if c.get("r") else at + 1
            v, kind = c.find("m:v", _NS), c.get("t")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif kind == "s":
                value = shared[int(v.text)] if v is not None else None
            else:
                value = v.text if v is not None else None
                if value and kind in (None, "n") and int(c.get("s") or 0) in dates:
                    value = _date(value, since_1904)
            cells[at] = _text(value)
        yield width, number, cells


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.batch = options["path"], int(options.get("batch", 5000))

    def partitions(self) -> list[Sheet]:
        found = []
        for path in _files(self.path):
            with _open(self.path)[0].open_input_file(path) as f, zipfile.ZipFile(f) as z:
                found += [Sheet(path, name, entry) for name, entry in sheet_list(z)]
        return found

    def read(self, partition: Sheet | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        with _open(self.path)[0].open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            held: list[tuple[int, int, list[str | None]]] = []

            def batch() -> pa.RecordBatch:
                n = len(held)
                columns = [[partition.path.rsplit("/", 1)[-1]] * n, [partition.name] * n, *(list(x) for x in zip(*held, strict=True))]
                return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OUT, strict=True)], schema=_OUT)

            for row in stream(z, partition.entry):
                held.append(row)
                if len(held) == self.batch:
                    yield batch()
                    held.clear()
            if held:
                yield batch()


#: The parts of the file format that every workbook has.
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
WIDEST = 70


def letters(column: int) -> str:
    """The name of a column counted from 0."""
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(at: str, text: str | None, number: float | None) -> str:
    if number is not None:
        return f'<c r="{at}"><v>{number!r}</v></c>'
    if text is None:
        return ""
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub(" ", text))}</t></is></c>'


@dataclass
class Part(WriterCommitMessage):
    """A task's parts: sheet, file, rows and the longest text of each column."""

    parts: list[tuple[str, str, int, list[int]]]


class Writer(DataSourceWriter):
    """Rows (sheet, cells as structs of text and number) to one workbook; a sheet's header comes from the options.

    The rows of a part have no numbers, which the commit's order gives; only their cells' columns do.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.heads: dict[str, list[str]] = json.loads(options["heads"])
        self.stage = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = _open(self.stage)
        store.create_dir(at)
        done: list[tuple[str, str, int, list[int]]] = []
        out, sheet, name, n, longest = None, None, "", 0, []
        for row in iterator:
            if row["sheet"] != sheet:
                if out is not None:
                    out.close()
                    done.append((sheet, name, n, longest))
                # the attempt's own file: a task that runs again leaves the first try's alone
                sheet, name, n, longest = row["sheet"], f"{at}/{task.partitionId():07d}-{task.taskAttemptId()}-{len(done)}.xml", 0, []
                out = store.open_output_stream(name)
            cells = row["cells"] or []
            longest += [0] * (len(cells) - len(longest))
            for i, c in enumerate(cells):
                longest[i] = max(longest[i], len(_shown(c["text"], c["number"])))
            out.write(("<row>" + "".join(_cell(letters(i) + "\0", c["text"], c["number"]) for i, c in enumerate(cells)) + "</row>\n").encode())
            n += 1
        if out is not None:
            out.close()
            done.append((sheet, name, n, longest))
        return Part(done)

    def _numbered(self, store: fs.FileSystem, names: list[str], first: int, to) -> None:
        """Copies the parts with the numbers of their rows, a line at a time."""
        for name in names:
            with store.open_input_stream(name) as f:
                for line in io.BufferedReader(_Raw(f), BUFFER):
                    number = str(first).encode()
                    to.write(line.replace(b"<row>", b'<row r="' + number + b'">', 1).replace(b"\0", number))
                    first += 1

    def commit(self, messages: list[Part | None]) -> None:
        store, target = _open(self.path)
        if store.get_file_info(target).type != fs.FileType.NotFound and not self.overwrite:
            raise FileExistsError(self.path)
        parts = [p for m in messages if m is not None for p in m.parts]
        fresh = f"{target}.{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            names = list(self.heads)
            z.writestr("[Content_Types].xml", _TYPES.format("".join(_SHEET_TYPE.format(i + 1) for i in range(len(names)))))
            z.writestr("_rels/.rels", _RELS.format(f'<Relationship Id="rId1" Type="{_REL_TYPE}/officeDocument" Target="xl/workbook.xml"/>'))
            z.writestr("xl/_rels/workbook.xml.rels", _RELS.format("".join(f'<Relationship Id="rId{i + 1}" Type="{_REL_TYPE}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))))
            sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
            z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_REL_TYPE}"><sheets>{sheets}</sheets></workbook>')
            for i, name in enumerate(names):
                own, head = [p for p in parts if p[0] == name], self.heads[name]
                rows = sum(p[2] for p in own)
                widths = [min(WIDEST, max([len(h) + 2, *(p[3][c] + 2 for p in own if c < len(p[3]))])) for c, h in enumerate(head)]
                with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w", force_zip64=True) as out:
                    cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{w}" customWidth="1"/>' for c, w in enumerate(widths))
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>'.encode())
                    # a sheet without rows has no header either
                    if rows:
                        out.write(('<row r="1">' + "".join(_cell(f"{letters(c)}1", h, None) for c, h in enumerate(head)) + "</row>").encode())
                        self._numbered(store, [p[1] for p in own], 2, out)
                    out.write(f'</sheetData><autoFilter ref="A1:{letters(max(0, len(head) - 1))}{rows + 1}"/></worksheet>'.encode())
        store.move(fresh, target)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = _open(self.stage)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class _Raw(io.RawIOBase):
    """An Arrow stream as a raw one, so that lines can be read from it."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


def _shown(text: str | None, number: float | None) -> str:
    return (text or "") if number is None else f"{number:g}"


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes `format("workbook")` known; sources are looked up in the thread's active session, which a new thread lacks."""
    spark._jvm.SparkSession.setActiveSession(spark._jsparkSession)
    spark.dataSource.register(Workbook)


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, width, row_index and cells of every row of every sheet; blank rows that the file holds too."""
    register(spark)
    return spark.read.format("workbook").load(path)


def as_cells(df: DataFrame, sheet: str) -> DataFrame:
    """Rows (sheet, cells) of a table; numbers stay numbers, all else is text."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    cell = lambda c, t: F.struct(F.lit(None).cast("string").alias("text"), F.col(c).cast("double").alias("number")) if t.startswith(numeric) else F.struct(F.col(c).cast("string").alias("text"), F.lit(None).cast("double").alias("number"))
    return df.select(F.lit(sheet).alias("sheet"), F.array(*(cell(f"`{c}`", t) for c, t in df.dtypes)).alias("cells"))


def write(sheets: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One workbook with a sheet for each table, its rows in the table's order, columns as wide as their longest text
    (70 at most) and a filter over all of them. A table without rows is an empty sheet."""
    if not sheets:
        raise ValueError("a workbook has a sheet at least")
    spark = next(iter(sheets.values())).sparkSession
    register(spark)
    every = None
    for name, df in sheets.items():
        own = as_cells(df, name)
        every = own if every is None else every.unionByName(own)
    heads = json.dumps({name: df.columns for name, df in sheets.items()})
    every.write.format("workbook").option("heads", heads).mode("overwrite" if overwrite else "append").save(path)
