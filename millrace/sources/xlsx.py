"""Workbooks (XLSX) as a batch data source and a sink.

A sheet's XML is streamed out of the archive, never unpacked whole. A large sheet is read by several tasks: each
streams it, but looks only at its own stretches; a sheet has at most 1,048,576 rows by its format, so what is
streamed twice has a bound. Each task holds the workbook's shared strings. Files are opened through Arrow's file
systems. All columns are strings: numbers as they are shortest written, days as yyyy-MM-dd, with a time where they have
one, booleans as true and false; errors and empty cells are null. Columns are matched by the names in each file's first row
that has a cell; a name that a file lacks is null, other files' names are left out, and of one that is there twice the second gets _2.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import cached_property
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from .files import header

#: Rows of a batch, bytes of a sheet's XML for a task, tasks for a sheet, bytes read at once, rows of a file.
BLOCK, TASK_BYTES, MOST_TASKS, CHUNK, MOST_ROWS = 4096, 64 << 20, 16, 1 << 20, 1_048_576
#: Fixed values of the format: numbers of built-in formats that show days or times.
DAY_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])[^>]*>")
_END = re.compile(rb"</(?:\w+:)?row\s*>")
_AT = re.compile(rb"\sr\s*=\s*[\"'](\d+)[\"']")
#: Rows of nothing but empty cells and bare inline texts, which need no parser.
_PLAIN = re.compile(rb'<row(?: r="\d+")?>(?:<c/>|<c t="inlineStr"><is><t(?: xml:space="preserve")?>[^<&\r]*</t></is></c>)*</row>')
_TEXT = re.compile(rb'<c(?:/>| t="inlineStr"><is><t(?: xml:space="preserve")?>([^<]*)<)')


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path on it, of a plain path or an address in any of Arrow's or Spark's forms."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def workbooks(path: str) -> list[str]:
    """The workbooks of a folder, or the one that is named; hidden and lock files are none."""
    store, at = place(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at))
    return sorted(f.path for f in found if f.is_file and f.base_name.lower().endswith(".xlsx") and not f.base_name.startswith((".", "_", "~")))


class _Texts:
    """Start and end handlers that hand over the text of elements of some names; pronunciations are left out."""

    def __init__(self, names: dict, got) -> None:
        self.names, self.got, self.attributes, self.parts, self.spoken, self.inside = names, got, {}, [], 0, ""

    def parser(self):
        p = expat.ParserCreate()
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        return p

    def start(self, name, attributes):
        name = name.rpartition(":")[2]
        if name == "rPh":
            self.spoken += 1
        if name in self.names:
            self.attributes, self.parts = attributes, []
        self.inside = name

    def text(self, data):
        if self.inside in ("t", "v") and not self.spoken:
            self.parts.append(data)

    def end(self, name):
        name = name.rpartition(":")[2]
        self.inside = ""
        if name == "rPh":
            self.spoken -= 1
        if name in self.names:
            self.got(self.attributes, "".join(self.parts))


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


class Workbook:
    """One sheet of an open archive; the first one, or that of a name."""

    def __init__(self, file, sheet: str = "") -> None:
        self.zip = zipfile.ZipFile(file)
        found, self.odd_days = [], False
        relations: dict[str, str] = {}

        def take(name, a):
            name = name.rpartition(":")[2]
            if name == "sheet":
                found.append((a["name"], next(v for k, v in a.items() if k.rpartition(":")[2] == "id" and ":" in k)))
            elif name == "workbookPr":
                self.odd_days = a.get("date1904", "0") in ("1", "true")
            elif name == "Relationship":
                relations[a["Id"]] = a["Target"]

        for part in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            self._parse(part, take)
        wanted = [r for n, r in found if n == sheet or not sheet]
        if not wanted:
            raise ValueError(f"no sheet {sheet!r}")
        target = relations[wanted[0]]
        self.part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _parse(self, part: str, start) -> None:
        p = expat.ParserCreate()
        p.StartElementHandler = start
        with self.zip.open(part) as f:
            p.ParseFile(f)

    @property
    def size(self) -> int:
        return self.zip.getinfo(self.part).file_size

    @cached_property
    def shared(self) -> list[str]:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            with self.zip.open("xl/sharedStrings.xml") as f:
                _Texts({"si": 0}, lambda a, x: strings.append(x)).parser().ParseFile(f)
        return strings

    @cached_property
    def days(self) -> list[bool]:
        """Of each cell style, whether it shows days or times."""
        made: dict[int, bool] = {}
        styles: list[bool] = []
        inside = [False]

        def start(name, a):
            name = name.rpartition(":")[2]
            if name == "numFmt":
                # colours, conditions and literal text are no format letters
                code = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", a.get("formatCode", "").lower())
                made[int(a["numFmtId"])] = bool(re.search(r"[dmyhs]", code)) and "general" not in code
            elif name in ("cellXfs", "cellStyleXfs", "dxfs", "cellStyles"):
                inside[0] = name == "cellXfs"
            elif name == "xf" and inside[0]:
                k = int(a.get("numFmtId", 0))
                styles.append(made.get(k, k in DAY_FORMATS))

        if "xl/styles.xml" in self.zip.namelist():
            self._parse("xl/styles.xml", start)
        return styles

    def _rows(self, part: int, parts: int) -> Iterator[tuple[int, bytes]]:
        """Where each row of a part begins and its XML, in order; a part has the rows that begin in its own stretches of CHUNK bytes, and others are passed over unread."""
        held, limit, read = b"", 0, 0
        with self.zip.open(self.part) as f:
            while more := f.read(CHUNK):
                own = read // CHUNK % parts == part
                read += len(more)
                if not own and not held:
                    continue
                held += more
                if own:
                    limit = len(held)
                base, at, keep = read - len(held), 0, -1
                while m := _ROW.search(held, at):
                    if m.start() >= limit:
                        break
                    e = m if held[m.end() - 2 : m.end()] == b"/>" else _END.search(held, m.end())
                    if not e:
                        keep = m.start()
                        break
                    yield base + m.start(), held[m.start() : e.end()]
                    at = e.end()
                else:
                    # a row's start may lie across two reads
                    keep = held.rfind(b"<", at, limit)
                    if keep >= 0 and held.find(b">", keep) >= 0:
                        keep = -1
                held, limit = (held[keep:], limit - keep) if keep >= 0 else (b"", 0)

    def rows(self) -> Iterator[tuple[int, dict[int, str | None]]]:
        """Numbers and cells by column of all rows."""
        number = 0
        for _, given, cells in self.cells(0, 1):
            number = given or number + 1
            yield number, cells

    def cells(self, part: int, parts: int) -> Iterator[tuple[int, int, dict[int, str | None]]]:
        """Where the rows of a part begin, their numbers (0: not given), and their cells by column."""
        strings, days = self.shared, self.days
        for start, xml in self._rows(part, parts):
            r = _AT.search(xml, 0, xml.find(b">"))
            number = int(r.group(1)) if r else 0
            if _PLAIN.fullmatch(xml):
                yield start, number, {k: x.decode() or None for k, x in enumerate(_TEXT.findall(xml))}
                continue
            cells: dict[int, str | None] = {}

            def got(a, x, cells=cells):
                k = _column(a["r"]) if "r" in a else max(cells, default=-1) + 1
                cells[k] = self._value(a.get("t", "n"), int(a.get("s", 0)), x, strings, days)

            _Texts({"c": 0}, got).parser().Parse(xml, True)
            yield start, number, cells

    def _value(self, kind: str, style: int, x: str, strings: list[str], days: list[bool]) -> str | None:
        if x == "" or kind == "e":
            return None
        if kind == "s":
            return strings[int(x)] or None
        if kind == "b":
            return "true" if x.strip() == "1" else "false"
        if kind != "n":
            return x
        try:
            number = float(x)
        except ValueError:
            return x
        if style < len(days) and days[style] and 0 <= number < 2_958_466:
            # serial days count a 29 February 1900 that was none
            start = datetime(1904, 1, 1) if self.odd_days else datetime(1899, 12, 30 if number >= 60 else 31)
            moment = start + timedelta(seconds=round(number * 86400))
            return str(moment.date() if moment.time() == datetime.min.time() else moment)
        if re.fullmatch(r"\s*-?\d+\s*", x):
            return x.strip()
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def names(self) -> tuple[int, dict[int, str]]:
        """Where the first row with a cell begins, and its columns' names."""
        for start, _, cells in self.cells(0, 1):
            if any(cells.values()):
                seen: dict[str, int] = {}
                out = {}
                for k in sorted(cells):
                    name = header(cells[k] or "") or f"C{k + 1}"
                    seen[name] = seen.get(name, 0) + 1
                    out[k] = name if seen[name] == 1 else f"{name}_{seen[name]}"
                return start, out
        return 0, {}


class _Part(InputPartition):
    def __init__(self, path: str, part: int, parts: int) -> None:
        super().__init__((path, part, parts))


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str, names: list[str], task_bytes: int) -> None:
        self.path, self.sheet, self.columns, self.task_bytes = path, sheet, names, task_bytes

    def partitions(self):
        store = place(self.path)[0]
        out = []
        for path in workbooks(self.path):
            with store.open_input_file(path) as f:
                parts = min(MOST_TASKS, max(1, -(-Workbook(f, self.sheet).size // self.task_bytes)))
            out += [_Part(path, k, parts) for k in range(parts)]
        return out or [_Part("", 0, 1)]

    def read(self, partition):
        path, part, parts = partition.value
        if not path:
            return
        schema = pa.schema([(n, pa.string()) for n in self.columns])
        with place(self.path)[0].open_input_file(path) as f:
            book = Workbook(f, self.sheet)
            first, names = book.names()
            of = {n: k for k, n in names.items()}
            at = [of.get(n) for n in self.columns]
            batch: list[list[str | None]] = []
            for start, _, cells in book.cells(part, parts):
                if start > first and any(v is not None for v in cells.values()):
                    batch.append([cells.get(k) if k is not None else None for k in at])
                if len(batch) == BLOCK:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*batch)], schema=schema)
                    batch = []
            if batch:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*batch)], schema=schema)


class Xlsx(DataSource):
    """spark.read.format("workbook").option("sheet", ...).load(folder or file)"""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        files = workbooks(self.options["path"])
        for path in files:
            with place(self.options["path"])[0].open_input_file(path) as f:
                names = Workbook(f, self.options.get("sheet", "")).names()[1]
            if names:
                return ", ".join(f"`{n}` string" for n in names.values())
        raise ValueError(f"no workbook with a header in {self.options['path']}")

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("sheet", ""), [f.name for f in schema], int(self.options.get("taskBytes", TASK_BYTES)))


def read_workbooks(spark: SparkSession, path: str, sheet: str = "", required=(), **options: str) -> DataFrame:
    """A workbook, or all of a folder, with all columns as strings and plain names; a missing required column is an error."""
    ship(spark)
    spark.dataSource.register(Xlsx)
    df = spark.read.format("workbook").options(sheet=sheet, **options).load(path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


_BOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_SHEET = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>', "</sheetData></worksheet>")
#: What XML cannot hold.
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")

#: What is not written as it is.
_ODD = re.compile("[\x00-\x08\x0b-\x1f&<>\ud800-\udfff\ufffe\uffff]")
_CELL = ('<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>")


def _row_xml(number: int, values) -> str:
    if not _ODD.search("".join(v for v in values if v)):
        return f'<row r="{number}">{"".join(f"{_CELL[0]}{v}{_CELL[1]}" if v else "<c/>" for v in values)}</row>'
    cells = (f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BARRED.sub("", v), {chr(13): "&#13;"})}</t></is></c>' if v else "<c/>" for v in values)
    return f'<row r="{number}">{"".join(cells)}</row>'


def write_workbooks(df: DataFrame, path: str, most_rows: int = MOST_ROWS) -> list[str]:
    """df's rows as strings in workbooks of at most so many rows, header included: one or more a partition, under names that a task's retry overwrites. Returns their names."""
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = place(path)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        row, n = next(rows, None), 0
        while row is not None:
            final = f"part-{context.partitionId():05d}-{n:03d}.xlsx"
            held = f"{folder}/_{final}-{context.taskAttemptId()}"
            with store.open_output_stream(held) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                for part, xml in _BOOK.items():
                    z.writestr(part, xml)
                with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
                    sheet.write((_SHEET[0] + _row_xml(1, names)).encode())
                    number = 2
                    while row is not None and number <= most_rows:
                        sheet.write(_row_xml(number, row).encode())
                        row, number = next(rows, None), number + 1
                    sheet.write(_SHEET[1].encode())
            store.move(held, f"{folder}/{final}")
            yield pa.record_batch([pa.array([final])], names=["file"])
            n += 1

    ship(df.sparkSession)
    text = df.select(*[df[c].cast("string").alias(c) for c in names])
    return sorted(r[0] for r in text.mapInArrow(write, "file string").collect())
