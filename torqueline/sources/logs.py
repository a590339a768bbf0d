"""Many logs at once, each with names and units of its own, as (file, row_idx, sensor, unit, value).

The first line or row of a log holds names, the second units, the others values; what
isn't a number is null.  Of columns that repeat a name the first one counts, and columns
without a name are left out.  Nothing is read on the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values that a task sends at once.
VALUES = 1 << 16
#: Rows of a log in one workbook; the format holds 1,048,576 with two lines of names and units.
WORKBOOK_ROWS = 1 << 17
LONG = "file string, sheet string, row_idx long, sensor string, unit string, value double"


def _cells(line: Column) -> Column:
    """The cells of a line of comma-separated values; quoted ones may hold commas and doubled quotes, but no line ends."""
    quoted = F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.when(F.trim(c).startswith('"'), F.regexp_replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), '""', '"')).otherwise(c))
    return F.transform(F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",")), lambda c: F.trim(c))


def csv_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs in CSV files of any columns (path may be a folder or a glob); file is the path of each.

    Large files are read in pieces: a piece counts its lines, and the pieces before it give
    its first line's number, so a log needn't be in one task.  Empty lines don't count; a
    file without values has no rows.
    """
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = text.where("trim(line) <> ''").withColumn("id", F.monotonically_increasing_id())  # successive within a piece
    pieces = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    lines = raw.join(pieces, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("row"), "line")
    heads = lines.where("row < 2").groupBy("file").agg(F.max(F.when(F.col("row") == 0, F.col("line"))).alias("names"), F.max(F.when(F.col("row") == 1, F.col("line"))).alias("units"))
    heads = heads.select("file", _cells(F.col("names")).alias("names"), _cells(F.col("units")).alias("units"))
    body = lines.where("row >= 2").join(heads, "file").withColumn("cells", _cells(F.col("line")))
    each = body.select("file", (F.col("row") - 2).alias("row_idx"), "names", "units", "cells", F.posexplode("names").alias("i", "sensor"))
    first = (F.array_position("names", F.col("sensor")) == F.col("i") + 1) & (F.col("sensor") != "")
    return each.where(first).select("file", "row_idx", "sensor", F.try_element_at("units", F.col("i") + 1).alias("unit"), F.try_element_at("cells", F.col("i") + 1).try_cast("double").alias("value"))


def workbook_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs in workbooks (.xlsx), one of each sheet: (file, sheet, row_idx, sensor, unit, value); see ``parsed``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return parsed(files.select(F.col("path").alias("file"), "content"))


def parsed(files: DataFrame) -> DataFrame:
    """The logs of workbooks given as (file, content), in the long form; rows go on from first_row where it is given.

    Each workbook is one task's work, read row by row from its zipped sheets; of its parts
    only shared strings are held whole.  Empty sheets have no rows; null contents none; what is no workbook is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for file, content, start in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if not content.is_valid:
                    continue
                for sheet, log in _sheets(content.as_buffer()):
                    for row_idx, *cells in _log(log):
                        rows.append((file, sheet, start + row_idx, *cells))
                        if len(rows) >= VALUES:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)

    start = F.col("first_row") if "first_row" in files.columns else F.lit(0)
    return files.select(F.col("file").cast("string"), F.col("content").cast("binary"), start.cast("long").alias("first_row")).mapInArrow(run, LONG)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "sheet", "row_idx", "sensor", "unit", "value"])


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheets(content) -> Iterator[tuple[str, Iterator[dict[int, str]]]]:
    """(sheet name, its rows as {column: text}) of a workbook, in its order."""
    book = zipfile.ZipFile(pa.BufferReader(content))
    names = set(book.namelist())
    targets = {}
    with book.open("xl/_rels/workbook.xml.rels") as f:
        for _, e in iterparse(f):
            if _name(e.tag) == "Relationship":
                targets[e.get("Id")] = e.get("Target")
    listed = []
    with book.open("xl/workbook.xml") as f:
        for _, e in iterparse(f):
            if _name(e.tag) == "sheet":
                key = next(v for k, v in e.attrib.items() if k.endswith("}id"))
                listed.append((e.get("name"), targets[key]))
    shared = []
    if "xl/sharedStrings.xml" in names:
        with book.open("xl/sharedStrings.xml") as f:
            for _, e in iterparse(f):
                if _name(e.tag) == "si":
                    shared.append("".join(t.text or "" for t in e.iter() if _name(t.tag) == "t"))
                    e.clear()
    for name, target in listed:
        inner = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if inner in names:
            yield name, _rows(book, inner, shared)


def _rows(book: zipfile.ZipFile, inner: str, shared: list[str]) -> Iterator[dict[int, str]]:
    with book.open(inner) as f:
        for event, e in iterparse(f, events=("start", "end")):
            kind = _name(e.tag)
            if event == "start":
                if kind == "sheetData":
                    data = e
                continue
            if kind != "row":
                continue
            out, column = {}, -1
            for c in e:
                at = c.get("r")
                column = _column(at) if at else column + 1
                text = next((x.text or "" for x in c if _name(x.tag) == "v"), None)
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                elif c.get("t") == "inlineStr":
                    text = "".join(x.text or "" for x in c.iter() if _name(x.tag) == "t")
                if text is not None:
                    out[column] = text
            data.clear()  # rows that were read
            yield out


def _column(place: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", place)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _log(rows: Iterator[dict[int, str]]) -> Iterator[tuple[int, str, str | None, float | None]]:
    """(row_idx, sensor, unit, value) below a row of names and a row of units."""
    names, units = next(rows, {}), next(rows, {})
    first: dict[str, int] = {}
    for i in sorted(names):
        if names[i].strip():
            first.setdefault(names[i].strip(), i)
    for row_idx, row in enumerate(rows):
        for sensor, i in first.items():
            try:
                value = float(row[i]) if i in row else None
            except ValueError:
                value = None
            yield row_idx, sensor, units.get(i), value


def workbooks(readings: DataFrame) -> DataFrame:
    """(file, content, first_row): workbooks for each file of readings (file, row_idx, sensor, unit, value), the counterpart of ``parsed``.

    Sensors are columns in order of their names, rows are numbered without gaps, units are
    those of any row.  A workbook is one object by its format and holds 1,048,576 rows at most, so a file
    goes to a workbook for every ``WORKBOOK_ROWS`` rows, each with the sensors and units of the whole file;
    first_row is the number of a workbook's first row.
    """

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        start, n = int(frame.first_row.iloc[0]), int(frame.n_rows.iloc[0])
        frame = frame.assign(row_idx=frame.row_idx - start)
        wide = frame.pivot_table(index="row_idx", columns="sensor", values="value", dropna=False, aggfunc="first")
        wide = wide.reindex(range(n)).reindex(columns=sorted(frame.sensors.iloc[0]))
        units = dict(zip(frame.sensors.iloc[0], frame.units.iloc[0], strict=True))
        letters = [_letters(i) for i in range(len(wide.columns))]
        text = lambda at, x: f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>'
        lines = ["".join(text(f"{a}{k + 1}", str(x)) for a, x in zip(letters, row, strict=True)) for k, row in enumerate((wide.columns, [units[c] or "" for c in wide.columns]))]
        values = zip(*(wide[c].tolist() for c in wide.columns), strict=True)
        lines += ["".join(f'<c r="{a}{i}"><v>{x!r}</v></c>' for a, x in zip(letters, row, strict=True) if x == x) for i, row in enumerate(values, 3)]
        sheet = "".join(f'<row r="{i}">{line}</row>' for i, line in enumerate(lines, 1))
        return pd.DataFrame({"file": [frame.file.iloc[0]], "content": [_zipped(sheet, "log")], "first_row": [start]})

    r = readings.select("file", "row_idx", "sensor", "unit", "value")
    each = r.groupBy("file", "sensor").agg(F.first("unit", ignorenulls=True).alias("unit"), F.max("row_idx").alias("last"))
    heads = each.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("sensor", "unit"))).alias("s"), F.max("last").alias("last"))
    heads = heads.select("file", F.col("s.sensor").alias("sensors"), F.col("s.unit").alias("units"), "last")
    starts = heads.select("file", "sensors", "units", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(WORKBOOK_ROWS).cast("long"))).alias("first_row"))
    starts = starts.select("file", "sensors", "units", "first_row", F.least(F.col("last") + 1 - F.col("first_row"), F.lit(WORKBOOK_ROWS)).alias("n_rows"))
    at = r.withColumn("first_row", F.col("row_idx") - F.pmod("row_idx", F.lit(WORKBOOK_ROWS)))
    rows = starts.join(at, ["file", "first_row"], "left")  # rows without readings are rows all the same
    return rows.groupBy("file", "first_row").applyInPandas(made, "file string, content binary, first_row long")


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _zipped(sheet: str, name: str) -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, text)
    return out.getvalue()
