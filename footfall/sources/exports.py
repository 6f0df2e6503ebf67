"""Reader for versioned CSV exports, plain or gzip, any number of files."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import keys, times
from footfall.schema import HITS, empty
from footfall.session import written
from footfall.sources import records

# The format version, the digits that spell it, the columns a file
# must have, and the header name of each text column of a hit.
VERSION = 2
DIGITS = "0123456789"
REQUIRED = ["Path", "Session", "Date"]
TEXT_COLUMNS = {
    "session": "Session",
    "path": "Path",
    "title": "Title",
    "browser": "Browser",
    "system": "System",
    "referrer": "Referrer",
    "referrer_scheme": "Referrer scheme",
    "screen_size": "Screen size",
    "country": "Location",
    "created_at": "Date",
}
FLAG_COLUMNS = {"is_event": "Event", "bot": "Bot", "first_visit": "FirstVisit"}
CELLS = [*TEXT_COLUMNS.values(), *FLAG_COLUMNS.values()]
LONG_MAX = 9223372036854775807
# Longer than any text can be.
LONGEST = 2147483647

# A cell behind its comma: quoted, with quotes inside doubled, or free of quotes.
CELL_PATTERN = r',(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'


class ExportError(ValueError):
    """The files are not an export this reader can trust; nothing was read."""


class ExportVersionError(ExportError):
    def __init__(self, got: int, want: int = VERSION):
        super().__init__(f"cannot read exports of version {got}; version {want} is the one known here")
        self.got, self.want = got, want


@dataclass(frozen=True)
class Header:
    """Column names of a file in file order, the version prefix removed."""

    names: tuple[str, ...]

    @classmethod
    def parse(cls, line: str) -> Header:
        cells = next(csv.reader(io.StringIO(line, newline="")))
        first = cells[0].lstrip(DIGITS)
        version = cells[0][: len(cells[0]) - len(first)]
        if not version:
            raise ExportError(f"no version number leads the header cell {cells[0]!r}")
        if int(version) != VERSION:
            raise ExportVersionError(int(version))
        header = cls((first, *cells[1:]))
        missing = [name for name in REQUIRED if name not in header.names]
        if missing:
            raise ExportError(f"these required columns are not in the header: {missing}")
        return header

    def places(self) -> list[int]:
        """Where the columns of ``CELLS`` are, the last one of a name; -1 where none is."""
        last = {name: place for place, name in enumerate(self.names)}
        return [last.get(name, -1) for name in CELLS]


def read_export(
    spark: SparkSession,
    paths: str | Sequence[str],
    site: str = "",
    header: str | None = None,
    key_mode: str = "cells",
) -> DataFrame:
    """Hits of all files. Every header is checked before a single row is parsed.

    Headers are found by opening each file for its first record. If ``header`` is given,
    all files must have it. A record whose quotes do not pair up, or stand inside an
    unquoted cell, refuses the load whatever columns are asked for. Plain files are split
    over tasks, also where cells hold line breaks. ``key_mode="canonical"`` keys a hit by its
    mapped columns in name order, so the key survives reordered or widened exports.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if key_mode not in ("cells", "canonical"):
        raise ValueError(f"unknown key_mode {key_mode!r}")
    if header is not None:
        Header.parse(header)
    headers = _headers(spark, paths)
    summary = headers.agg(F.min("line").alias("line"), F.max("line").alias("last"), F.min("problem").alias("problem")).first()
    if summary.problem is not None:
        # The line that the problem was found in says again what it is.
        Header.parse(summary.problem)
    if header is not None and not headers.where(F.col("line") != header).isEmpty():
        raise ExportError("a file does not have the header it was said to have")
    if summary.line is None:
        return empty(spark, HITS)
    rows = records.records(spark, paths)
    if summary.line == summary.last:
        return _to_hits(rows, F.array(*map(F.lit, Header.parse(summary.line).places())), site, key_mode)
    # Files differ: each record learns where its file has the columns.
    known = written(headers.select(F.col("file").alias("of_file"), "places"), "export-places")
    return _to_hits(rows.join(known, rows["file"] == known["of_file"]), F.col("places"), site, key_mode)


def literal_path(path: str) -> str:
    """A file name as a path that is not taken for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, line, places and problem: the first record of each file, where it has the
    columns, and the record again if it is no header that can be read."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, problems = [], []
            for line in batch.column("record").to_pylist():
                try:
                    places.append(Header.parse(line).places())
                    problems.append(None)
                except ExportError:
                    places.append(None)
                    problems.append(line)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.list_(pa.int32())), pa.array(problems, pa.string())],
                ["file", "line", "places", "problem"],
            )

    # One row per file.
    firsts = records.first_records(spark, paths)
    return firsts.mapInArrow(parsed, "file string, line string, places array<int>, problem string")


def _cells(record: Column) -> Column:
    """The cells a record has, of which a short one has fewer than the header names."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(CELL_PATTERN), F.lit(0))
    quoted = lambda cell: F.replace(F.substring(cell, F.lit(3), F.length(cell) - 3), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda cell: F.when(cell.startswith(',"'), quoted(cell)).otherwise(F.substring(cell, 2, LONGEST)))


def _to_hits(rows: DataFrame, places: Column, site: str, key_mode: str) -> DataFrame:
    """Hits from records, with an array of the places where the columns of ``CELLS`` are."""
    rows = rows.select(_cells(F.col("record")).alias("cells"), places.alias("places"))

    def cell(name: str) -> Column:
        """A named cell, '' when the file or the row does not have it."""
        place = F.col("places")[CELLS.index(name)]
        return F.coalesce(F.when(place >= 0, F.get("cells", place)), F.lit(""))

    text = {column: cell(name) for column, name in TEXT_COLUMNS.items()}
    flag = {column: cell(name) for column, name in FLAG_COLUMNS.items()}
    if key_mode == "canonical":
        content = keys.cells_content([cell(name) for name in sorted(CELLS)])
    else:
        # An absent cell is not an empty one: only the cells that are there count.
        content = F.concat(F.array_join("cells", keys.CELL_END), F.lit(keys.CELL_END))
    is_event = (flag["is_event"] == "1") | (F.lower(flag["is_event"]) == "true")
    rows = rows.withColumn("row_digest", keys.digest(content))
    return rows.select(
        keys.short(F.col("row_digest")).alias("hit_key"),
        "row_digest",
        *[column.alias(name) for name, column in text.items()],
        is_event.cast("int").alias("is_event"),
        _whole_number(flag["bot"]).alias("bot"),
        (flag["first_visit"] == "1").cast("int").alias("first_visit"),
        F.lit(site).alias("site"),
        times.to_instant(text["created_at"]).alias("ts"),
        times.text_day(text["created_at"]).alias("event_date"),
    ).select(*HITS.fieldNames())


def _whole_number(text: Column) -> Column:
    """A plain signed integer, clamped to 64 bits; anything else is 0."""
    clamped = F.when(text.startswith("-"), F.lit(-LONG_MAX - 1)).otherwise(F.lit(LONG_MAX))
    return F.when(text.rlike("^[+-]?[0-9]+$"), F.coalesce(text.try_cast("long"), clamped)).otherwise(
        F.lit(0).cast("long")
    )
