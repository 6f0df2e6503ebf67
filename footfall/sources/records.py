"""Records of CSV files from their lines, however a file is split over tasks.

A cell in quotes may hold line breaks, so whether a line begins a record depends on all
quotes before it in its file. Quotes only ever pair up in a sound file, so one bit per
split tells enough: first every split's quotes are counted, then the counts of earlier
splits say in which state a split begins, then each task joins its lines to records. What a
split has of a record that it shares with its neighbours is put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.session import importable, written

# A record: cells in quotes, with quotes inside doubled, or free of quotes and commas. The
# second spelling is for Java, whose matcher must not try cells in another way.
CELL, OWN_CELL = r'(?:"(?:[^"]|"")*"|[^",]*)', r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
RECORD, OWN_RECORD = [rf"\A{cell}(?:,{cell})*{keep}\z" for cell, keep in ((CELL, ""), (OWN_CELL, "+"))]

# What a row of ``_assembled`` is: a record, or what a split has of one that begins earlier,
# that goes on later, or both.
WHOLE, END, BEGIN, MIDDLE = range(4)
FIELDS = "file string, start bigint, part int, record string"


class MalformedRecord(ValueError):
    """A quote that is not closed, or stands where none may be."""


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every line with its file and the place where its split begins. Lines end with a line
    feed only; what the reader takes apart beyond that is put together again."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _without_returns(values: pa.Array) -> pa.Array:
    if pc.any(pc.ends_with(values, "\r")).as_py():
        return pc.replace_substring_regex(values, "\r\\z", "")
    return values


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.Array]]:
    """(file, start, whether they are the split's first, lines), batch by batch."""
    before = None
    for batch in batches:
        starts = batch.column("start").to_numpy()
        ends = pc.run_end_encode(batch.column("file"))
        change = {*(np.flatnonzero(starts[1:] != starts[:-1]) + 1).tolist(), *ends.run_ends.to_pylist()}
        begin = 0
        for end in sorted(change | {len(starts)}):
            if end > begin:
                split = (batch.column("file")[begin].as_py(), int(starts[begin]))
                yield *split, split != before, batch.column("value").slice(begin, end - begin)
                before, begin = split, end


class _Assembler:
    """Records of one split, whose lines come in order."""

    def __init__(self, inside: bool):
        self.inside = self.began_inside = inside
        self.held: list[str] = []

    def take(self, values: pa.Array) -> tuple[pa.Array, str | None]:
        """The records that end in these lines, and apart from them the end of one that an
        earlier split began."""
        values = _without_returns(values)
        quotes = np.cumsum(pc.count_substring(values, '"').to_numpy()) + self.inside
        after = quotes % 2 == 1
        ends = np.flatnonzero(~after)
        self.inside = bool(after[-1])
        if not len(ends):
            self.held += values.to_pylist()
            return values.slice(0, 0), None
        cuts = pa.array(np.concatenate(([0], ends + 1)), pa.int32())
        last = int(ends[-1]) + 1
        if last == len(ends):
            records = values.slice(0, last)
        else:
            records = pc.binary_join(pa.ListArray.from_arrays(cuts, values.slice(0, last)), "\n")
        earlier = None
        if self.held or self.began_inside:
            first = "\n".join([*self.held, records[0].as_py()])
            records = records.slice(1)
            if self.began_inside:
                earlier, self.began_inside = first, False
            else:
                records = pa.concat_arrays([pa.array([first], pa.string()), records.cast(pa.string())])
        self.held = values.slice(last).to_pylist()
        return records.filter(pc.not_equal(records, "")), earlier

    def rest(self) -> tuple[int, str] | None:
        """What is left when the split ends."""
        if self.began_inside:
            return MIDDLE, "\n".join(self.held)
        return (BEGIN, "\n".join(self.held)) if self.inside else None


def _checked(records: pa.Array) -> pa.Array:
    sound = pc.match_substring_regex(records, RECORD)
    if not pc.all(sound).as_py():
        shown = records.filter(pc.invert(sound))[0].as_py()[:200]
        raise MalformedRecord(f"misplaced or unclosed quote in export record: {shown}")
    return records


def first_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file and record, the first of each file that has one.

    A task stops behind the first record of a file, and files are dealt one to a task, so
    what is read does not depend on how long files are. Should files have shared a task
    nevertheless, all are read to find the records that were passed over.
    """
    importable(spark)

    def first(batches: Iterator[pa.RecordBatch], stop: bool) -> Iterator[pa.RecordBatch]:
        state, done = None, False
        for file, start, fresh, values in _splits(batches):
            if fresh:
                state, done = _Assembler(False), start > 0
            if not done:
                records, _ = state.take(values)
                if len(records):
                    done = True
                    yield pa.RecordBatch.from_arrays([pa.array([file]), records.slice(0, 1).cast(pa.string())], ["file", "record"])
            if done and stop:
                return

    conf, whole = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    spark.conf.set(conf, spark.conf.get(whole))  # no two files in a task
    try:
        every = lines(spark, paths)
        found = written(every.mapInArrow(lambda b: first(b, True), "file string, record string"), "export-headers")
        if found.count() < len(every.inputFiles()):
            found = written(every.mapInArrow(lambda b: first(b, False), "file string, record string"), "export-headers")
        return found
    finally:
        spark.conf.set(conf, before)


def _splits_inside(every: DataFrame, paths: list[str]) -> dict[tuple[str, int], bool]:
    """For every split that does not begin a file, whether it begins inside a cell.

    At most one entry for each split of a large file. Where all files are too small to be
    split, or compressed, nothing is read for it.
    """
    spark = every.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    least = min(size(spark.conf.get(f"spark.sql.files.{name}")) for name in ("maxPartitionBytes", "openCostInBytes"))
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    if files.where((F.col("length") > least) & ~F.col("path").endswith(".gz")).isEmpty():
        return {}
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = every.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = odd.select("file", "start", (F.sum("odd").over(earlier) % 2 == 1).alias("inside")).where("start > 0")
    return {(row.file, row.start): bool(row.inside) for row in states.collect()}


def _assembled(every: DataFrame, inside: dict[tuple[str, int], bool]) -> DataFrame:
    """Rows of ``FIELDS``. A split that was not counted is a fault: files or the cluster have
    changed since."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part: int, records: pa.Array) -> pa.RecordBatch:
            n = len(records)
            columns = [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([part] * n, pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, records.cast(pa.string())], ["file", "start", "part", "record"])

        state, file, start, header = None, None, None, False
        for next_file, next_start, fresh, values in _splits(batches):
            if fresh:
                if state and (left := state.rest()):
                    yield rows(left[0], pa.array([left[1]]))
                file, start = next_file, next_start
                state, header = _Assembler(start > 0 and inside[file, start]), start == 0
            records, earlier = state.take(values)
            if earlier is not None:
                yield rows(END, pa.array([earlier]))
            if header and len(records):
                records, header = records.slice(1), False
            if len(records):
                yield rows(WHOLE, _checked(records))
        if state and (left := state.rest()):
            yield rows(left[0], pa.array([left[1]]))

    return every.mapInArrow(assemble, FIELDS)


def _stitched(parts: DataFrame) -> DataFrame:
    """Records from what several splits have of them; few rows, at most two of a split."""
    order = Window.partitionBy("file").orderBy("start", "part")
    began = F.max(F.when(F.col("part") == BEGIN, F.col("start"))).over(order)
    joined = F.expr("listagg(record, '\\n') WITHIN GROUP (ORDER BY start, part)")
    whole = parts.withColumn("began", began).groupBy("file", "began").agg(joined.alias("record"))
    sound = F.col("record").rlike(OWN_RECORD)
    complaint = F.concat(F.lit("misplaced or unclosed quote in export record: "), F.substring("record", 1, 200))
    return whole.where(F.when(sound, F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))).select("file", "record")


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file and record of every record but the first of its file.

    A record without its own line, and a line break written as two characters, read as in
    any CSV: blank lines between records are skipped, a break inside a cell is a line feed.
    A record with a misplaced or unclosed quote fails the read, whatever is asked of it.
    """
    importable(spark)
    every = lines(spark, paths)
    inside = _splits_inside(every, paths)
    found = _assembled(every, inside)
    if not any(inside.values()):
        # No record crosses a split; one that a file leaves open is complained about.
        complaint = F.concat(F.lit("misplaced or unclosed quote in export record: "), F.substring("record", 1, 200))
        sound = F.when(F.col("part") == WHOLE, F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
        return found.where(sound).select("file", "record")
    found = written(found, "export-records")
    whole = found.where(F.col("part") == WHOLE).select("file", "record")
    return whole.unionByName(_stitched(found.where(F.col("part") != WHOLE)))
