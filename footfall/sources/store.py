"""Stored tables: hits as Parquet by day, and the log of syncs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.times import Instant, instant_text
from footfall.operators.sites import sync_state
from footfall.schema import HITS, SYNC_LOG, empty, single_row
from footfall.session import written
from footfall.sources.exports import read_export

# Files of the log of syncs, one per call, before they are put together.
LOG_FILES = 100
# A hit of a day is stored once per site; the whole digest decides, not the short key.
HIT_ID = ["event_date", "site", "row_digest"]


@dataclass(frozen=True)
class Inserted:
    """``fetched`` rows were offered, ``new`` of them were not stored before."""

    fetched: int
    new: int

    @property
    def status(self) -> str:
        if self.fetched == 0:
            return "nothing new"
        return "already stored" if self.new == 0 else "synced"


@dataclass(frozen=True)
class Store:
    """Folders of one store. A single writer at a time is assumed."""

    folder: str

    @property
    def hits_path(self) -> str:
        return f"{self.folder}/hits"

    @property
    def log_path(self) -> str:
        return f"{self.folder}/sync_log"

    def hits(self, spark: SparkSession, site: str | None = None) -> DataFrame:
        """Stored hits, of one site if named; parts of files without that site are skipped."""
        hits = _read_or_empty(spark, self.hits_path, HITS)
        return hits if site is None else hits.where(F.col("site") == site)

    def sync_log(self, spark: SparkSession) -> DataFrame:
        """All calls; one that is in two files, see ``fold_log``, counts once."""
        return _read_or_empty(spark, self.log_path, SYNC_LOG).distinct()

    def fold_log(self, spark: SparkSession) -> None:
        """Put the files of the log together, so that reading it opens a bounded number of
        files after any number of calls.

        The calls are written as one more file before the others go; a failure in between
        leaves some of them twice, which reading makes good. Calls keep their numbers and
        origins, so what repeats one is still known.
        """
        files = _read_or_empty(spark, self.log_path, SYNC_LOG).inputFiles()
        self.sync_log(spark).coalesce(1).write.mode("append").parquet(self.log_path)
        for file in files:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)

    def insert(self, batch: DataFrame) -> Inserted:
        """Append the hits that are not stored yet; the rest is ignored.

        Of the hits of one identity, what is stored wins over what is offered, and the least
        by all columns over the others, so how rows are dealt into batches never changes how
        many are stored. A digest covers the date: only the batch's own days are compared.
        The batch is looked at twice, first for its days alone, and must be the same both
        times; give one that is costly to make as a written table. A repeated call after a
        failure finds what was written and adds the rest.
        """
        spark = batch.sparkSession
        batch = batch.select(*HITS.fieldNames())
        # One row per day, however large the batch.
        days = batch.groupBy("event_date").agg(F.count("*").alias("rows")).collect()
        if not days:
            return Inserted(0, 0)
        known = _on_days(self.hits(spark), [row.event_date for row in days])
        new = _write_hits(first_wins(known, batch), self.hits_path, "append")
        return Inserted(sum(row["rows"] for row in days), new)

    def next_cursor(self, spark: SparkSession, site: str) -> int | None:
        """Where the next export of a site should start; None means from the beginning."""
        state = sync_state(self.sync_log(spark).where(F.col("site") == site)).first()
        return None if state is None else state.cursor

    def record(
        self,
        spark: SparkSession,
        site: str,
        synced_at: Instant,
        rows: int,
        last_hit_id: int | None = None,
        origin: str | None = None,
    ) -> None:
        """Note a sync. The calls of a site are numbered in the order they are noted,
        whoever makes them; a call of an ``origin`` that is noted already is not noted
        again."""
        calls = self.sync_log(spark).where(F.col("site") == site)
        noted = calls.agg(
            F.max("seq").alias("seq"), F.count_if(F.col("origin") == F.lit(origin)).alias("same")
        ).first()
        if noted.same:
            return
        values = (site, (noted.seq or 0) + 1, last_hit_id, instant_text(synced_at), rows, origin)
        entry = single_row(spark).select(
            *[F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(values, SYNC_LOG)]
        )
        entry.write.mode("append").parquet(self.log_path)
        if len(_read_or_empty(spark, self.log_path, SYNC_LOG).inputFiles()) > LOG_FILES:
            self.fold_log(spark)

    def sync(
        self,
        spark: SparkSession,
        paths: str | list[str],
        site: str,
        synced_at: Instant,
        last_hit_id: int | None = None,
        origin: str | None = None,
        **export_options,
    ) -> Inserted:
        """Read export files, store what is new, note the sync. ``last_hit_id`` is the
        cursor that came with the export; see ``next_cursor``. Files are parsed once."""
        result = self.insert(written(read_export(spark, paths, site, **export_options), "batch"))
        self.record(spark, site, synced_at, result.new, last_hit_id, origin)
        return result

    def replace(self, spark: SparkSession, hits: DataFrame) -> None:
        """Start over with these hits instead of merging into what is stored.

        The log goes first: should the rest fail, the next sync starts from the beginning
        rather than behind hits that are gone.
        """
        empty(spark, SYNC_LOG).write.mode("overwrite").parquet(self.log_path)
        _write_hits(first_wins(empty(spark, HITS), hits.select(*HITS.fieldNames())), self.hits_path, "overwrite")


def first_wins(known: DataFrame, offered: DataFrame) -> DataFrame:
    """The offered hits whose identity is not known, one of each.

    Both are ranked by identity in one pass, the known first; unknown sites and days are
    equal to each other. Tasks keep the first of an identity before anything is shuffled,
    so copies that a third of the rows are go no further.
    """
    rest = [name for name in HITS.fieldNames() if name not in HIT_ID]
    stored = known.select(*HIT_ID, *[F.lit(None).cast(HITS[name].dataType).alias(name) for name in rest], F.lit(0).alias("turn"))
    both = stored.unionByName(offered.withColumn("turn", F.lit(1)))
    turn = F.row_number().over(Window.partitionBy(*HIT_ID).orderBy("turn", *rest))
    first = both.withColumn("place", turn).where(F.col("place") == 1)
    return first.where(F.col("turn") == 1).select(*HITS.fieldNames())


def _write_hits(hits: DataFrame, path: str, mode: str) -> int:
    """Files of even size by day, sorted by site and visit inside, so that a filter on
    either skips parts of files. Tells how many hits were written.

    Rebalancing splits a day that holds much of the data over many tasks and packs
    small days together, which hash partitioning by day would not. Rows are counted by the
    tasks that write, each of which counts once however often it was tried.
    """
    counted = Observation()
    (
        hits.hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "site", "session", "created_at")
        .observe(counted, F.count(F.lit(1)).alias("rows"))
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(path)
    )
    return counted.get["rows"]


def _on_days(hits: DataFrame, days: list[dt.date | None]) -> DataFrame:
    """Stored hits of exactly these days; hits without a day are a partition too."""
    dated = [day for day in days if day is not None]
    kept = F.col("event_date").isin(dated)
    return hits.where(kept if len(dated) == len(days) else kept | F.col("event_date").isNull())


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(path)
    return empty(spark, schema)
