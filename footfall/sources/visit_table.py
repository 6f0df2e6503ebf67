"""Visits kept up to date beside the stored hits.

Every row is the whole state of a visit, in the partition of the day it began on, so a
question about the last days reads those days and nothing of the archive: a visit that
began earlier has its row there. States merge (least, greatest, sums, earliest entry), so
new hits are folded into states on their own and merged with what the table knows of their
visits, whatever the order in which hits arrive.

A refresh folds the files of hits that no earlier one has folded. It appends rows under a
number of its own and then writes the names of the files under that number, which makes the
rows valid: one that fails on the way leaves nothing behind that is ever read. The latest
row of a visit in a partition counts. A visit that turns out to have begun on another day
leaves a row there that says so.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions import labels, times
from footfall.operators import overview
from footfall.operators.visits import LIST_LIMIT, human, listed, newest
from footfall.schema import ENTRY_FIELDS, VISIT_ID, VISITS
from footfall.session import written
from footfall.sources.store import Store, _read_or_empty

_ENTRY = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("created_at", "hit_key", *ENTRY_FIELDS)]
)
_COUNTS = ("page_count", "event_count", "observations", "human_hits")
STATES = T.StructType(
    [
        *[T.StructField(name, T.StringType()) for name in (*VISIT_ID, "first_seen", "last_seen")],
        *[T.StructField(name, T.LongType()) for name in ("bot", *_COUNTS)],
        T.StructField("entry", _ENTRY),
        T.StructField("moved", T.BooleanType()),
        T.StructField("began", T.DateType()),
        T.StructField("batch", T.LongType()),
    ]
)
FOLDED = T.StructType(
    [T.StructField("batch", T.LongType()), T.StructField("base", T.LongType()), T.StructField("file", T.StringType())]
)
_STATE = [name for name in STATES.fieldNames() if name not in ("moved", "began", "batch")]


def states(hits: DataFrame) -> DataFrame:
    """The state of every visit of some hits, in one aggregation."""
    entry = F.struct("created_at", "hit_key", *[F.col(field).alias(name) for name, field in ENTRY_FIELDS.items()])
    person = F.col("bot") == 0
    return hits.groupBy(*VISIT_ID).agg(
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.max("bot").alias("bot"),
        F.count_if(F.col("is_event") == 0).alias("page_count"),
        F.count_if(F.col("is_event") == 1).alias("event_count"),
        F.count("*").alias("observations"),
        F.count_if(person).alias("human_hits"),
        F.min(F.when(F.col("first_visit") == 1, entry)).alias("entry"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """One state for each visit, of any number of states of parts of it."""
    return parts.groupBy(*VISIT_ID).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("bot").alias("bot"),
        *[F.sum(name).alias(name) for name in _COUNTS],
        F.min("entry").alias("entry"),
    )


def as_visits(rows: DataFrame) -> DataFrame:
    """States as the visits that they are."""
    seconds = times.to_seconds(F.col("last_seen")) - times.to_seconds(F.col("first_seen"))
    return rows.select(
        *VISIT_ID,
        *("first_seen", "last_seen", "page_count", "event_count", "bot"),
        *[F.col(f"entry.{name}").alias(name) for name in ENTRY_FIELDS],
        F.when(F.col("observations") > 1, seconds).alias("duration_seconds"),
    ).select(*VISITS.fieldNames())


def _same_visit(left: DataFrame, right: DataFrame) -> Column:
    one, two = [left[name].eqNullSafe(right[f"of_{name}"]) for name in VISIT_ID]
    return one & two


def _ids(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(*[F.col(name).alias(f"of_{name}") for name in VISIT_ID], *more)


def latest(rows: DataFrame) -> DataFrame:
    """Of each visit's rows in a partition the one of the highest number, unless it says
    that the visit has moved."""
    state = F.struct(*[name for name in _STATE if name not in VISIT_ID], "moved")
    kept = rows.groupBy(*VISIT_ID, "began").agg(F.max_by(state, "batch").alias("state"))
    return kept.where(~F.col("state.moved")).select(*VISIT_ID, "state.*", "began").select(*_STATE, "began")


@dataclass(frozen=True)
class VisitTable:
    """The visits of a store. A single writer at a time is assumed, as for the store."""

    store: Store

    @property
    def path(self) -> str:
        return f"{self.store.folder}/visits"

    @property
    def log_path(self) -> str:
        return f"{self.store.folder}/visits_folded"

    def refresh(self, spark: SparkSession) -> int:
        """Fold what the store has got since the last refresh; tells how many files.

        Reads the new files, the ids of known visits, and the states of the days that the
        visits of the new files began on. After a replaced store everything is folded anew.
        """
        number, base, known = self._folded(spark)
        hits = self.store.hits(spark)
        # What an insert writes bears names of its own. The driver lists them to read at all.
        listed = {unquote(file.rsplit("/", 1)[1]) for file in hits.inputFiles()}
        if known - listed:
            known, base = set(), number
        fresh = sorted(listed - known)
        if fresh:
            if known:
                hits = hits.where(F.col("_metadata.file_name").isin(fresh))
            self._merge(spark, states(hits), number, base)
        if fresh or base == number:
            self._commit(spark, number, base, fresh)
        return len(fresh)

    def compact(self, spark: SparkSession) -> None:
        """Write the states that count as one batch, which reading then has to look at."""
        number, base, known = self._folded(spark)
        rows = self._states(spark, base).withColumn("moved", F.lit(False))
        self._write(rows, number)
        self._commit(spark, number, number, sorted(known))

    def _folded(self, spark: SparkSession) -> tuple[int, int, set[str]]:
        """The next number, the first one that counts, and the files folded since then."""
        log = _read_or_empty(spark, self.log_path, FOLDED)
        done = log.agg(F.max("batch").alias("batch"), F.max("base").alias("base")).first()
        if done.batch is None:
            return 0, 0, set()
        files = log.where((F.col("base") == done.base) & F.col("file").isNotNull())
        return done.batch + 1, done.base, {row.file for row in files.select("file").collect()}

    def _merge(self, spark: SparkSession, delta: DataFrame, number: int, base: int) -> None:
        delta, known = written(delta, "visits-delta"), self._states(spark, base)
        wanted = _ids(delta)
        # Where visits of the new hits are known: at most one row per day.
        places = known.join(wanted, _same_visit(known, wanted), "left_semi").select("began").distinct()
        known = self._states(spark, base, [row.began for row in places.collect()])
        known = written(known.join(wanted, _same_visit(known, wanted), "left_semi"), "visits-known")
        now = merged(known.select(*_STATE).unionByName(delta))
        now = now.withColumns({"moved": F.lit(False), "began": times.text_day(F.col("first_seen"))})
        begins = _ids(now, F.col("began").alias("begins"))
        left = known.join(begins, _same_visit(known, begins)).where(~F.col("began").eqNullSafe(F.col("begins")))
        gone = left.select(*_STATE, F.lit(True).alias("moved"), "began")
        self._write(now.unionByName(gone), number)

    def _write(self, rows: DataFrame, number: int) -> None:
        """Rows under a number that is not valid yet; what a failed call left there goes."""
        ordered = rows.hint("rebalance", "began").sortWithinPartitions("began", "site", "first_seen")
        ordered.write.mode("overwrite").partitionBy("began").parquet(f"{self.path}/batch={number}")

    def _commit(self, spark: SparkSession, number: int, base: int, files: list[str]) -> None:
        rows = spark.createDataFrame([(number, base, file) for file in files or [None]], FOLDED)
        rows.coalesce(1).write.mode("append").parquet(self.log_path)

    def _rows(self, spark: SparkSession, base: int | None = None) -> DataFrame:
        log = _read_or_empty(spark, self.log_path, FOLDED)
        numbers = [(row.base, row.batch) for row in log.select("base", "batch").distinct().collect()]
        base = max((b for b, _ in numbers), default=0) if base is None else base
        valid = [batch for b, batch in numbers if b == base]
        return _read_or_empty(spark, self.path, STATES).where(F.col("batch").isin(valid))

    def _states(self, spark: SparkSession, base: int | None = None, days: list[dt.date | None] | None = None) -> DataFrame:
        """The states that count, of visits that began on some days or of all."""
        rows = self._rows(spark, base)
        if days is not None:
            dated = [day for day in days if day is not None]
            kept = F.col("began").isin(dated)
            rows = rows.where(kept if len(dated) == len(days) else kept | F.col("began").isNull())
        return latest(rows)

    def visits(self, spark: SparkSession) -> DataFrame:
        """All visits, as ``operators.visits.visits`` makes them of all hits."""
        return as_visits(self._states(spark))

    def begun_since(self, spark: SparkSession, since: times.Instant | None) -> DataFrame:
        """Visits that began at or after a cutoff; only the days from there on are read."""
        cutoff = times.cutoff_text(since)
        rows = self._rows(spark)
        if since is not None:
            day = F.lit(dt.date.fromisoformat(cutoff[:10]))
            rows = rows.where((F.col("began") >= day) | F.col("began").isNull())
        return as_visits(latest(rows)).where(F.col("first_seen") >= cutoff)

    def headline(self, spark: SparkSession, since: times.Instant | None = None) -> DataFrame:
        """``operators.overview.headline`` of the hits since a cutoff and the visits begun
        since then; nothing older is read."""
        near = times.since_filter(self.store.hits(spark), since)
        facts = [fact.alias(name) for name, fact in overview.headline_facts(since).items()]
        *by_hits, single = overview.headline_counts()
        of_hits = near.groupBy(*VISIT_ID).agg(*facts).agg(*by_hits, F.lit(0).cast("long").alias("single_page"))
        one_page = (F.col("bot") == 0) & (F.col("page_count") == 1)
        zeros = [F.lit(0).cast("long").alias(name) for name in of_hits.columns[:-1]]
        of_visits = self.begun_since(spark, since).agg(*zeros, F.count_if(one_page).alias("single_page"))
        return of_hits.unionByName(of_visits).agg(*[F.sum(name).alias(name) for name in of_hits.columns])

    def top_referrers(self, spark: SparkSession, since: times.Instant | None = None, limit: int = overview.TOP_REFERRERS) -> DataFrame:
        label = labels.referrer_or_direct(F.col("referrer"))
        return overview.top(overview.count_by(human(self.begun_since(spark, since)), label), limit)

    def top_countries(self, spark: SparkSession, since: times.Instant | None = None, limit: int = overview.TOP_COUNTRIES) -> DataFrame:
        label = labels.country_or_unknown(F.col("country"))
        return overview.top(overview.count_by(human(self.begun_since(spark, since)), label), limit)

    def newest_visits(self, spark: SparkSession, limit: int, include_bots: bool = False) -> DataFrame:
        """The visits that began last, found by walking days backwards.

        Twice as many days are looked at each time, until they have enough visits: what began
        on an earlier day cannot be among the newest. Visits whose begin names no day may be
        anywhere in the order and are always looked at.
        """
        rows = self._rows(spark)
        days = sorted({match[1] for file in rows.inputFiles() if (match := re.search(r"/began=(\d{4}-\d\d-\d\d)/", file))}, reverse=True)
        seen = 1
        while True:
            chosen = [dt.date.fromisoformat(day) for day in days[:seen]]
            found = self._states(spark, None, [*chosen, None])
            found = found if include_bots else human(found)
            if seen >= len(days) or found.count() >= limit:
                return newest(as_visits(found), limit)
            seen *= 2

    def visit_list(self, spark: SparkSession, limit: int = LIST_LIMIT) -> DataFrame:
        """``operators.visits.visit_list`` of the newest days."""
        return listed(self.newest_visits(spark, limit))
