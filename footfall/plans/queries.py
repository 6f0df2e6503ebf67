"""Every operator as a named query over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions import times
from footfall.functions.labels import source_label
from footfall.operators import adhoc, insights, journeys, overview, search, sites, visits
from footfall.plans import report
from footfall.session import shared_folder
from footfall.sources import events
from footfall.sources.exports import read_export
from footfall.sources.store import Store
from footfall.sources.visit_table import VisitTable
from footfall.streaming.landing import ingest_landing

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries; the oracles use the same values.
AS_OF = "2024-01-31T00:00:00Z"
WEEK = times.range_start("7 days", AS_OF)
MONTH = times.range_start("28 days", AS_OF)
SEARCH = "p/3"
PAGE = "/p/3"
HALF = "2024-01-16T00:00:00Z"
AFTER = "2024-02-01T00:00:00Z"
# Few and therefore long visits, one of them without an id; steps without a time.
LONG_SESSION = "CASE WHEN bot > 0 THEN NULL ELSE substring(session, 1, 1) END"
NO_TIME = "CASE WHEN hit_key < '2' THEN NULL WHEN hit_key < '3' THEN '' ELSE created_at END"

ADHOC = """
SELECT s.country, count(*) AS visits, sum(s.page_count) AS pages, max(s.duration_seconds) AS longest
FROM sessions s JOIN (SELECT DISTINCT site, session FROM hits WHERE path = '/') h
  ON h.site = s.site AND h.session = s.session
WHERE s.bot = 0
GROUP BY s.country
"""


def _over_hits(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return operator(events.load_hits(spark, folder), *args, **kwargs)

    return run


def _plain(frame: DataFrame) -> DataFrame:
    """Days as text and instants as seconds: types that compare alike in every engine."""
    columns = {}
    for field in frame.schema:
        if isinstance(field.dataType, T.DateType):
            columns[field.name] = F.col(field.name).cast("string")
        elif isinstance(field.dataType, T.TimestampType):
            columns[field.name] = F.unix_seconds(field.name)
    return frame.withColumns(columns)


def _daily_week(hits: DataFrame) -> DataFrame:
    return _plain(overview.daily_series(hits, AS_OF, WEEK))


def _daily_all(hits: DataFrame) -> DataFrame:
    return _plain(overview.daily_series(hits, AS_OF))


def _hidden_bots(hits: DataFrame) -> DataFrame:
    """Bots get paths of their own, so that one search matches bots only."""
    path = F.when(F.col("bot") > 0, F.concat(F.lit("/crawl"), "path")).otherwise(F.col("path"))
    return search.hidden_matches(hits.withColumn("path", path), "/crawl")


def _levels(hits: DataFrame) -> DataFrame:
    return _plain(overview.daily_levels(overview.daily_series(hits, AS_OF)))


def _summary(hits: DataFrame) -> DataFrame:
    return overview.series_summary(overview.daily_series(hits, AS_OF))


def _day_and_night(hits: DataFrame) -> DataFrame:
    return insights.day_and_night(insights.hour_histogram(hits))


def _source_labels(hits: DataFrame) -> DataFrame:
    rows = visits.human(visits.visits(hits, entry=("referrer",)))
    return overview.count_by(rows, source_label(F.col("referrer")))


def _export_json(hits: DataFrame) -> DataFrame:
    return adhoc.to_json_rows(visits.visits(hits).select("session", "entry_path", "page_count", "duration_seconds"))


def _export_array(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of an exported array, as the files have them."""
    rows = visits.visits(events.load_hits(spark, folder)).orderBy("session", "site")
    path = shared_folder(spark, "array")
    adhoc.write_json_array(rows.select("session", "entry_path", "page_count", "duration_seconds"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _rollup(spark: SparkSession, folder: str) -> DataFrame:
    return sites.site_rollup(
        events.load_sites(spark, folder),
        events.load_hits(spark, folder),
        events.load_sync_log(spark, folder),
        AS_OF,
    )


def _stalest(spark: SparkSession, folder: str) -> DataFrame:
    return sites.stalest_site(_rollup(spark, folder))


def _stalest_synced(spark: SparkSession, folder: str) -> DataFrame:
    rollup = _rollup(spark, folder)
    return sites.stalest_site(rollup.where(F.col("last_synced_at").isNotNull()))


def _sync_state(spark: SparkSession, folder: str) -> DataFrame:
    return sites.sync_state(events.load_sync_log(spark, folder))


def _adhoc(spark: SparkSession, folder: str) -> DataFrame:
    state = sites.sync_state(events.load_sync_log(spark, folder))
    return adhoc.adhoc_sql(events.load_hits(spark, folder), state, ADHOC)


def _write_export(cells: DataFrame) -> str:
    path = shared_folder(cells.sparkSession, "export")
    cells.write.option("header", True).option("escape", '"').csv(path)
    return path


def _export(spark: SparkSession, folder: str) -> DataFrame:
    return read_export(spark, _write_export(events.load_export_cells(spark, folder)))


def _read_export(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_export(spark, folder))


def _hit_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _export(spark, folder).groupBy("hit_key").agg(F.count("*").alias("n"))


def _journeys_in_pieces(hits: DataFrame) -> DataFrame:
    return journeys.journeys(hits.withColumns({"created_at": F.expr(NO_TIME), "session": F.expr(LONG_SESSION)}))


def _two_sites(hits: DataFrame) -> DataFrame:
    """The same sessions on two sites stay apart, and so do their keys."""
    both = hits.withColumn("site", F.explode(F.array(F.lit("one"), F.lit("two"))))
    audit = insights.key_audit(both).select("repeated_keys")
    rows = visits.visits(both, entry=()).select("site", "session", "page_count", "event_count")
    return rows.withColumn("repeated_keys", F.lit(audit.first().repeated_keys).cast("long"))


def _read_odd_export(spark: SparkSession, folder: str) -> DataFrame:
    """Short and long records, quotes, commas and line breaks in cells."""
    cells = [F.expr(events.COLUMNS[name]).alias(name) for name in ("path", "session", "created_at", "bot")]
    rows = events.load_events(spark, folder).select("event_id", *cells)
    kind = F.col("event_id") % 4
    title = F.concat(F.lit('"say ""'), "event_id", F.lit('""\ntwice, or more"'))
    tail = (
        F.when(kind == 1, "")
        .when(kind == 0, F.concat(F.lit(","), title, F.lit(","), "bot"))
        .when(kind == 2, F.concat(F.lit(",plain,"), "bot", F.lit(',"x,y",')))
        .otherwise(F.concat(F.lit(",plain,"), "bot"))
    )
    line = F.concat(F.concat_ws(",", "path", "session", "created_at"), tail)
    # The first record of each file is the header.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    path = shared_folder(spark, "export")
    header = F.lit("2Path,Session,Date,Title,Bot\n")
    rows.select(F.when(first, F.concat(header, line)).otherwise(line).alias("value")).write.text(path)
    return read_export(spark, path).select("hit_key", "path", "session", "created_at", "title", "bot")


def _key_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Two reads of one export, once with the header searched and once with it given."""
    cells = events.load_export_cells(spark, folder)
    path = _write_export(cells)
    counts = insights.key_counts(
        read_export(spark, path), read_export(spark, path, header=",".join(cells.columns))
    )
    return counts.agg(
        F.count("*").alias("keys"),
        F.sum("first_rows").alias("first_rows"),
        F.sum("second_rows").alias("second_rows"),
        F.count_if(F.col("first_rows") != F.col("second_rows")).alias("drifted_keys"),
    )


def _insert_new_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Half the month, the same again, the whole month, the same again."""
    hits = events.load_hits(spark, folder)
    early = hits.where(F.col("created_at") < HALF)
    store = Store(shared_folder(spark, "store"))
    done = [store.insert(batch) for batch in (early, early, hits, hits)]
    stored = store.hits(spark).agg(F.count("*").alias("stored"))
    report_rows = F.array(
        *[
            F.struct(
                F.lit(number).alias("batch"),
                F.lit(result.fetched).cast("long").alias("fetched"),
                F.lit(result.new).cast("long").alias("new"),
                F.lit(result.status).alias("status"),
            )
            for number, result in enumerate(done, 1)
        ]
    )
    return stored.select(F.inline(report_rows), "stored")


def _replaced_hits(spark: SparkSession, folder: str) -> DataFrame:
    """A load replaced by another: only the second is left."""
    hits = events.load_hits(spark, folder)
    store = Store(shared_folder(spark, "store"))
    store.insert(hits)
    store.replace(spark, hits.where(F.col("created_at") >= HALF))
    return _plain(store.hits(spark).groupBy("event_date").agg(F.count("*").alias("n")))


def _stream(spark: SparkSession, folder: str) -> Store:
    landing = _write_export(events.load_export_cells(spark, folder))
    store = Store(shared_folder(spark, "store"))
    # The second run finds no new file.
    for _ in range(2):
        query = ingest_landing(
            spark, landing, store, "site-0", f"{store.folder}/checkpoint", clock=lambda: AS_OF
        )
        query.awaitTermination()
    return store


def _stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_stream(spark, folder).hits(spark))


def _stream_state(spark: SparkSession, folder: str) -> DataFrame:
    return sites.sync_state(_stream(spark, folder).sync_log(spark))


def _state_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """A call, a stream, the same stream again, and a call: numbered in this order."""
    landing = _write_export(events.load_export_cells(spark, folder))
    store = Store(shared_folder(spark, "store"))
    store.sync(spark, landing, "site-0", AS_OF, 7)
    for _ in range(2):
        ingest_landing(
            spark, landing, store, "site-0", f"{store.folder}/checkpoint", clock=lambda: HALF,
            last_hit_id=lambda names: 9,
        ).awaitTermination()
    store.sync(spark, landing, "site-0", AFTER, store.next_cursor(spark, "site-0") - 5)
    log = store.sync_log(spark)
    calls = log.agg(F.max("seq").alias("seq")).first().seq
    return sites.sync_state(log).withColumn("calls", F.lit(calls).cast("long"))


def _kept(spark: SparkSession, folder: str) -> VisitTable:
    """Visits kept by two refreshes: the late half of the month first, then all of it."""
    hits = events.load_hits(spark, folder)
    table = VisitTable(Store(shared_folder(spark, "store")))
    for batch in (hits.where(F.col("created_at") >= HALF), hits):
        table.store.insert(batch)
        table.refresh(spark)
    return table


def _kept_visits(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder).visits(spark)


def _kept_headline(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder).headline(spark, WEEK)


def _kept_visit_list(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder).visit_list(spark)


QUERIES: dict[str, Query] = {
    "visits": _over_hits(visits.visits),
    "visit_list": _over_hits(visits.visit_list),
    "recent_visits": _over_hits(search.recent_visits),
    "recent_visits_with_bots": _over_hits(search.recent_visits, include_bots=True),
    "visit_search": _over_hits(search.search_visits, SEARCH, limit=None),
    "visit_search_with_bots": _over_hits(search.search_visits, SEARCH, include_bots=True, limit=None),
    "visit_search_newest": _over_hits(search.search_visits, "FORUM"),
    "visit_search_reasons": _over_hits(search.match_reasons, "tap", include_bots=True),
    "hidden_bot_matches": _over_hits(_hidden_bots),
    "journeys": _over_hits(journeys.journeys),
    "journeys_in_pieces": _over_hits(_journeys_in_pieces),
    "totals": _over_hits(overview.totals),
    "overview_headline": _over_hits(overview.headline, WEEK),
    "overview_headline_28_days": _over_hits(overview.headline, MONTH),
    "overview_headline_all": _over_hits(overview.headline),
    "top_pages": _over_hits(overview.top_pages, WEEK),
    "top_referrers": _over_hits(overview.top_referrers, WEEK),
    "top_countries": _over_hits(overview.top_countries, WEEK),
    "daily_series": _over_hits(_daily_week),
    "daily_series_all": _over_hits(_daily_all),
    "daily_levels": _over_hits(_levels),
    "series_summary": _over_hits(_summary),
    "overview_report": _over_hits(report.overview_report, AS_OF, WEEK),
    "avg_duration": _over_hits(overview.avg_duration),
    "traffic_shares": _over_hits(insights.traffic_shares),
    "hour_histogram": _over_hits(insights.hour_histogram),
    "day_and_night": _over_hits(_day_and_night),
    "deep_entry_counts": _over_hits(insights.deep_entry_counts),
    "top_paths_any": _over_hits(insights.top_paths),
    "reached_from": _over_hits(insights.reached_from, PAGE),
    "visit_labels": _over_hits(visits.visit_labels, AS_OF),
    "source_labels": _over_hits(_source_labels),
    "overlong_visits": _over_hits(insights.overlong_visits),
    "key_audit": _over_hits(insights.key_audit),
    "site_rollup": _rollup,
    "stalest_site": _stalest,
    "stalest_synced_site": _stalest_synced,
    "sync_state_fold": _sync_state,
    "adhoc_sql": _adhoc,
    "export_json": _over_hits(_export_json),
    "export_json_array": _export_array,
    "read_export": _read_export,
    "hit_keys": _hit_keys,
    "key_drift": _key_drift,
    "insert_new_hits": _insert_new_hits,
    "replaced_hits": _replaced_hits,
    "stream_ingest": _stream_ingest,
    "stream_sync_state": _stream_state,
    "sync_state_mixed": _state_mixed,
    "read_odd_export": _read_odd_export,
    "two_sites": _over_hits(_two_sites),
    "kept_visits": _kept_visits,
    "kept_headline": _kept_headline,
    "kept_visit_list": _kept_visit_list,
}
