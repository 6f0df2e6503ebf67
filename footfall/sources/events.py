"""Adapter: a generic ``events`` table seen as hits, a site list and a sync log.

The mapping is arbitrary but deterministic and covers every case the operators
separate: bots, mixed sessions, unflagged entries, events, empty referrers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import times
from footfall.schema import HITS, SYNC_LOG

# What the remainders of the adapter's ids stand for.
REFERRERS = "array('', 'search.example', 'forum.example', 'mail.example', '', 'wiki.example', 'spring flyer')"
SCHEMES = "array('o', 'h', 'g', 'h', 'o', 'h', 'c')"
COUNTRIES = "array('', 'PT', 'JP', 'BR', 'KE', 'CA')"
BROWSERS = "array('Otter 9', 'Heron 3.1', 'Lynx 2.9', '')"
SYSTEMS = "array('Pine 4', 'Cedar 12', 'Maple')"

# Naming the schema saves the job that reads it from a file.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
REGION = "r_regionkey int, r_name string"

CLOCK = "CAST(ts AS STRING)"
DAY = "CAST(CAST(ts AS DATE) AS STRING)"
CREATED_AT = f"concat({DAY}, 'T', substring({CLOCK}, 12, 8), 'Z')"
IS_PAGE = "event_type IN ('view', 'error')"
IS_HOME = "(event_type = 'click' AND event_id % 4 = 0)"
PAGE = f"CASE WHEN {IS_PAGE} THEN concat('/p/', event_id % 12) WHEN {IS_HOME} THEN '/'"
SITE = "concat('site-', user_id % 3)"
DIGEST = "sha2(concat_ws('|', event_id, user_id, event_type, props), 256)"

COLUMNS = {
    "hit_key": f"substring({DIGEST}, 1, 16)",
    "row_digest": DIGEST,
    "session": f"concat(user_id, '-', replace({DAY}, '-', ''))",
    "path": f"{PAGE} ELSE concat('tap: ', event_type) END",
    "title": f"{PAGE} ELSE '' END",
    "is_event": f"CASE WHEN {IS_PAGE} OR {IS_HOME} THEN 0 ELSE 1 END",
    "browser": f"{BROWSERS}[user_id % 4]",
    "system": f"{SYSTEMS}[user_id % 3]",
    "bot": "CASE WHEN user_id % 5 = 0 THEN 1 + user_id % 3 WHEN event_id % 97 = 0 THEN 2L ELSE 0L END",
    "referrer": f"{REFERRERS}[(event_id + user_id) % 7]",
    "referrer_scheme": f"{SCHEMES}[(event_id + user_id) % 7]",
    "screen_size": "'2400,1350,2'",
    "country": f"{COUNTRIES}[user_id % 6]",
    "first_visit": "CASE WHEN (event_id * 7 + user_id) % 5 < 3 THEN 1 ELSE 0 END",
    "created_at": CREATED_AT,
    "site": SITE,
    "event_date": "CAST(ts AS DATE)",
}


def _project(events: DataFrame) -> DataFrame:
    hits = events.selectExpr("props", *[f"{rule} AS {name}" for name, rule in COLUMNS.items()])
    return hits.withColumn("ts", times.to_instant(F.col("created_at")))


def load_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")


def hits_from_events(events: DataFrame) -> DataFrame:
    return _project(events).select(*HITS.fieldNames())


def load_hits(spark: SparkSession, folder: str) -> DataFrame:
    return hits_from_events(load_events(spark, folder))


def load_export_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The same hits as an export writes them: text cells under the export's names.

    The user agent cell carries JSON, so quotes and commas go through the reader.
    """
    hits = _project(load_events(spark, folder))
    cells = {
        "2Path": "path",
        "Title": "title",
        "Event": "is_event",
        "UserAgent": "props",
        "Browser": "browser",
        "System": "system",
        "Session": "session",
        "Bot": "bot",
        "Referrer": "referrer",
        "Referrer scheme": "referrer_scheme",
        "Screen size": "screen_size",
        "Location": "country",
        "FirstVisit": "first_visit",
        "Date": "created_at",
    }
    return hits.select(*[F.col(source).cast("string").alias(cell) for cell, source in cells.items()])


def load_sites(spark: SparkSession, folder: str) -> DataFrame:
    """One configured site per region; the last one holds sample data."""
    region = spark.read.schema(REGION).parquet(f"{folder}/region.parquet")
    return region.selectExpr("concat('site-', r_regionkey) AS site", "r_regionkey = 4 AS is_demo")


def load_sync_log(spark: SparkSession, folder: str) -> DataFrame:
    """One sync per site and day: its highest id, its last event, its row count."""
    events = load_events(spark, folder)
    calls = events.selectExpr(
        f"{SITE} AS site", f"replace({DAY}, '-', '') AS day", "event_id", f"{CREATED_AT} AS created_at"
    )
    return (
        calls.groupBy("site", "day")
        .agg(
            F.max("event_id").alias("last_hit_id"),
            F.max("created_at").alias("synced_at"),
            F.count("*").alias("rows"),
        )
        .withColumn("seq", F.col("day").cast("long"))
        .withColumn("origin", F.lit(None).cast("string"))
        .select(*SYNC_LOG.fieldNames())
    )
