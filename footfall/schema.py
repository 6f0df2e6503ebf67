"""Fixed table schemas. Column comments travel in the field metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(name: str, data_type: T.DataType, comment: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, data_type, nullable, {"comment": comment})


HITS = T.StructType(
    [
        _field("hit_key", T.StringType(), "content hash of the export row"),
        _field("row_digest", T.StringType(), "whole content hash; tells hits of a site apart"),
        _field("session", T.StringType(), "salted visitor hash, changes every day"),
        _field("path", T.StringType(), "page path; the event name when is_event = 1"),
        _field("title", T.StringType(), "page title"),
        _field("is_event", T.IntegerType(), "1 for an event, 0 for a pageview"),
        _field("browser", T.StringType(), "browser name and version"),
        _field("system", T.StringType(), "operating system and version"),
        _field("bot", T.LongType(), "0 is a human, above 0 a class of bot"),
        _field("referrer", T.StringType(), "normalised referrer; '' is a direct visit"),
        _field("referrer_scheme", T.StringType(), "how the referrer was given: h = link, g = generated, c = campaign, o = other"),
        _field("screen_size", T.StringType(), "width,height,scale"),
        _field("country", T.StringType(), "ISO 3166-2 code"),
        _field("first_visit", T.IntegerType(), "1 when the tracker marked a visit's first hit"),
        _field("created_at", T.StringType(), "RFC 3339 text, compared as text"),
        _field("site", T.StringType(), "site the hit belongs to"),
        _field("ts", T.TimestampType(), "created_at as an instant; NULL when it is not a time"),
        _field("event_date", T.DateType(), "day of created_at; the storage partition"),
    ]
)

#: A visit is a session of one site.
VISIT_ID = ["site", "session"]

VISITS = T.StructType(
    [
        _field("site", T.StringType(), "site that was visited"),
        _field("session", T.StringType(), "the visit"),
        _field("first_seen", T.StringType(), "created_at of its first hit"),
        _field("last_seen", T.StringType(), "created_at of its last hit"),
        _field("page_count", T.LongType(), "hits that are pages"),
        _field("event_count", T.LongType(), "hits that are events"),
        _field("bot", T.LongType(), "highest bot class among its hits"),
        _field("entry_path", T.StringType(), "path of the earliest flagged hit; NULL is unknown"),
        _field("referrer", T.StringType(), "referrer of the entry; NULL is unknown, '' is direct"),
        _field("referrer_scheme", T.StringType(), "referrer scheme of the entry"),
        _field("country", T.StringType(), "country of the entry"),
        _field("browser", T.StringType(), "browser of the entry"),
        _field("system", T.StringType(), "system of the entry"),
        _field("duration_seconds", T.LongType(), "last minus first hit; NULL with one observation"),
    ]
)

SYNC_LOG = T.StructType(
    [
        _field("site", T.StringType(), "site that was synced"),
        _field("seq", T.LongType(), "call number of the site, growing"),
        _field("last_hit_id", T.LongType(), "cursor reported by the export"),
        _field("synced_at", T.StringType(), "RFC 3339 time of the call"),
        _field("rows", T.LongType(), "hits that were new"),
        _field("origin", T.StringType(), "what repeats the call after a failure; NULL for single calls"),
    ]
)

SYNC_STATE = T.StructType(
    [
        _field("site", T.StringType(), "site"),
        _field("last_hit_id", T.LongType(), "highest cursor seen; never goes back"),
        _field("last_synced_at", T.StringType(), "time of the latest sync"),
        _field("synced_rows", T.LongType(), "hits stored by all syncs"),
        _field("cursor", T.LongType(), "where the next sync starts; NULL means from the beginning"),
    ]
)

#: Visit columns taken from the entry hit: visit column -> hit column.
ENTRY_FIELDS = {
    "entry_path": "path",
    "referrer": "referrer",
    "referrer_scheme": "referrer_scheme",
    "country": "country",
    "browser": "browser",
    "system": "system",
}


def empty(spark: SparkSession, fields: T.StructType) -> DataFrame:
    """No rows of a schema, known to the optimizer to be empty."""
    columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in fields]
    return spark.range(0, 1, 1, 1).select(*columns).where(F.lit(False))


def single_row(spark: SparkSession) -> DataFrame:
    """One row without columns of use, to select literals from."""
    return spark.range(0, 1, 1, 1)
