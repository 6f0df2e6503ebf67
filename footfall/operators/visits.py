"""Visits (one row per session of a site) and the lists made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import labels, times
from footfall.schema import ENTRY_FIELDS, VISIT_ID, VISITS

# How many rows the two lists show.
RECENT_LIMIT = 500
LIST_LIMIT = 25

# Ids that are few enough to be sent to every task.
FEW = 10_000

# Columns of the recent list; it leaves the referrer scheme out.
RECENT_COLUMNS = [name for name in VISITS.fieldNames() if name != "referrer_scheme"]


def visits(
    hits: DataFrame,
    keys: Sequence[str] = tuple(VISIT_ID),
    entry: Sequence[str] = tuple(ENTRY_FIELDS),
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per visit, from a single aggregation.

    The entry is the earliest flagged hit; its fields ride along in the minimum of
    (time, key, fields), so neither a window nor a self-join is needed and a huge
    session shrinks to one row per task before the shuffle. Name only the ``entry``
    fields you need: the others are not read. ``extra`` aggregates join the pass.
    """
    extra = extra or {}
    entry_row = F.struct("created_at", "hit_key", *[F.col(ENTRY_FIELDS[name]).alias(name) for name in entry])
    first_seen, last_seen = F.col("first_seen"), F.col("last_seen")
    aggregates = [
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.count_if(F.col("is_event") == 0).alias("page_count"),
        F.count_if(F.col("is_event") == 1).alias("event_count"),
        F.max("bot").alias("bot"),
        F.count("*").alias("observations"),
        *[aggregate.alias(name) for name, aggregate in extra.items()],
    ]
    if entry:
        aggregates.append(F.min(F.when(F.col("first_visit") == 1, entry_row)).alias("entry"))
    grouped = hits.groupBy(*keys).agg(*aggregates)
    return grouped.select(
        *keys,
        "first_seen",
        "last_seen",
        "page_count",
        "event_count",
        "bot",
        *[F.col(f"entry.{name}").alias(name) for name in entry],
        F.when(
            F.col("observations") > 1, times.to_seconds(last_seen) - times.to_seconds(first_seen)
        ).alias("duration_seconds"),
        *extra,
    )


def human(frame: DataFrame) -> DataFrame:
    """Rows of people. On visits this is a filter on the aggregated class, so a
    session with a single bot hit is a bot visit."""
    return frame.where(F.col("bot") == 0)


def newest(visit_rows: DataFrame, limit: int | None) -> DataFrame:
    ordered = visit_rows.orderBy(F.desc("first_seen"), F.asc("session"), F.asc("site"))
    return ordered if limit is None else ordered.limit(limit)


def newest_visits(
    hits: DataFrame, limit: int | None, entry: Sequence[str], include_bots: bool = False
) -> DataFrame:
    """The newest visits with their entry fields, in two steps.

    First every visit is reduced to when it began and its class, and the newest ``limit``
    are taken; then only the hits of these are read with all they hold. Their ids are at
    most ``limit`` rows; up to ``FEW`` of them are broadcast, more are joined as Spark sees
    fit.
    """
    began = hits.groupBy(*VISIT_ID).agg(F.min("created_at").alias("first_seen"), F.max("bot").alias("bot"))
    began = began if include_bots else human(began)
    if limit is None:
        rows = visits(hits, entry=entry)
        return newest(rows if include_bots else human(rows), None)
    wanted = newest(began, limit).select(*[F.col(name).alias(f"of_{name}") for name in VISIT_ID])
    same = [hits[name].eqNullSafe(wanted[f"of_{name}"]) for name in VISIT_ID]
    chosen = hits.join(F.broadcast(wanted) if limit <= FEW else wanted, same[0] & same[1], "left_semi")
    return newest(visits(chosen, entry=entry), limit)


def visit_list(hits: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The printed list of the newest human visits."""
    return listed(newest_visits(hits, limit, ("entry_path", "referrer", "country", "browser")))


def listed(rows: DataFrame) -> DataFrame:
    """Visits as the list prints them."""
    return rows.select(
        labels.list_when(F.col("first_seen")).alias("when"),
        "country",
        "browser",
        labels.referrer_or_direct(F.col("referrer")).alias("referrer"),
        F.col("page_count").alias("pages"),
        labels.seconds_or_dash(F.col("duration_seconds")).alias("duration"),
        F.coalesce("entry_path", F.lit("?")).alias("entry"),
    )


def visit_labels(hits: DataFrame, as_of: times.Instant) -> DataFrame:
    """Every human visit with the labels the stream shows."""
    rows = human(visits(hits, entry=("referrer", "browser", "country")))
    return rows.select(
        *VISIT_ID,
        labels.list_when(F.col("first_seen")).alias("list_when"),
        labels.stream_when(F.col("first_seen"), as_of).alias("stream_when"),
        labels.age_label(F.col("last_seen"), as_of).alias("age"),
        labels.duration_label(F.col("duration_seconds")).alias("duration"),
        labels.source_label(F.col("referrer")).alias("source"),
        labels.referrer_or_direct(F.col("referrer")).alias("referrer"),
        labels.country_or_unknown(F.col("country")).alias("country"),
        labels.browser_family(F.col("browser")).alias("browser"),
    )
