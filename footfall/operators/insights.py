"""Questions the overview does not answer, and checks on the stored hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import labels
from footfall.operators.overview import count_by, top
from footfall.operators.visits import human, visits
from footfall.schema import VISIT_ID

# Sizes and thresholds of the reports.
TOP_PATHS = 10
DEEP_VISIT_PAGES = 4
JOURNEY_PAGES = 3
OVERLONG_SECONDS = 3600
OVERLONG_LIMIT = 5
NIGHT_HOURS = (1, 5)
DAY_HOURS = (10, 16)


def reached_from(hits: DataFrame, path: str) -> DataFrame:
    """Where human visits that reached ``path`` came from, counting every view of it.

    Views are counted inside the visit grouping, so repeated views add up without a
    join fanning them out.
    """
    views = F.count_if(F.col("path") == path)
    rows = human(visits(hits, entry=("referrer",), extra={"views": views}))
    return (
        rows.where(F.col("views") > 0)
        .groupBy(labels.referrer_or_direct(F.col("referrer")).alias("referrer"))
        .agg(F.sum("views").alias("n"))
        .orderBy(F.desc("n"), "referrer")
    )


def traffic_shares(hits: DataFrame) -> DataFrame:
    """Counts with their denominators, never ratios. Visits whose class is negative
    are neither human nor bot and are shown on their own."""
    per_visit = hits.groupBy(*VISIT_ID).agg(
        F.max("bot").alias("bot"),
        F.count_if(F.col("is_event") == 0).alias("page_count"),
        F.count_if(F.col("is_event") == 1).alias("event_count"),
    )
    is_human = F.col("bot") == 0
    return per_visit.agg(
        F.count("*").alias("visits"),
        F.count_if(is_human).alias("human_visits"),
        F.count_if(F.col("bot") > 0).alias("bot_visits"),
        F.count_if(F.col("bot") < 0).alias("unclassified_visits"),
        F.count_if(is_human & (F.col("page_count") == 1)).alias("single_page_visits"),
        F.count_if(F.col("page_count") >= DEEP_VISIT_PAGES).alias("deep_visits"),
        F.coalesce(F.sum("event_count"), F.lit(0).cast("long")).alias("events"),
    )


def hour_histogram(hits: DataFrame) -> DataFrame:
    """Human hits by the hour written in their time."""
    hour = F.substring("created_at", 12, 2).try_cast("int")
    return human(hits).groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))


def day_and_night(hours: DataFrame) -> DataFrame:
    """Sums of an hour histogram over night and day."""

    def span(bounds: tuple[int, int]):
        inside = F.when(F.col("hour").between(*bounds), F.col("n"))
        return F.coalesce(F.sum(inside), F.lit(0).cast("long"))

    return hours.agg(span(NIGHT_HOURS).alias("night"), span(DAY_HOURS).alias("day"))


def deep_entry_counts(hits: DataFrame, min_pages: int = JOURNEY_PAGES) -> DataFrame:
    """Where human visits of several pages began."""
    rows = human(visits(hits, entry=("entry_path",))).where(F.col("page_count") >= min_pages)
    return (
        rows.groupBy("entry_path")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("entry_path"))
    )


def top_paths(hits: DataFrame, limit: int = TOP_PATHS) -> DataFrame:
    """Most frequent paths of human hits, event names included."""
    return top(count_by(human(hits), F.col("path")), limit)


def overlong_visits(
    hits: DataFrame, seconds: int = OVERLONG_SECONDS, limit: int | None = OVERLONG_LIMIT
) -> DataFrame:
    """The longest visits above a bound, a sign that two loads were merged."""
    rows = visits(hits, entry=()).where(F.col("duration_seconds") > seconds)
    ordered = rows.select(*VISIT_ID, "duration_seconds").orderBy(F.desc("duration_seconds"), "session", "site")
    return ordered if limit is None else ordered.limit(limit)


def key_audit(hits: DataFrame) -> DataFrame:
    """Rows, distinct keys, empty keys and keys held by more than one row of a site."""
    per_key = hits.groupBy("site", "hit_key").agg(F.count("*").alias("n"))
    empty = F.coalesce(F.col("hit_key"), F.lit("")) == ""
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("hits"),
        F.count("*").alias("keys"),
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0).cast("long")).alias("empty_keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
    )


def key_drift(first: DataFrame, second: DataFrame) -> DataFrame:
    """Keys whose number of rows differs between two reads; none when keys are stable."""
    counts = key_counts(first, second)
    return counts.where(F.col("first_rows") != F.col("second_rows"))


def key_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every key of two reads with its number of rows in each."""
    sides = first.select("hit_key", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        second.select("hit_key", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return sides.groupBy("hit_key").agg(F.sum("a").alias("first_rows"), F.sum("b").alias("second_rows"))
