"""How a site is doing: totals, headline numbers, top lists, the daily series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import labels
from footfall.functions.times import (
    Instant,
    cutoff_text,
    day_of,
    day_text,
    since_filter,
    split_at,
)
from footfall.operators.visits import human, visits
from footfall.schema import VISIT_ID, single_row

# List sizes, the levels of the daily chart, the days a trend needs.
TOP_PAGES = TOP_REFERRERS = 8
TOP_COUNTRIES = 6
LEVELS = 8
TREND_DAYS = 5


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast("long"))


def totals(hits: DataFrame) -> DataFrame:
    """Human visits, human hits (events included) and bot visits, in one pass.

    Hits fold to one row per visit first; all buffers are fixed-width, so both
    steps are hash aggregations.
    """
    per_visit = hits.groupBy(*VISIT_ID).agg(
        F.max("bot").alias("bot"), F.count_if(F.col("bot") == 0).alias("human_hits")
    )
    return per_visit.agg(
        F.count_if(F.col("bot") == 0).alias("human_visits"),
        _total(F.col("human_hits")).alias("human_hits"),
        F.count_if(F.col("bot") > 0).alias("bot_visits"),
    )


def begun_before(rows: DataFrame, earlier_hits: DataFrame) -> DataFrame:
    """Which of some visits have an earlier hit, too.

    Only visits that ``rows`` has can matter, so the earlier hits give their ids alone and
    are narrowed to them: Spark filters the scan by a bloom filter, or by the ids
    themselves, before anything of the archive is shuffled.
    """
    wanted = rows.select(*[F.col(name).alias(f"of_{name}") for name in VISIT_ID])
    same = [earlier_hits[name].eqNullSafe(wanted[f"of_{name}"]) for name in VISIT_ID]
    return earlier_hits.select(*VISIT_ID).join(wanted, same[0] & same[1], "left_semi").distinct()


def with_began(rows: DataFrame, candidates: DataFrame, earlier_hits: DataFrame | None) -> DataFrame:
    """Adds ``began``: whether a visit has no hit before the cutoff. Right for
    ``candidates``, the visits for which it is asked."""
    if earlier_hits is None:
        return rows.withColumn("began", F.lit(True))
    older = begun_before(candidates, earlier_hits).select(
        *[F.col(name).alias(f"of_{name}") for name in VISIT_ID], F.lit(False).alias("found")
    )
    same = [rows[name].eqNullSafe(older[f"of_{name}"]) for name in VISIT_ID]
    joined = rows.join(older, same[0] & same[1], "left")
    return joined.withColumn("began", F.coalesce("found", F.lit(True))).drop(
        "found", *[f"of_{name}" for name in VISIT_ID]
    )


def near_and_far(hits: DataFrame, since: Instant | None) -> tuple[DataFrame, DataFrame | None]:
    return (hits, None) if since is None else split_at(hits, since)


def headline_facts(since: Instant | None) -> dict[str, Column]:
    """What the headline needs of each visit, as aggregates over its hits."""
    recent = F.col("created_at") >= cutoff_text(since)
    person = recent & (F.col("bot") == 0)
    return {
        "recent_hits": F.count_if(recent),
        "human_hits": F.count_if(person),
        "human_pages": F.count_if(person & (F.col("is_event") == 0)),
        "human_events": F.count_if(person & (F.col("is_event") == 1)),
        "bot_hits": F.count_if(recent & (F.col("bot") > 0)),
    }


def single_page() -> Column:
    """Visits of people with one page, as far as the hits since the cutoff show."""
    return (F.col("bot") == 0) & (F.col("page_count") == 1) & (F.col("recent_hits") > 0)


def headline_counts() -> list[Column]:
    """The headline as aggregates over visits that carry the facts and ``began``."""
    return [
        F.count_if(F.col("human_hits") > 0).alias("visitors"),
        _total(F.col("human_pages")).alias("pageviews"),
        _total(F.col("human_events")).alias("events"),
        F.count_if(F.col("bot_hits") > 0).alias("bots"),
        F.count_if(single_page() & F.col("began")).alias("single_page"),
    ]


def headline(hits: DataFrame, since: Instant | None = None) -> DataFrame:
    """Visitors, pageviews, events and bots since a cutoff, and single-page visits
    that began since then.

    The first four look at hits, the last at whole visits: a session mixing human
    and bot hits is a visitor but not a human visit. Days before the cutoff only tell
    which single-page visits began earlier; see ``begun_before``.
    """
    near, far = near_and_far(hits, since)
    per_visit = near.groupBy(*VISIT_ID).agg(
        F.max("bot").alias("bot"),
        F.count_if(F.col("is_event") == 0).alias("page_count"),
        *[fact.alias(name) for name, fact in headline_facts(since).items()],
    )
    return with_began(per_visit, per_visit.where(single_page()), far).agg(*headline_counts())


def count_by(frame: DataFrame, label: Column) -> DataFrame:
    return frame.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def top(counts: DataFrame, limit: int) -> DataFrame:
    """The largest counts; equal counts by label, so the cut is always the same."""
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("label")).limit(limit)


def top_pages(hits: DataFrame, since: Instant | None = None, limit: int = TOP_PAGES) -> DataFrame:
    views = human(since_filter(hits, since)).where(F.col("is_event") == 0)
    return top(count_by(views, F.col("path")), limit)


def _visits_since(hits: DataFrame, field: str, since: Instant | None) -> DataFrame:
    near, far = near_and_far(hits, since)
    rows = human(visits(near, entry=(field,))).where(F.col("first_seen") >= cutoff_text(since))
    return with_began(rows, rows, far).where("began")


def top_referrers(hits: DataFrame, since: Instant | None = None, limit: int = TOP_REFERRERS) -> DataFrame:
    rows = _visits_since(hits, "referrer", since)
    return top(count_by(rows, labels.referrer_or_direct(F.col("referrer"))), limit)


def top_countries(hits: DataFrame, since: Instant | None = None, limit: int = TOP_COUNTRIES) -> DataFrame:
    rows = _visits_since(hits, "country", since)
    return top(count_by(rows, labels.country_or_unknown(F.col("country"))), limit)


def daily_series(hits: DataFrame, as_of: Instant, since: Instant | None = None) -> DataFrame:
    """Human pageviews of every calendar day up to the day of ``as_of``, zeros included.

    Starts on the day of ``since``, or of the first human hit (an event counts for
    that); no human hit at all gives no rows. Gaps are filled from each counted day
    to the next one, so the hits are read once. That window has no partitions on
    purpose: it runs over the counts, at most one row per calendar day.
    """
    end = F.lit(dt.date.fromisoformat(day_text(as_of)))
    days = human(hits).withColumn("day", day_of(hits)).where(F.col("day") <= end)
    pages = F.count_if(F.col("is_event") == 0).alias("n")
    if since is None:
        counts = days.groupBy("day").agg(pages)
    else:
        start = F.lit(dt.date.fromisoformat(day_text(since)))
        first = single_row(hits.sparkSession).select(start.alias("day"), F.lit(0).cast("long").alias("n"))
        counted = days.where(F.col("day") >= start).groupBy("day").agg(pages)
        counts = counted.unionByName(first.where(start <= end)).groupBy("day").agg(F.sum("n").alias("n"))
    next_day = F.lead("day").over(Window.orderBy("day"))
    filled = counts.withColumn("until", F.coalesce(F.date_sub(next_day, 1), end)).select(
        F.col("day").alias("counted"), "n", F.explode(F.sequence("day", "until")).alias("day")
    )
    n = F.when(F.col("day") == F.col("counted"), F.col("n")).otherwise(F.lit(0).cast("long"))
    return filled.select("day", n.alias("n")).orderBy("day")


def daily_levels(series: DataFrame) -> DataFrame:
    """Each day's height on the chart, 0 to 7 relative to the peak; NULL for an empty
    day, which must not look like a small one. Runs over one row per calendar day."""
    peak = F.max("n").over(Window.partitionBy(F.lit(0)))
    level = F.floor(F.col("n") * (LEVELS - 1) / peak)
    return series.select("day", "n", F.when(F.col("n") > 0, level).alias("level"))


def series_summary(series: DataFrame) -> DataFrame:
    """Peak and coverage of a series, and whether it supports calling it a trend."""
    summary = series.agg(
        F.max("n").alias("peak"),
        F.count_if(F.col("n") > 0).alias("days_with_data"),
        F.count("*").alias("days_total"),
    )
    state = (
        F.when(F.col("days_total") == 0, "no data")
        .when(F.col("peak") == 0, "no pageviews")
        .otherwise("ok")
    )
    return summary.select(
        "peak",
        "days_with_data",
        "days_total",
        (F.col("days_with_data") < TREND_DAYS).alias("too_few_days"),
        state.alias("state"),
    )


def avg_duration(hits: DataFrame) -> DataFrame:
    """Mean duration of the human visits whose duration can be measured."""
    return human(visits(hits, entry=())).agg(
        F.avg("duration_seconds").alias("avg_seconds"),
        F.count("duration_seconds").alias("measured_visits"),
        F.count("*").alias("human_visits"),
    )
