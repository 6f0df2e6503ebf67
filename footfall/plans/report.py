"""The whole overview as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import labels
from footfall.functions.times import Instant, cutoff_text
from footfall.operators.overview import (
    TOP_COUNTRIES,
    TOP_REFERRERS,
    daily_series,
    headline_counts,
    headline_facts,
    near_and_far,
    top_pages,
    with_began,
)
from footfall.operators.visits import visits
from footfall.schema import single_row

HEADLINE = ["visitors", "pageviews", "events", "bots", "single_page"]


def overview_report(
    hits: DataFrame,
    as_of: Instant,
    since: Instant | None = None,
) -> DataFrame:
    """Rows of (section, position, label, n): headline, referrers, countries, pages, daily.

    The three visit-level sections share one grouping of the hits by visit and one
    aggregation over grouping sets; pages and days read the hits once each.
    """
    pages = top_pages(hits, since).select(F.lit("pages").alias("section"), "label", "n")
    days = daily_series(hits, as_of, since).select(
        F.lit("daily").alias("section"), F.col("day").cast("string").alias("label"), "n"
    )
    ranked = Window.orderBy(F.desc("n"), "label")
    return (
        _visit_sections(hits, since)
        .unionByName(pages.withColumn("position", F.row_number().over(ranked)))
        .unionByName(days.withColumn("position", F.row_number().over(Window.orderBy("label"))))
    )


def _visit_sections(hits: DataFrame, since: Instant | None) -> DataFrame:
    facts = headline_facts(since)
    near, far = near_and_far(hits, since)
    rows = visits(near, entry=("referrer", "country"), extra=facts)
    listed = (F.col("bot") == 0) & (F.col("first_seen") >= cutoff_text(since))
    rows = with_began(rows, rows.where(listed), far)
    listed = listed & F.col("began")
    rows = rows.select(
        "bot",
        "page_count",
        "began",
        *facts,
        labels.referrer_or_direct(F.col("referrer")).alias("referrers"),
        labels.country_or_unknown(F.col("country")).alias("countries"),
        listed.alias("listed"),
    )
    # Grouping sets over no rows lack the grand total; a visit of nothing provides it.
    nothing = single_row(rows.sparkSession).select(
        *[F.lit(0).cast("long").alias(name) for name in ("bot", "page_count", *facts)],
        F.lit(True).alias("began"),
        F.lit(None).cast("string").alias("referrers"),
        F.lit(None).cast("string").alias("countries"),
        F.lit(False).alias("listed"),
    )
    counted = rows.unionByName(nothing).groupingSets(
        [["referrers"], ["countries"], []], "referrers", "countries"
    ).agg(
        F.grouping("referrers").alias("no_referrer"),
        F.grouping("countries").alias("no_country"),
        F.count_if("listed").alias("listed"),
        *headline_counts(),
    )

    def line(section: str, order, label, n):
        return F.struct(
            F.lit(section).alias("section"), order.alias("order"), label.alias("label"), n.alias("n")
        )

    def listing(section: str):
        return F.array(line(section, -F.col("listed"), F.col(section), F.col("listed")))

    top_line = F.array(
        *[
            line("headline", F.lit(place).cast("long"), F.lit(name), F.col(name))
            for place, name in enumerate(HEADLINE)
        ]
    )
    lines = (
        F.when(F.col("no_referrer") == 0, listing("referrers"))
        .when(F.col("no_country") == 0, listing("countries"))
        .otherwise(top_line)
    )
    position = F.row_number().over(Window.partitionBy("section").orderBy("order", "label"))
    # The constant bound lets Spark cut each task's share before the shuffle.
    longest = max(TOP_REFERRERS, TOP_COUNTRIES, len(HEADLINE))
    return (
        counted.select(F.inline(lines))
        .where((F.col("n") > 0) | (F.col("section") == "headline"))
        .withColumn("position", position)
        .where(F.col("position") <= longest)
        .where((F.col("section") != "countries") | (F.col("position") <= TOP_COUNTRIES))
        .select("section", "position", "label", "n")
    )
