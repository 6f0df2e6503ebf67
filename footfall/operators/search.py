"""Search over visits that also looks at the paths inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.visits import (
    RECENT_COLUMNS,
    RECENT_LIMIT,
    human,
    newest,
    newest_visits,
    visits,
)

# Visit fields a reader sees on the row.
ROW_FIELDS = ("entry_path", "referrer", "country", "browser")


def _contains(column: str, query: str) -> Column:
    """Literal, case-insensitive substring; unknown never matches."""
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(query))), F.lit(False))


def _matches(hits: DataFrame, query: str, entry: Sequence[str] = ROW_FIELDS) -> DataFrame:
    """Matching visits with the reason: '' when the row itself shows the match, else
    the earliest matching path inside the visit. An empty query matches everything.

    The inner search is one more aggregate of the visit grouping, so looking inside
    costs no second scan and no join.
    """
    if not query:
        return visits(hits, entry=entry).withColumn("match_reason", F.lit(""))
    step = F.when(_contains("path", query), F.struct("created_at", "hit_key", "path"))
    rows = visits(hits, entry=entry, extra={"inner": F.min(step)})
    on_row = F.lit(False)
    for field in ROW_FIELDS:
        on_row = on_row | _contains(field, query)
    return (
        rows.withColumn("on_row", on_row)
        .where(F.col("on_row") | F.col("inner").isNotNull())
        .withColumn("match_reason", F.when(F.col("on_row"), "").otherwise(F.col("inner.path")))
    )


def search_visits(
    hits: DataFrame,
    query: str = "",
    include_bots: bool = False,
    limit: int | None = RECENT_LIMIT,
) -> DataFrame:
    """Visits matching ``query``, newest first, people only unless bots are asked for.

    The search takes all of history; with nothing to search for, only the newest visits
    are looked at closely.
    """
    entry = (*ROW_FIELDS, "system")
    if not query:
        rows = newest_visits(hits, limit, entry, include_bots)
        return rows.withColumn("match_reason", F.lit("")).select(*RECENT_COLUMNS, "match_reason")
    found = _matches(hits, query, entry)
    found = found if include_bots else human(found)
    return newest(found, limit).select(*RECENT_COLUMNS, "match_reason")


def recent_visits(
    hits: DataFrame,
    include_bots: bool = False,
    limit: int | None = RECENT_LIMIT,
) -> DataFrame:
    """The newest visits: a search for nothing in particular."""
    return search_visits(hits, "", include_bots, limit)


def match_reasons(hits: DataFrame, query: str, include_bots: bool = False) -> DataFrame:
    """How many matching visits each reason accounts for."""
    found = _matches(hits, query)
    found = found if include_bots else human(found)
    return found.groupBy("match_reason").agg(F.count("*").alias("n"))


def hidden_matches(hits: DataFrame, query: str, limit: int = RECENT_LIMIT) -> DataFrame:
    """When no human visit matches: how many would with bots shown, at most ``limit``
    (what the list could show). Zero when there are human matches."""
    found = _matches(hits, query).agg(
        F.count_if(F.col("bot") == 0).alias("visible"), F.count("*").alias("everyone")
    )
    shown = F.least("everyone", F.lit(limit).cast("long"))
    return found.select(
        "visible",
        F.when(F.col("visible") == 0, shown).otherwise(F.lit(0).cast("long")).alias("hidden"),
    )
