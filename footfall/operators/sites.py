"""Sync state and per-site reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import labels
from footfall.functions.times import Instant
from footfall.schema import SYNC_STATE

# What a site's freshness column says.
NEVER_SYNCED = "never synced"
SAMPLE_DATA = "demo data"


def sync_state(sync_log: DataFrame) -> DataFrame:
    """Current state per site: the cursor never goes back, the time is the latest
    call's, rows add up. A site without calls has no row: it was never synced."""
    latest = F.max(F.struct("seq", "synced_at"))  # calls of one number: the later time
    folded = sync_log.groupBy("site").agg(
        F.max(F.coalesce("last_hit_id", F.lit(0).cast("long"))).alias("last_hit_id"),
        latest.getField("synced_at").alias("last_synced_at"),
        F.sum("rows").alias("synced_rows"),
    )
    cursor = F.when(F.col("last_hit_id") > 0, F.col("last_hit_id")).alias("cursor")
    return folded.select("*", cursor).select(*SYNC_STATE.fieldNames())


def site_rollup(sites: DataFrame, hits: DataFrame, sync_log: DataFrame, as_of: Instant) -> DataFrame:
    """Every configured site with its human visits, human hits and freshness."""
    per_visit = hits.groupBy("site", "session").agg(
        F.max("bot").alias("bot"), F.count_if(F.col("bot") == 0).alias("human_hits")
    )
    per_site = per_visit.groupBy("site").agg(
        F.count_if(F.col("bot") == 0).alias("visits"),
        F.count_if(F.col("bot") > 0).alias("bot_visits"),
        F.sum("human_hits").alias("human_hits"),
    )
    zero = F.lit(0).cast("long")
    age = F.concat(labels.age_label(F.col("last_synced_at"), as_of), F.lit(" ago"))
    freshness = F.when(F.col("is_demo"), SAMPLE_DATA).otherwise(F.coalesce(age, F.lit(NEVER_SYNCED)))
    return (
        sites.join(per_site, "site", "left")
        .join(sync_state(sync_log), "site", "left")
        .select(
            "site",
            "is_demo",
            F.coalesce("visits", zero).alias("visits"),
            F.coalesce("human_hits", zero).alias("human_hits"),
            F.coalesce("bot_visits", zero).alias("bot_visits"),
            "last_synced_at",
            F.coalesce("synced_rows", zero).alias("synced_rows"),
            freshness.alias("last_synced"),
        )
    )


def stalest_site(rollup: DataFrame) -> DataFrame:
    """The site to sync next: never synced first, then the oldest; sample data never."""
    return (
        rollup.where(~F.col("is_demo"))
        .orderBy(F.asc_nulls_first("last_synced_at"), "site")
        .limit(1)
        .select("site", "last_synced_at", "last_synced")
    )
