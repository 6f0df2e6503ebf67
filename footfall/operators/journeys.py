"""The steps of visits, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.schema import VISIT_ID
from footfall.session import written

STEP_COLUMNS = ("site", "session", "created_at", "hit_key", "path", "title", "is_event")
ORDER = ("site", "session", "created_at", "hit_key")

# A row's number as Spark generates it: the partition above, the place in it below.
PLACE_BITS = 33


def _steps(hits: DataFrame) -> DataFrame:
    return hits.withColumn("title", F.coalesce("title", F.lit(""))).select(*STEP_COLUMNS)


def journey(hits: DataFrame, session: str, site: str | None = None) -> DataFrame:
    """One visit's steps by time, ties by key; ``site`` may be left out where the table
    holds one site.

    Sorted by range, so a visit of any length spreads over tasks.
    """
    chosen = hits.where(F.col("session") == session)
    chosen = chosen if site is None else chosen.where(F.col("site") == site)
    steps = _steps(chosen).orderBy("created_at", "hit_key")
    return steps.select("path", "title", "is_event", "created_at")


def journeys(hits: DataFrame) -> DataFrame:
    """Every step of every visit with its position (from 1) in the visit.

    All steps are sorted over the whole cluster, which cuts even a visit with a third of
    all steps into pieces of a task's size. A step's place in its partition, less that of
    the piece's first step, plus the steps of the visit in earlier partitions, is its
    position. The sorted steps are written once, so that places and pieces agree. The
    window runs over pieces: a visit has one per partition that it reaches into.
    """
    ordered = _steps(hits).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    numbered = ordered.withColumn("number", F.monotonically_increasing_id()).select(
        *STEP_COLUMNS,
        F.shiftright("number", PLACE_BITS).alias("part"),
        F.col("number").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"),
    )
    numbered = written(numbered, "journeys")
    pieces = numbered.groupBy(*VISIT_ID, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*VISIT_ID).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")) - F.col("first") + 1
    offsets = pieces.select(
        F.col("site").alias("of_site"),
        F.col("session").alias("of_session"),
        F.col("part").alias("of_part"),
        offset.alias("offset"),
    )
    same = (
        numbered["site"].eqNullSafe(offsets["of_site"])
        & numbered["session"].eqNullSafe(offsets["of_session"])
        & (numbered["part"] == offsets["of_part"])
    )
    return numbered.join(offsets, same).select(
        *STEP_COLUMNS, (F.col("place") + F.col("offset")).alias("position")
    )
