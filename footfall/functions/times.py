"""Time is RFC 3339 text and is compared as text; "now" is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cutoff that lets everything through, and the ranges of the
# overview with their days.
ALL_TIME = "0000-01-01T00:00:00Z"
RANGES = {"7 days": 7, "28 days": 28, "all time": None}

Instant = str | dt.date | dt.datetime


def instant_text(value: Instant) -> str:
    """UTC text of an instant; naive datetimes and dates count as UTC."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    elif not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value.replace(microsecond=0).isoformat() + "Z"


def cutoff_text(since: Instant | None) -> str:
    """Inclusive lower bound; ``None`` is all time."""
    return ALL_TIME if since is None else instant_text(since)


def days_before(as_of: Instant, days: int) -> str:
    """The cutoff of a "last n days" range."""
    moment = dt.datetime.fromisoformat(instant_text(as_of))
    return instant_text(moment - dt.timedelta(days=days))


def range_start(name: str, as_of: Instant) -> str | None:
    """The cutoff of a named range."""
    days = RANGES[name]
    return None if days is None else days_before(as_of, days)


def day_text(value: Instant) -> str:
    return instant_text(value)[:10]


def to_instant(text: Column) -> Column:
    """Timestamp of RFC 3339 text, NULL when it is not a time (even in ANSI mode)."""
    return text.try_cast("timestamp")


def to_seconds(text: Column) -> Column:
    """Whole seconds since the epoch, NULL when the text is not a time."""
    return F.unix_timestamp(to_instant(text))


def text_day(text: Column) -> Column:
    """The day written in the text, NULL unless it is a plain YYYY-MM-DD.

    The round trip rejects spellings such as 2024-1-5, whose text order differs
    from their date order; partition pruning relies on the two agreeing.
    """
    day = F.substring(text, 1, 10)
    parsed = day.try_cast("date")
    return F.when(parsed.cast("string") == day, parsed)


def day_of(hits: DataFrame) -> Column:
    """The day of each hit: the stored column where there is one, so that counting by
    day does not read the text."""
    return F.col("event_date") if "event_date" in hits.columns else text_day(F.col("created_at"))


def since_filter(hits: DataFrame, since: Instant | None) -> DataFrame:
    """Hits at or after a cutoff. The text predicate decides; the day predicate it
    implies lets a table partitioned by ``event_date`` skip whole days."""
    if since is None:
        return hits.where(F.col("created_at") >= ALL_TIME)
    cutoff = cutoff_text(since)
    kept = hits.where(F.col("created_at") >= cutoff)
    return _from_day(kept, cutoff[:10])


def split_at(hits: DataFrame, since: Instant) -> tuple[DataFrame, DataFrame]:
    """Hits that can belong to a visit begun at or after a cutoff, and those before it.

    A hit without a time rules nothing out and is on the first side. Both sides skip the
    days that the cutoff implies.
    """
    cutoff = cutoff_text(since)
    at = F.col("created_at")
    near = hits.where((at >= cutoff) | at.isNull())
    far = hits.where(at < cutoff)
    if "event_date" in hits.columns:
        bound = F.lit(dt.date.fromisoformat(cutoff[:10]))
        far = far.where((F.col("event_date") <= bound) | F.col("event_date").isNull())
    return _from_day(near, cutoff[:10]), far


def _from_day(hits: DataFrame, day: str) -> DataFrame:
    if "event_date" not in hits.columns:
        return hits
    # Text that is no date sits in the NULL partition and may still pass as text.
    bound = F.lit(dt.date.fromisoformat(day))
    return hits.where((F.col("event_date") >= bound) | F.col("event_date").isNull())
