"""Display labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.times import Instant, instant_text, to_seconds

# The words a report shows.
DIRECT = "direct"
UNKNOWN = "?"
UNKNOWN_COUNTRY = "??"
NO_DURATION = "—"
RECENT = "moments"
MINUTE, HOUR, DAY, WEEK = 60, 3600, 86400, 7 * 86400


def source_label(referrer: Column) -> Column:
    """Three-way: unknown (NULL), direct (blank) or the referrer itself."""
    return (
        F.when(referrer.isNull(), F.lit(UNKNOWN))
        .when(referrer.rlike(r"\A\p{IsWhite_Space}*\z"), F.lit(DIRECT))
        .otherwise(referrer)
    )


def referrer_or_direct(referrer: Column) -> Column:
    """Two-way: reports that do not separate unknown from direct."""
    return F.coalesce(F.nullif(referrer, F.lit("")), F.lit(DIRECT))


def country_or_unknown(country: Column) -> Column:
    return F.coalesce(F.nullif(country, F.lit("")), F.lit(UNKNOWN_COUNTRY))


def browser_family(browser: Column) -> Column:
    """The browser without its version: the text before the first space."""
    return F.when(F.instr(browser, " ") > 1, F.substring_index(browser, " ", 1)).otherwise(browser)


def duration_label(seconds: Column) -> Column:
    minutes, hours = F.floor(seconds / MINUTE), F.floor(seconds / HOUR)
    return (
        F.when(seconds.isNull(), F.lit(NO_DURATION))
        .when(seconds < MINUTE, F.format_string("%ds", seconds))
        .when(seconds < HOUR, F.format_string("%dm%02ds", minutes, seconds % MINUTE))
        .otherwise(F.format_string("%dh%02dm", hours, F.floor(seconds % HOUR / MINUTE)))
    )


def seconds_or_dash(seconds: Column) -> Column:
    return F.coalesce(F.concat(seconds.cast("string"), F.lit("s")), F.lit("-"))


def list_when(created_at: Column) -> Column:
    """MM-DD HH:MM, cut from the text."""
    return F.concat(F.substring(created_at, 6, 5), F.lit(" "), F.substring(created_at, 12, 5))


def stream_when(created_at: Column, as_of: Instant) -> Column:
    """Clock only on the day of ``as_of``, weekday within a week, else the date."""
    now = instant_text(as_of)
    wall = created_at.try_cast("timestamp_ntz")
    age = to_seconds(F.lit(now)) - to_seconds(created_at)
    return (
        F.when(F.substring(created_at, 1, 10) == now[:10], F.date_format(wall, "HH:mm"))
        .when(age < WEEK, F.date_format(wall, "EEE HH:mm"))
        .otherwise(F.date_format(wall, "dd MMM HH:mm"))
    )


def age_label(moment: Column, as_of: Instant) -> Column:
    """How long before ``as_of``: moments, minutes, hours or days."""
    age = to_seconds(F.lit(instant_text(as_of))) - to_seconds(moment)

    def whole(unit: int) -> Column:
        return F.floor(age / unit)

    return (
        F.when(age.isNull(), F.lit(None).cast("string"))
        .when(age < MINUTE, F.lit(RECENT))
        .when(age < HOUR, F.format_string("%dm", whole(MINUTE)))
        .when(age < DAY, F.format_string("%dh", whole(HOUR)))
        .otherwise(F.format_string("%dd", whole(DAY)))
    )
