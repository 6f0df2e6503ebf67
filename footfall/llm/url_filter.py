"""URL filter: path rules, and where none fits, the reputation of the host.

A host's labelled pages are good or bad. Their rate is shrunk through beta-binomial priors
along the chain everything - suffix - registered domain - host: the posterior of a level is
the prior of the next. A prior's size follows from its variance: how uncertain the mean
above is, and how far units differ from it (moments of the beta-binomial), so few labelled
pages in all leave wide bounds everywhere. A unit's own pages are left out of its prior. A
host is allowed when the lower bound of its posterior reaches a threshold; without labelled
pages, its posterior is its prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import written

HOST_AT = r"(?s)^.*?://([^/?#]*)"
PATH_AT = r"(?s)^.*?://[^/?#]*([^?#]*)"

# Bounds of a prior's strength in pseudo-pages, where moments are degenerate.
WEAKEST, STRONGEST = 2.0, 1000.0
# The least size of a prior, where what is above it is next to unknown.
LEAST_SIZE = 0.5
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``. A-Z of the host is lowered."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(
        F.regexp_extract(url, HOST_AT, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(url, PATH_AT, 1)


def with_levels(frame: DataFrame) -> DataFrame:
    """Adds the registered domain (last two labels) and the suffix (last label) of host."""
    return frame.withColumns(
        {
            "domain": F.substring_index("host", ".", -2),
            "suffix": F.substring_index("host", ".", -1),
        }
    )


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> dict[str, Column]:
    """The longest rule that fits and its action; null where none does.

    A rule is ``host/path``: it fits the host, its subdomains, and paths that begin so.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of_host, slash, begin = text.partition("/")
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(slash + begin)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        action = F.when(fits, F.lit(does)).otherwise(action)
    return {"rule": rule, "action": action}


def _posterior(units: DataFrame, good: Column, n: Column, strength: float) -> DataFrame:
    """Replaces ``p`` and ``v``, mean and variance of a prior, by those of the posterior,
    given the pages that count and how strongly units follow their prior.

    Column by column, as an expression of all three levels would be very large.
    """
    room = F.col("p") * (1 - F.col("p"))
    size = room / (F.col("v") + room / (strength + 1)) - 1
    units = units.withColumn("size", F.greatest(size, F.lit(LEAST_SIZE)))
    units = units.withColumn("p", (good + F.col("size") * F.col("p")) / (n + F.col("size")))
    return units.withColumn("v", F.col("p") * (1 - F.col("p")) / (n + F.col("size") + 1))


def _with_prior(units: DataFrame, strengths: list[float]) -> DataFrame:
    """Adds ``p`` and ``v`` that units have without their own pages (n, good), by the levels
    whose strengths are given."""
    good, n = F.col("all_good") - F.col("good"), F.col("all_n") - F.col("n")
    units = units.withColumn("p", (good + 1) / (n + 2))
    units = units.withColumn("v", F.col("p") * (1 - F.col("p")) / (n + 3))
    for name, strength in zip(LEVELS, strengths):
        units = _posterior(units, F.col(f"{name}_good") - F.col("good"), F.col(f"{name}_n") - F.col("n"), strength)
    return units


def _strength(level: DataFrame) -> float:
    """Pseudo-pages that fit the spread of the level's rates around their prior mean ``p``.

    With n pages of a unit and k good ones, a beta-binomial of strength s has variance
    n p (1-p) (1 + (n-1)/(s+1)); the sums of both sides give s. One row comes to the driver.
    """
    expected = F.col("n") * F.col("p") * (1 - F.col("p"))
    seen = F.pow(F.col("good") - F.col("n") * F.col("p"), F.lit(2))
    sums = (
        level.where("n > 1")
        .agg(F.sum(seen - expected).alias("extra"), F.sum(expected * (F.col("n") - 1)).alias("room"))
        .first()
    )
    if sums.room is None:
        return STRONGEST
    return max(WEAKEST, min(STRONGEST, sums.room / max(sums.extra, 1e-9) - 1))


def host_reputation(outcomes: DataFrame, z: float = 1.645, hosts: DataFrame | None = None) -> DataFrame:
    """Per host: n, good, mean and low, the lower bound of the posterior.

    ``outcomes`` has host and good (0 or 1), one row per labelled page; rows where either
    is null are left out. Pages are counted by host before anything is shuffled, so a host
    with a third of all pages is one row per task. The counts are written once; each
    level needs its strength before the next one has its priors.

    ``hosts`` has host, in any number of rows. Those without a labelled page are returned
    too, with n = 0: their posterior is their prior, to which their domain, suffix and
    everything add what they have. Without any labelled page there is nothing to go by, and
    no host is returned.
    """
    counts = with_levels(
        outcomes.where(F.col("host").isNotNull() & F.col("good").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    )
    counts = written(counts, "host-counts")
    total = counts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    everything = {"all_n": F.lit(total.n or 0).cast("long"), "all_good": F.lit(total.good or 0).cast("long")}
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    levels = [counts.groupBy(*LEVELS[: depth + 1]).agg(*sums) for depth in range(len(LEVELS))]

    def with_above(units: DataFrame, depth: int) -> DataFrame:
        """The counts of what a unit belongs to; none where nothing there is labelled."""
        for name, level in zip(LEVELS[:depth], levels):
            above = level.select(name, F.col("n").alias(f"{name}_n"), F.col("good").alias(f"{name}_good"))
            units = units.join(above, name, "left").na.fill(0, [f"{name}_n", f"{name}_good"])
        return units.withColumns(everything)

    strengths: list[float] = []
    for depth, level in enumerate(levels):
        strengths.append(_strength(_with_prior(with_above(level, depth), strengths)))
    every = counts
    if hosts is not None and total.n:
        # One row per host before the joins by domain and suffix.
        others = with_levels(hosts.select("host").where("host IS NOT NULL").distinct().join(counts, "host", "left_anti"))
        none = F.lit(0).cast("long")
        every = counts.unionByName(others.withColumns({"n": none, "good": none}))
    *above, own = strengths
    rated = _posterior(_with_prior(with_above(every, len(above)), above), F.col("good"), F.col("n"), own)
    return rated.select("host", "n", "good", F.col("p").alias("mean"), (F.col("p") - z * F.sqrt("v")).alias("low"))


def judge_urls(
    pages: DataFrame,
    reputation: DataFrame,
    rules: list[tuple[str, str]] = (),
    least: float = 0.6,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (``allow`` or ``block``).

    The longest rule decides; without one, the host's lower bound must reach ``least``. A
    host that ``reputation`` does not have is allowed; give ``host_reputation`` the hosts
    of the pages for it to have all of them, the empty host of a null url included. Rules are
    a list of fixed length in the code, tested as one expression. Rows with the same id or
    url are judged each; a url of any length is looked at whole; an empty table gives no
    rows; other columns are not read.
    """
    host, path = url_parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns(matching_rule(F.col("host"), F.col("path"), rules))
    known = reputation.select("host", "low")
    judged = rows.join(known, "host", "left")
    by_host = F.when(F.coalesce(F.col("low"), F.lit(1.0)) >= least, "allow").otherwise("block")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("action", by_host).alias("verdict")
    )
