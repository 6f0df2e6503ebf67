"""Time the operators on replicated hits, even and skewed.

Usage: scale_bench.py FOLDER [copies] [query ...]

FOLDER receives the two tables once and is reused. The skewed one moves a third of
all hits into one session, one path and one day.
"""

from __future__ import annotations

import pathlib
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from footfall.functions import times  # noqa: E402
from footfall.operators import insights, journeys, overview, search, visits  # noqa: E402
from footfall.plans import report  # noqa: E402
from footfall.session import build_session  # noqa: E402
from footfall.sources import events  # noqa: E402
from footfall.sources.store import Store  # noqa: E402

AS_OF = "2024-01-31T00:00:00Z"
WEEK = times.days_before(AS_OF, 7)
HOT_DAY = "2024-01-15"

OPERATORS = {
    "visits": visits.visits,
    "visit_list": visits.visit_list,
    "visit_search": lambda hits: search.search_visits(hits, "p/3"),
    "hidden_matches": lambda hits: search.hidden_matches(hits, "p/3"),
    "journeys": journeys.journeys,
    "totals": overview.totals,
    "headline": lambda hits: overview.headline(hits, WEEK),
    "top_pages": lambda hits: overview.top_pages(hits, WEEK),
    "top_referrers": lambda hits: overview.top_referrers(hits, WEEK),
    "daily_series": lambda hits: overview.daily_series(hits, AS_OF),
    "overview_report": lambda hits: report.overview_report(hits, AS_OF, WEEK),
    "avg_duration": overview.avg_duration,
    "traffic_shares": insights.traffic_shares,
    "reached_from": lambda hits: insights.reached_from(hits, "/p/3"),
    "key_audit": insights.key_audit,
}


def copies_of(hits, copies: int):
    copy = F.col("copy").cast("string")
    return (
        hits.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        .withColumn("row_digest", F.sha2(F.concat("row_digest", F.lit("-"), copy), 256))
        .withColumn("hit_key", F.substring("row_digest", 1, 16))
        .withColumn("session", F.concat("session", F.lit("-"), copy))
        .drop("copy")
    )


def skewed(hits):
    hot = F.pmod(F.xxhash64("hit_key"), F.lit(3)) == 0
    moment = F.concat(F.lit(HOT_DAY), F.substring("created_at", 11, 10))
    return hits.withColumns(
        {
            "session": F.when(hot, F.lit("hot")).otherwise(F.col("session")),
            "path": F.when(hot, F.lit("/p/3")).otherwise(F.col("path")),
            "created_at": F.when(hot, moment).otherwise(F.col("created_at")),
            "event_date": F.when(hot, F.lit(HOT_DAY).cast("date")).otherwise(F.col("event_date")),
        }
    )


def main() -> None:
    folder = sys.argv[1]
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    names = sys.argv[3:] or list(OPERATORS)
    spark = build_session(
        "scale",
        "local[8]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = copies_of(events.load_hits(spark, "/root/testdata/sf0.1").repartition(64), copies)
    for kind, source in (("even", base), ("skewed", skewed(base))):
        store = Store(f"{folder}/{kind}-{copies}")
        if not pathlib.Path(store.hits_path).exists():
            started = time.time()
            store.replace(spark, source)
            print(f"{kind} write {time.time() - started:.1f}s", flush=True)
        hits = store.hits(spark)
        print(kind, hits.count(), "hits", flush=True)
        for name in names:
            seconds = []
            for _ in range(2):
                started = time.time()
                OPERATORS[name](hits).write.format("noop").mode("overwrite").save()
                seconds.append(time.time() - started)
            print(f"{kind} {name} first {seconds[0]:.1f}s, again {seconds[1]:.1f}s", flush=True)


if __name__ == "__main__":
    main()
