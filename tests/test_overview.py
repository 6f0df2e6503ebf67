import datetime as dt

import pytest
from frames import one, rows

from pyspark.sql import functions as F

from footfall.operators import insights as i
from footfall.operators import overview as o
from footfall.plans.report import overview_report
from footfall.sources import events

SF = "/root/testdata/sf0.01"
AS_OF = "2026-07-25T12:00:00Z"
WEEK = "2026-07-18T12:00:00Z"


@pytest.fixture
def hits(make_hits):
    return make_hits(
        ("k1", "old", "/", "2026-07-18T11:59:59Z", 1, 0),
        ("k2", "old", "/late", "2026-07-18T12:00:00Z", 0, 0),
        ("k3", "solo", "/", "2026-07-20T08:00:00Z", 1, 0),
        {"hit_key": "k4", "session": "event", "path": "CTA", "created_at": "2026-07-20T09:00:00Z", "is_event": 1, "first_visit": 1, "referrer": "", "country": ""},
        ("k5", "mixed", "/", "2026-07-21T09:00:00Z", 1, 0),
        ("k6", "mixed", "/", "2026-07-21T09:01:00Z", 0, 2),
        ("k7", "unknown", "/x", "2026-07-26T09:01:00Z", 0, 0),
        ("k8", "machine", "/", "2026-07-22T09:01:00Z", 1, 1),
    )


def test_totals(hits):
    assert tuple(one(o.totals(hits))) == (4, 6, 2)


def test_headline_counts_hits_and_visits_apart(hits):
    # old began before the cutoff; mixed is a visitor and a bot, but no human visit.
    assert tuple(one(o.headline(hits, WEEK))) == (5, 4, 1, 2, 2)
    assert tuple(one(o.headline(hits))) == (5, 5, 1, 2, 2)


def test_visits_crossing_the_cutoff_and_hits_without_a_time(make_hits):
    """Begun before the week, a visit is not of the week; a hit without a time is of the
    visit all the same."""
    hits = make_hits(
        ("k1", "across", "/", "2026-05-01T10:00:00Z", 1, 0),
        ("k2", "across", "/x", "2026-07-20T10:00:00Z", 0, 0),
        ("k3", None, "/", "2026-07-20T10:00:00Z", 1, 0),
        ("k4", "vague", "/", "2026-07-20T10:00:00Z", 1, 0),
        ("k5", "vague", "/x", None, 0, 0),
        ("k6", "machine", "/x", None, 0, 4),
        ("k7", "machine", "/", "2026-07-20T10:00:00Z", 1, 0),
        ("k8", "never", "/", None, 1, 0),
        {"hit_key": "k9", "session": "across", "site": "other", "path": "/", "created_at": "2026-07-21T10:00:00Z", "first_visit": 1, "country": "JP"},
    )
    assert tuple(one(o.headline(hits, WEEK))) == (5, 5, 0, 0, 2)
    assert rows(o.top_countries(hits, WEEK)) == [("PT", 2), ("JP", 1)]


def test_empty_overview(make_hits):
    empty = make_hits()
    assert tuple(one(o.headline(empty))) == (0, 0, 0, 0, 0)
    assert tuple(one(o.totals(empty))) == (0, 0, 0)
    assert rows(o.daily_series(empty, AS_OF)) == []
    assert one(o.series_summary(o.daily_series(empty, AS_OF))).state == "no data"


def test_top_lists(hits):
    assert rows(o.top_pages(hits, WEEK)) == [("/", 2), ("/late", 1), ("/x", 1)]
    assert rows(o.top_referrers(hits, WEEK)) == [("direct", 2), ("seeds.example", 1)]
    assert rows(o.top_countries(hits, WEEK)) == [("??", 2), ("PT", 1)]
    assert rows(o.top_countries(hits, None)) == [("??", 2), ("PT", 2)]
    assert rows(i.top_paths(hits, 2)) == [("/", 3), ("/late", 1)]


def test_daily_series_fills_days_and_starts_at_midnight(hits):
    series = rows(o.daily_series(hits, AS_OF, WEEK))
    assert [day.isoformat() for day, _ in series] == [f"2026-07-{d}" for d in range(18, 26)]
    assert [n for _, n in series] == [2, 0, 1, 1, 0, 0, 0, 0]


def test_daily_series_of_all_time_starts_at_the_first_human_hit(make_hits):
    hits = make_hits(
        ("k0", "m", "/", "2026-07-20T09:00:00Z", 1, 1),
        {"session": "e", "path": "CTA", "created_at": "2026-07-23T09:00:00Z", "is_event": 1},
        ("k2", "p", "/", "2026-07-24T09:00:00Z", 1, 0),
        ("k3", "p", "/", "2026-07-27T09:00:00Z", 1, 0),
        ("k4", "p", "/", "whenever", 1, 0),
    )
    assert rows(o.daily_series(hits, AS_OF)) == [
        (dt.date(2026, 7, 23), 0),
        (dt.date(2026, 7, 24), 1),
        (dt.date(2026, 7, 25), 0),
    ]


def test_range_without_hits_is_all_zero(make_hits):
    series = o.daily_series(make_hits(), AS_OF, WEEK)
    assert [n for _, n in rows(series)] == [0] * 8
    assert one(o.series_summary(series)).state == "no pageviews"


def series_of(spark, counts):
    start = dt.date(2026, 7, 1)
    data = [(start + dt.timedelta(days=k), n) for k, n in enumerate(counts)]
    return spark.createDataFrame(data, "day date, n long")


def test_levels(spark):
    series = series_of(spark, [10, 0, 5, 0, 8])
    levels = rows(o.daily_levels(series).orderBy("day"), "level")
    assert [level for (level,) in levels] == [7, None, 3, None, 5]
    assert tuple(one(o.series_summary(series))) == (10, 3, 5, True, "ok")


def test_two_days_are_no_trend_fourteen_are(spark):
    assert one(o.series_summary(series_of(spark, [3, 4]))).too_few_days
    assert not one(o.series_summary(series_of(spark, range(1, 15)))).too_few_days


def test_avg_duration_skips_what_cannot_be_measured(make_hits):
    hits = make_hits(
        ("k1", "a", "/", "2026-07-20T09:00:00Z", 1, 0),
        ("k2", "a", "/", "2026-07-20T09:00:30Z", 0, 0),
        ("k3", "b", "/", "2026-07-20T09:00:00Z", 1, 0),
    )
    assert tuple(one(o.avg_duration(hits))) == (30.0, 1, 2)


def test_reached_from_counts_every_view(make_hits):
    hits = make_hits(
        ("k1", "a", "/", "2026-07-20T09:00:00Z", 1, 0),
        ("k2", "a", "/contact", "2026-07-20T09:00:30Z", 0, 0),
        ("k3", "a", "/contact", "2026-07-20T09:00:40Z", 0, 0),
        ("k4", "b", "/contact", "2026-07-20T09:00:00Z", 0, 0),
        ("k5", "c", "/contact", "2026-07-20T09:00:00Z", 1, 1),
        ("k6", "d", "/", "2026-07-20T09:00:00Z", 1, 0),
    )
    assert rows(i.reached_from(hits, "/contact")) == [("seeds.example", 2), ("direct", 1)]


def test_traffic_shares(hits, make_hits):
    odd = make_hits(("k9", "odd", "/", "2026-07-22T09:01:00Z", 1, -1))
    assert tuple(one(i.traffic_shares(hits.unionByName(odd)))) == (7, 4, 2, 1, 2, 0, 1)


def test_hours(make_hits):
    hits = make_hits(
        ("k1", "a", "/", "2026-07-20T03:00:00Z", 1, 0),
        ("k2", "a", "/", "2026-07-20T10:00:30Z", 0, 0),
        ("k3", "a", "/", "2026-07-21T16:59:30Z", 0, 0),
        ("k4", "a", "/", "2026-07-21T17:00:00Z", 0, 0),
        ("k5", "a", "/", "2026-07-21T17:00:00Z", 0, 1),
    )
    hours = i.hour_histogram(hits)
    assert sorted(rows(hours)) == [(3, 1), (10, 1), (16, 1), (17, 1)]
    assert tuple(one(i.day_and_night(hours))) == (1, 2)


def test_deep_entries_and_overlong_visits(make_hits):
    hits = make_hits(
        *[(f"a{k}", "a", f"/{k}", f"2026-07-20T0{k}:00:00Z", int(k == 0), 0) for k in range(3)],
        *[(f"b{k}", "b", f"/{k}", f"2026-07-20T00:0{k}:00Z", 0, 0) for k in range(3)],
        ("c1", "c", "/", "2026-07-20T00:00:00Z", 1, 0),
    )
    assert rows(i.deep_entry_counts(hits)) == [("/0", 1), (None, 1)]
    assert rows(i.overlong_visits(hits)) == [("main", "a", 7200)]


def test_key_checks(make_hits):
    at = "2026-07-20T00:00:00Z"
    hits = make_hits(("k", "a", "/", at, 1, 0), ("k", "b", "/", at, 1, 0), ("", "c", "/", at, 1, 0))
    assert tuple(one(i.key_audit(hits))) == (3, 2, 1, 1)
    both = hits.unionByName(hits.withColumn("site", F.lit("other")))
    assert tuple(one(i.key_audit(both))) == (6, 4, 2, 2)
    assert rows(i.key_drift(hits, hits)) == []
    assert rows(i.key_drift(hits, hits.where("session != 'b'"))) == [("k", 2, 1)]


def test_report_agrees_with_its_parts(spark):
    hits = events.load_hits(spark, SF)
    as_of, since = "2024-01-31T00:00:00Z", "2024-01-24T00:00:00Z"
    lines = rows(overview_report(hits, as_of, since).orderBy("section", "position"), "section", "label", "n")
    sections = {}
    for section, label, n in lines:
        sections.setdefault(section, []).append((label, n))
    assert sections["pages"] == rows(o.top_pages(hits, since))
    assert sections["referrers"] == rows(o.top_referrers(hits, since))
    assert sections["countries"] == rows(o.top_countries(hits, since))
    assert dict(sections["headline"]) == one(o.headline(hits, since)).asDict()
    assert sections["daily"] == [(str(day), n) for day, n in rows(o.daily_series(hits, as_of, since))]


def test_report_of_nothing(make_hits):
    lines = rows(overview_report(make_hits(), AS_OF), "section", "label", "n")
    assert sorted(lines) == sorted(
        ("headline", name, 0) for name in ("visitors", "pageviews", "events", "bots", "single_page")
    )


def test_daily_sum_is_the_pageviews_from_midnight_to_as_of(spark):
    hits = events.load_hits(spark, SF)
    series = o.daily_series(hits, "2024-01-20T00:00:00Z", "2024-01-10T15:00:00Z")
    counted = hits.where(
        "bot = 0 and is_event = 0 and created_at >= '2024-01-10T00:00:00Z' and created_at < '2024-01-21'"
    ).count()
    assert one(series.agg(F.sum("n").alias("n"))).n == counted
