from frames import one, rows

from pyspark.sql import Window
from pyspark.sql import functions as F

from footfall.operators import visits as v
from footfall.sources import events

SF = "/root/testdata/sf0.01"


def test_one_hit_cannot_be_timed(make_hits):
    visit = one(v.visits(make_hits({"session": "walker", "path": "/tulips", "created_at": "2025-03-04T05:06:07Z"})))
    assert visit.duration_seconds is None
    assert (visit.page_count, visit.event_count, visit.site) == (1, 0, "main")


def test_a_visit_spans_its_hits_in_any_order(make_hits):
    walk = [("z3", "/exit", 0, 55), ("z1", "/gate", 1, 0), ("z4", "/pond", 0, 20), ("z2", "/gate", 0, 20)]
    visit = one(
        v.visits(make_hits(*[(k, "w", p, f"2025-03-04T23:59:{s:02d}Z", f, 0) for k, p, f, s in walk]))
    )
    assert (visit.page_count, visit.event_count, visit.duration_seconds) == (4, 0, 55)
    assert (visit.first_seen[11:19], visit.last_seen[11:19], visit.entry_path) == ("23:59:00", "23:59:55", "/gate")
    entry = (visit.referrer, visit.referrer_scheme, visit.country, visit.browser, visit.system)
    assert entry == ("seeds.example", "h", "PT", "Heron 3.1", "Maple")


def test_only_flagged_hits_can_be_the_entry(make_hits):
    """The first hit is not flagged, of the flagged ones the earlier counts."""
    hits = [
        {"path": path, "first_visit": flag, "created_at": f"2025-03-04T0{hour}:00:00Z", "session": "w", "country": path[1:]}
        for path, flag, hour in [("/moss", 1, 8), ("/fern", 0, 6), ("/reed", 1, 7)]
    ]
    visit = one(v.visits(make_hits(*hits)))
    assert (visit.entry_path, visit.country, visit.first_seen[11:13]) == ("/reed", "reed", "06")


def test_flagged_hits_of_one_moment_go_by_key(make_hits):
    moment = "2025-03-04T05:06:07Z"
    visit = one(v.visits(make_hits(("f", "w", "/east", moment, 1, 0), ("b", "w", "/west", moment, 1, 0))))
    assert (visit.entry_path, visit.duration_seconds) == ("/west", 0)


def test_without_a_flag_all_entry_fields_are_unknown(make_hits):
    visit = one(v.visits(make_hits(*[(f"u{n}", "w", "/kelp", f"2025-03-04T05:0{n}:00Z", 0, 0) for n in (1, 4)])))
    names = ("entry_path", "referrer", "referrer_scheme", "country", "browser", "system")
    assert {visit[name] for name in names} == {None} and visit.duration_seconds == 180


def test_events_are_observed_but_are_no_pages(make_hits):
    taps = [
        {"session": "w", "path": f"tap {n}", "is_event": 1, "first_visit": int(n == 2), "created_at": f"2025-03-04T05:00:0{n}Z"}
        for n in (2, 3, 9)
    ]
    visit = one(v.visits(make_hits(*taps)))
    assert (visit.page_count, visit.event_count, visit.duration_seconds, visit.entry_path) == (0, 3, 7, "tap 2")


def test_the_highest_class_of_its_hits_is_that_of_a_visit(make_hits):
    classes = {"gardener": [0, 0], "mower": [4], "both": [0, 7, 2], "strange": [-2, -5]}
    hits = [
        {"session": s, "path": f"/{n}", "bot": bot, "created_at": f"2025-03-04T05:00:0{n}Z"}
        for s, bots in classes.items()
        for n, bot in enumerate(bots)
    ]
    found = v.visits(make_hits(*hits))
    assert dict(rows(found, "session", "bot")) == {"gardener": 0, "mower": 4, "both": 7, "strange": -2}
    assert rows(v.human(found), "session") == [("gardener",)]


def test_sessions_of_two_sites_are_two_visits(make_hits):
    """One export synced for two sites: the ids repeat, the visits do not merge."""
    hits = [
        {"session": s, "site": site, "path": p, "created_at": "2025-03-04T05:06:07Z"}
        for site in ("north", "south")
        for s, p in [("w", "/a"), ("w", "/b"), (None, "/c")]
    ]
    found = rows(v.visits(make_hits(*hits)), "site", "session", "page_count")
    assert sorted(found, key=repr) == sorted(
        [(site, s, n) for site in ("north", "south") for s, n in [("w", 2), (None, 1)]], key=repr
    )


def test_text_that_is_no_time_gives_no_duration(make_hits):
    visit = one(v.visits(make_hits(("p", "w", "/", "noon", 1, 0), ("q", "w", "/", "2025-03-04T05:06:07Z", 0, 0))))
    assert (visit.first_seen, visit.last_seen, visit.duration_seconds) == ("2025-03-04T05:06:07Z", "noon", None)


def test_offsets_and_fractions_are_times(make_hits):
    moments = ["2025-03-04T05:06:07.75-03:00", "2025-03-04T05:06:31.5-03:00"]
    visit = one(v.visits(make_hits(*[(m, "w", "/", m, 1, 0) for m in moments])))
    assert visit.duration_seconds == 24


def test_empty_table(make_hits):
    assert rows(v.visits(make_hits())) == []
    assert rows(v.visit_list(make_hits())) == []


def test_only_the_named_entry_fields(make_hits):
    frame = v.visits(make_hits(("k", "w", "/", "2025-03-04T05:06:07Z", 1, 0)), entry=("country",))
    assert "browser" not in frame.columns and one(frame).country == "PT"


def test_visit_list(make_hits):
    hits = make_hits(
        ("e1", "long", "/oak", "2025-03-04T05:06:07Z", 1, 0),
        ("e2", "long", "/elm", "2025-03-04T05:09:27Z", 0, 0),
        ("e3", "late", "/ash", "2025-03-05T00:01:02Z", 0, 0),
        ("e4", "crawl", "/oak", "2025-03-06T00:01:02Z", 1, 9),
    )
    late, long = ("03-05 00:01", None, None, "direct", 1, "-", "?"), (
        "03-04 05:06", "PT", "Heron 3.1", "seeds.example", 2, "200s", "/oak",
    )
    assert rows(v.visit_list(hits)) == [late, long]
    assert rows(v.visit_list(hits, limit=1)) == [late]


def test_newest_visits_in_two_steps_equal_one(spark, make_hits):
    """Ties at the cut, a visit without an id and one on another site."""
    hits = [
        {"session": s, "site": site, "path": f"/{n}", "first_visit": n % 2, "bot": int(s == "t3"), "created_at": at}
        for n, at in enumerate(["2025-03-04T05:06:07Z", "2025-03-04T05:06:07Z", "2025-03-05T00:00:00Z"])
        for s in ("t1", "t2", "t3", None)
        for site in ("north", "south")
    ]
    frame = make_hits(*hits)
    whole = rows(v.newest(v.human(v.visits(frame, entry=("entry_path",))), None))
    for limit in (1, 2, 3, 5, 50):
        assert rows(v.newest_visits(frame, limit, ("entry_path",))) == whole[:limit]
    assert rows(v.newest_visits(frame, None, ("entry_path",))) == whole
    assert len(rows(v.newest_visits(frame, 50, ("entry_path",), include_bots=True))) == 8


def window_form(hits):
    """The definition: a ranked entry hit joined to the totals."""
    order = Window.partitionBy("site", "session").orderBy(F.desc("first_visit"), "created_at", "hit_key")
    entry = hits.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    flagged = F.col("first_visit") == 1
    names = {"entry_path": "path", "referrer": "referrer", "country": "country", "system": "system"}
    entry = entry.select("site", "session", *[F.when(flagged, F.col(c)).alias(n) for n, c in names.items()])
    totals = hits.groupBy("site", "session").agg(F.count("*").alias("n"), F.max("bot").alias("bot"))
    return totals.join(entry, ["site", "session"]).select("site", "session", "bot", *names)


def test_equals_the_window_form(spark):
    hits = events.load_hits(spark, SF)
    expected = window_form(hits)
    ours = v.visits(hits).select(*expected.columns)
    assert ours.exceptAll(expected).count() == 0 and expected.exceptAll(ours).count() == 0


def test_every_hit_is_a_page_or_an_event_of_one_visit(spark):
    hits = events.load_hits(spark, SF)
    total = one(v.visits(hits).agg(F.sum(F.col("page_count") + F.col("event_count")).alias("n")))
    assert total.n == hits.count()
