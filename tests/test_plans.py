"""The shape of physical plans: what makes the queries hold at scale."""

import re

import pytest

from footfall.operators import insights, journeys, overview, search, visits
from footfall.plans import queries as q
from footfall.sources import events
from footfall.sources.store import Store

SF = "/root/testdata/sf0.001"
SINCE = "2024-01-24T00:00:00Z"


@pytest.fixture(scope="module")
def hits(spark, tmp_path_factory):
    """Hits as they are stored: Parquet by day."""
    store = Store(str(tmp_path_factory.mktemp("store")))
    store.insert(events.load_hits(spark, SF))
    return store.hits(spark)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def count(word, frame):
    return len(re.findall(rf"\b{word}\b", plan_of(frame)))


def read_columns(frame):
    [columns] = set(re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of(frame)))
    return {column.split("#")[0] for column in columns.split(",")} - {"event_date"}


def test_visits_take_one_scan_and_one_shuffle(hits):
    frame = visits.visits(hits)
    assert (count("FileScan", frame), count("Exchange", frame)) == (1, 1)
    assert "Join" not in plan_of(frame) and "Window" not in plan_of(frame)


def test_search_inside_visits_adds_no_scan_and_no_join(hits):
    frame = search.search_visits(hits, "p/3", limit=500)
    assert (count("FileScan", frame), count("Exchange", frame)) == (1, 1)
    assert "TakeOrderedAndProject" in plan_of(frame) and "Join" not in plan_of(frame)


def test_reached_from_joins_nothing(hits):
    frame = insights.reached_from(hits, "/p/3")
    assert count("FileScan", frame) == 1 and "Join" not in plan_of(frame)


@pytest.mark.parametrize(
    "build",
    [
        overview.totals,
        overview.headline,
        insights.traffic_shares,
        insights.key_audit,
        insights.hour_histogram,
        lambda hits: overview.daily_series(hits, "2024-01-31T00:00:00Z"),
    ],
)
def test_counting_uses_hash_aggregation(hits, build):
    plan = plan_of(build(hits))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert count("FileScan", build(hits)) == 1


def test_bots_are_not_filtered_below_the_visit_grouping(hits):
    """Dropping bot hits first would turn mixed sessions into human visits."""
    frame = visits.human(visits.visits(hits))
    assert "PushedFilters: []" in plan_of(frame)


def test_only_needed_columns_are_read(hits):
    assert read_columns(overview.top_pages(hits, SINCE)) == {"path", "is_event", "bot", "created_at"}
    assert read_columns(overview.totals(hits)) == {"site", "session", "bot"}
    assert read_columns(overview.top_countries(hits)) == {
        "hit_key", "site", "session", "bot", "country", "first_visit", "created_at",
    }
    assert read_columns(visits.visits(hits, entry=())) == {"site", "session", "is_event", "bot", "created_at"}


def test_a_cutoff_prunes_days_and_reaches_the_scan(hits):
    plan = plan_of(overview.top_pages(hits, SINCE))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date[^\]]* >= 2024-01-24", plan)
    assert "GreaterThanOrEqual(created_at" in plan


@pytest.mark.parametrize("build", [overview.headline, overview.top_referrers, overview.top_countries])
def test_recent_ranges_read_details_of_recent_days_only(hits, build):
    """The week is read with its details; of the days before, ids and times alone."""
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PartitionFilters: \[([^\]]*)\]", plan_of(build(hits, SINCE)))
    assert len(scans) >= 2
    for columns, filters in scans:
        names = {column.split("#")[0] for column in columns.split(",")}
        if ">= 2024-01-24" in filters:
            assert "bot" in names
        else:
            assert names <= {"site", "session", "created_at", "event_date"} and "<= 2024-01-24" in filters


def test_a_site_is_a_pushed_filter(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    store.insert(events.load_hits(spark, SF))
    plan = plan_of(visits.visits(store.hits(spark, "site-1")))
    assert "EqualTo(site,site-1)" in plan


def test_newest_visits_first_look_at_little(hits):
    plan = plan_of(visits.visit_list(hits))
    first = [c for c in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "country" not in c]
    assert first and {c.split("#")[0] for c in first[0].split(",")} <= {"site", "session", "bot", "created_at", "event_date"}
    assert "BroadcastHashJoin" in plan


def test_top_lists_never_sort_everything(hits):
    for frame in (
        overview.top_pages(hits),
        overview.top_referrers(hits),
        overview.top_countries(hits),
        visits.visit_list(hits),
        insights.overlong_visits(hits),
    ):
        assert "TakeOrderedAndProject" in plan_of(frame)


def test_no_window_over_the_steps_of_a_visit(hits):
    """Steps are numbered by their place; the window sees one row per piece of a visit."""
    frame = journeys.journeys(hits)
    plan = plan_of(frame)
    above, _, below = plan.partition("Window [")
    assert "Window" not in above and "HashAggregate" in below and plan.count("Window [") == 1
    assert "rangepartitioning" not in plan  # the sorted steps are written already


def test_site_rollup_reads_hits_once(spark):
    frame = q.QUERIES["site_rollup"](spark, SF)
    # Hits, the sync log and the list of sites.
    assert count("FileScan", frame) == 3 and "CartesianProduct" not in plan_of(frame)


def test_nothing_collects_groups_or_runs_python(spark):
    for name in ("visits", "journeys_in_pieces", "overview_report", "site_rollup", "adhoc_sql", "visit_labels"):
        plan = plan_of(q.QUERIES[name](spark, SF))
        for word in ("Python", "collect_list", "collect_set", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan, (name, word)


