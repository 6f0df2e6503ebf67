import datetime as dt
import random
import re

import pytest
from frames import one, rows

from pyspark.sql import functions as F

from footfall.operators.sites import sync_state
from footfall.sources.exports import ExportError, read_export
from footfall.sources.store import Store, _on_days, first_wins

FIRST = "2026-07-25T10:00:00Z"
SECOND = "2026-07-25T11:00:00Z"


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "store"))


@pytest.fixture
def two_hits(make_hits):
    return make_hits(("k1", "a", "/", FIRST, 1, 0), ("k2", "a", "/x", SECOND, 0, 0))


def test_storing_again_adds_nothing(spark, store, two_hits):
    first, second = store.insert(two_hits), store.insert(two_hits)
    assert (first.fetched, first.new, first.status) == (2, 2, "synced")
    assert (second.fetched, second.new, second.status) == (2, 0, "already stored")
    assert store.hits(spark).count() == 2


def test_nothing_fetched(spark, store, make_hits):
    result = store.insert(make_hits())
    assert (result.fetched, result.new, result.status) == (0, 0, "nothing new")
    assert store.hits(spark).count() == 0


def test_stored_rows_equal_the_given_rows(spark, store, two_hits):
    store.insert(two_hits)
    assert store.hits(spark).exceptAll(two_hits).count() == 0
    assert store.hits(spark).schema == store.hits(spark).select(*two_hits.columns).schema


def test_copies_inside_a_batch_and_overlap_with_stored(spark, store, make_hits, two_hits):
    store.insert(two_hits)
    more = make_hits(
        ("k2", "a", "/x", SECOND, 0, 0),
        ("k3", "b", "/", SECOND, 1, 0),
        ("k3", "b", "/", SECOND, 1, 0),
        ("k4", "c", "/", "2026-08-02T10:00:00Z", 1, 0),
    )
    assert store.insert(more).new == 2
    assert sorted(rows(store.hits(spark), "hit_key")) == [("k1",), ("k2",), ("k3",), ("k4",)]


def test_hits_without_a_day_are_compared_too(spark, store, make_hits):
    odd = make_hits(("k1", "a", "/", "soon", 1, 0), ("k2", "a", "/", "", 1, 0))
    assert [store.insert(odd).new, store.insert(odd).new] == [2, 0]
    mixed = odd.unionByName(make_hits(("k3", "a", "/", FIRST, 1, 0)))
    assert [store.insert(mixed).new, store.insert(mixed).new] == [1, 0]
    assert store.hits(spark).where("event_date is null").count() == 2


def test_the_same_key_on_two_sites_is_two_hits(spark, store, two_hits):
    store.insert(two_hits)
    assert store.insert(two_hits.withColumn("site", F.lit("other"))).new == 2


def test_a_replace_that_fails_leaves_no_cursor(spark, store, two_hits, monkeypatch):
    store.insert(two_hits)
    store.record(spark, "main", FIRST, 2, 7)
    monkeypatch.setattr("footfall.sources.store._write_hits", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.replace(spark, two_hits)
    assert store.next_cursor(spark, "main") is None


def test_replace_starts_over(spark, store, make_hits, two_hits):
    store.insert(two_hits)
    store.record(spark, "main", FIRST, 2, 7)
    store.replace(spark, make_hits(("k9", "z", "/", SECOND, 1, 0), ("k9", "z", "/", SECOND, 1, 0)))
    assert rows(store.hits(spark), "hit_key") == [("k9",)]
    assert store.sync_log(spark).count() == 0


def test_only_the_days_of_the_batch_are_read(spark, store, make_hits):
    store.insert(make_hits(*[(f"k{d}", "a", "/", f"2026-07-{d}T10:00:00Z", 1, 0) for d in range(10, 20)]))
    days = [dt.date(2026, 7, 10), dt.date(2026, 7, 19)]
    for wanted, files in ((days, 2), ([*days, None], 2), ([None], 0)):
        compared = _on_days(store.hits(spark), wanted)
        plan = compared._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan)
        touched = compared.select("_metadata.file_path").distinct().count()
        assert touched == files


def test_rows_that_share_a_short_key_are_both_kept(spark, store, make_hits):
    one = {"hit_key": "0123456789abcdef", "session": "a", "path": "/x", "created_at": FIRST}
    hits = make_hits({**one, "row_digest": "0123456789abcdef" + "0" * 48}, {**one, "path": "/y", "row_digest": "0123456789abcdef" + "1" * 48})
    assert [store.insert(hits).new, store.insert(hits).new] == [2, 0]
    more = make_hits({**one, "path": "/z", "row_digest": "0123456789abcdef" + "2" * 48})
    assert store.insert(more).new == 1
    assert sorted(rows(store.hits(spark), "path")) == [("/x",), ("/y",), ("/z",)]


def test_copies_are_ranked_before_they_are_shuffled(spark, two_hits):
    plan = first_wins(two_hits, two_hits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "Join" not in plan
    assert re.search(r"WindowGroupLimit.*Final.*Exchange hash.*WindowGroupLimit.*Partial", plan, re.DOTALL)


def odd_batch(make_hits):
    """Equal digests with other columns, rows that repeat, unknown sites and days."""
    draw = random.Random(8)
    rows = []
    for number in range(60):
        rows.append({
            "hit_key": f"k{number % 15}", "row_digest": f"d{number % 15}", "session": draw.choice("ab"),
            "path": draw.choice(["/", "/x"]), "title": draw.choice(["", "t", None]), "site": draw.choice([None, "main", "other"]),
            "created_at": draw.choice([FIRST, "soon", None]),
        })
    return rows, make_hits(*rows)


def test_any_batching_stores_the_same_hits(spark, tmp_path, make_hits):
    rows_, whole = odd_batch(make_hits)
    identity = ["event_date", "site", "row_digest"]
    wanted = sorted(rows(whole.select(*identity).distinct()), key=repr)
    for number, size in enumerate((60, 23, 7)):
        store = Store(f"{tmp_path}/{number}")
        done = [store.insert(make_hits(*rows_[k : k + size])) for k in range(0, 60, size)]
        assert sum(r.new for r in done) == len(wanted) and sum(r.fetched for r in done) == 60
        assert sorted(rows(store.hits(spark), *identity), key=repr) == wanted
        assert store.insert(whole).new == 0


def test_what_is_stored_wins_and_else_the_least(spark, store, make_hits):
    hit = {"hit_key": "k", "row_digest": "d", "session": "a", "created_at": FIRST}
    assert store.insert(make_hits({**hit, "path": "/c"}, {**hit, "path": "/b"})).new == 1
    assert store.insert(make_hits({**hit, "path": "/a"})).new == 0
    assert rows(store.hits(spark), "path") == [("/b",)]


def test_files_with_swapped_columns_and_equal_cells(spark, store, tmp_path):
    for name, header in (("1", "2Path,Title,Session,Date"), ("2", "2Title,Path,Session,Date")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n/a,b,s,{FIRST}\n")
    one_call = store.insert(read_export(spark, [f"{tmp_path}/1.csv", f"{tmp_path}/2.csv"], "main"))
    other = Store(str(tmp_path / "other"))
    two_calls = [other.insert(read_export(spark, f"{tmp_path}/{name}.csv", "main")).new for name in "12"]
    assert (one_call.new, two_calls) == (1, [1, 0])


def test_a_day_with_most_of_the_data_is_split_over_files(spark, store):
    """Rebalancing cuts the hot day although hashing by day would not."""
    hits = spark.range(0, 60000, 1, 8).select(
        F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("hit_key"),
        F.sha2(F.col("id").cast("string"), 256).alias("row_digest"),
        F.concat(F.lit("s"), F.col("id") % 500).alias("session"),
        F.sha2(F.concat(F.lit("p"), F.col("id")), 256).alias("path"),
        F.lit("").alias("title"),
        F.lit(0).alias("is_event"),
        *[F.lit("").alias(c) for c in ("browser", "system")],
        F.lit(0).cast("long").alias("bot"),
        *[F.lit("").alias(c) for c in ("referrer", "referrer_scheme", "screen_size", "country")],
        F.lit(1).alias("first_visit"),
        F.when(F.col("id") % 20 == 0, "2026-07-24T10:00:00Z").otherwise(FIRST).alias("created_at"),
        F.lit("main").alias("site"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.when(F.col("id") % 20 == 0, "2026-07-24").otherwise("2026-07-25").cast("date").alias("event_date"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        assert store.insert(hits).new == 60000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = store.hits(spark).groupBy("event_date").agg(F.count_distinct("_metadata.file_name").alias("n"))
    by_day = {str(day): n for day, n in rows(files)}
    assert by_day["2026-07-25"] > 1


def test_cursor_and_rows_add_up(spark, store):
    assert store.sync_log(spark).count() == 0
    store.record(spark, "main", FIRST, 3, 1657794647)
    store.record(spark, "main", SECOND, 5, 1657794700)
    state = one(sync_state(store.sync_log(spark)))
    assert (state.last_hit_id, state.last_synced_at, state.synced_rows, state.cursor) == (
        1657794700,
        SECOND,
        8,
        1657794700,
    )


def test_a_long_log_is_few_files(spark, store, monkeypatch):
    monkeypatch.setattr("footfall.sources.store.LOG_FILES", 4)
    for number in range(12):
        store.record(spark, "main", FIRST, 1, number, origin=f"stream#{number}")
        store.record(spark, "main", FIRST, 1, number, origin=f"stream#{number // 2}")
    assert len(store.sync_log(spark).inputFiles()) <= 5
    assert store.sync_log(spark).count() == 12
    assert rows(sync_state(store.sync_log(spark)), "last_hit_id", "synced_rows") == [(11, 12)]
    # A fold that fails before the old files go leaves every call twice, and counts it once.
    monkeypatch.setattr("footfall.sources.store.LOG_FILES", 100)
    store.sync_log(spark).write.mode("append").parquet(store.log_path)
    store.record(spark, "main", FIRST, 1, 3, origin="stream#7")
    assert store.sync_log(spark).count() == 12


def test_cursor_never_goes_back(spark, store):
    seen = []
    for cursor in (1657819971, 0, 1, 1657819970, None, 1657900000):
        store.record(spark, "main", FIRST, 0, cursor)
        seen.append(one(sync_state(store.sync_log(spark))).last_hit_id)
    assert seen == [1657819971] * 5 + [1657900000]


def test_time_is_that_of_the_latest_call(spark, store):
    store.record(spark, "main", SECOND, 0, 5)
    store.record(spark, "main", FIRST, 0, 5)
    assert one(sync_state(store.sync_log(spark))).last_synced_at == FIRST


def test_without_a_cursor_the_next_sync_starts_over(spark, store):
    store.record(spark, "main", FIRST, 10)
    state = one(sync_state(store.sync_log(spark)))
    assert (state.last_hit_id, state.cursor) == (0, None)


def test_sync_reads_stores_and_records(spark, store, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(f"2Path,Session,Date\n/,s,{FIRST}\n/x,s,{SECOND}\n")
    results = [store.sync(spark, str(path), "main", at, 9) for at in (FIRST, SECOND)]
    assert [(r.status, r.fetched, r.new) for r in results] == [("synced", 2, 2), ("already stored", 2, 0)]
    state = one(sync_state(store.sync_log(spark)))
    assert (state.synced_rows, state.last_synced_at, state.cursor) == (2, SECOND, 9)


def test_a_refused_export_changes_nothing(spark, store, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(f"3Path,Session,Date\n/,s,{FIRST}\n")
    with pytest.raises(ExportError):
        store.sync(spark, str(path), "main", FIRST)
    assert store.hits(spark).count() == 0 and store.sync_log(spark).count() == 0
