import gzip

import pytest
from frames import one, rows

from footfall.operators.sites import sync_state
from footfall.sources.store import Store
from footfall.streaming.landing import ingest_landing

AT = "2026-07-25T10:00:00Z"


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    return folder


@pytest.fixture
def run(spark, tmp_path, landing):
    store = Store(str(tmp_path / "store"))

    def ingest(**options):
        query = ingest_landing(
            spark, str(landing), store, "main", str(tmp_path / "checkpoint"), clock=lambda: AT, **options
        )
        query.awaitTermination()
        return store

    return ingest


def export(*paths, extra=False):
    header = "2Path,Session,Date" + (",UserAgent" if extra else "")
    tail = ",agent" if extra else ""
    return header + "\n" + "".join(f"{path},s,{AT}{tail}\n" for path in paths)


def test_new_files_only(spark, run, landing):
    (landing / "1.csv").write_text(export("/a", "/b"))
    store = run()
    (landing / "2 [x].csv").write_text(export("/b", "/c"))
    (landing / "3.csv.gz").write_bytes(gzip.compress(export("/d", extra=True).encode()))
    (landing / "4.csv").write_text("")
    run()
    run()
    assert sorted(rows(store.hits(spark), "path")) == [("/a",), ("/b",), ("/c",), ("/d",)]
    log = rows(store.sync_log(spark).orderBy("seq"), "seq", "rows")
    assert log == [(1, 2), (2, 2)]
    state = one(sync_state(store.sync_log(spark)))
    assert (state.synced_rows, state.last_synced_at, state.cursor) == (4, AT, None)


def test_files_per_batch(spark, run, landing):
    for number in range(5):
        (landing / f"{number}.csv").write_text(export(f"/{number}"))
    store = run(files_per_batch=2)
    assert store.hits(spark).count() == 5
    assert store.sync_log(spark).count() == 3


def test_a_batch_repeated_after_a_failure_stores_nothing_twice(spark, run, landing, monkeypatch):
    (landing / "1.csv").write_text(export("/a", "/b"))
    record = Store.record

    def fail(*args, **kwargs):
        raise RuntimeError("lost before the log entry")

    monkeypatch.setattr(Store, "record", fail)
    with pytest.raises(Exception, match="lost before the log entry"):
        run()
    monkeypatch.setattr(Store, "record", record)
    store = run()
    assert store.hits(spark).count() == 2
    assert rows(store.sync_log(spark), "seq", "rows") == [(1, 0)]


def test_calls_are_numbered_together(spark, run, landing, tmp_path):
    """A call, a stream, a call: the last one tells the time, and the cursor stays."""
    (landing / "1.csv").write_text(export("/a"))
    store = Store(str(tmp_path / "store"))
    store.sync(spark, str(landing / "1.csv"), "main", "2026-07-24T10:00:00Z")
    assert store.next_cursor(spark, "main") is None
    run(last_hit_id=lambda names: 40 + len(names))
    state = one(sync_state(store.sync_log(spark)))
    assert (state.last_synced_at, state.cursor, store.next_cursor(spark, "main")) == (AT, 41, 41)
    store.sync(spark, str(landing / "1.csv"), "main", "2026-07-26T10:00:00Z", last_hit_id=7)
    state = one(sync_state(store.sync_log(spark)))
    assert (state.last_synced_at, state.cursor, state.synced_rows) == ("2026-07-26T10:00:00Z", 41, 1)
    assert rows(store.sync_log(spark).orderBy("seq"), "seq") == [(1,), (2,), (3,)]


def test_a_batch_is_noted_once(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    for origin in ("c#0", "c#0", "c#1", None, None):
        store.record(spark, "main", AT, 1, origin=origin)
    store.record(spark, "other", AT, 1, origin="c#0")
    found = rows(store.sync_log(spark).where("site = 'main'").orderBy("seq"), "seq", "origin")
    assert found == [(1, "c#0"), (2, "c#1"), (3, None), (4, None)]


def test_an_empty_folder(spark, run):
    assert run().hits(spark).count() == 0
