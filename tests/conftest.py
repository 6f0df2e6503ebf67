from __future__ import annotations

import hashlib
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from footfall.functions import times  # noqa: E402
from footfall.schema import HITS  # noqa: E402
from footfall.session import build_session  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# What a hit has unless a test says otherwise.
DEFAULTS = {
    "title": "",
    "is_event": 0,
    "browser": "Heron 3.1",
    "system": "Maple",
    "bot": 0,
    "referrer": "seeds.example",
    "referrer_scheme": "h",
    "screen_size": "800,600,1",
    "country": "PT",
    "first_visit": 0,
    "site": "main",
}


@pytest.fixture
def make_hits(spark):
    """Hits from (key, session, path, created_at, first_visit, bot) or dicts."""

    def build(*rows):
        names = ("hit_key", "session", "path", "created_at", "first_visit", "bot")
        full = []
        for row in rows:
            values = row if isinstance(row, dict) else dict(zip(names, row))
            values = {**DEFAULTS, **values}
            digest = hashlib.sha256(repr(sorted(values.items())).encode()).hexdigest()
            values.setdefault("hit_key", digest[:16])
            values.setdefault("row_digest", f"digest of {values['hit_key']}")
            full.append(tuple(values.get(name) for name in HITS.fieldNames()))
        frame = spark.createDataFrame(full, HITS)
        return frame.withColumns(
            {
                "ts": times.to_instant(F.col("created_at")),
                "event_date": times.text_day(F.col("created_at")),
            }
        )

    return build
