"""Every registered query against its SQL on the smallest tables."""

import pytest
from frames import ROOT

from __spark_entry__ import entry, oracle_sql, queries
from footfall.plans.oracles import ORACLES
from footfall.plans.queries import QUERIES
from scripts.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, connection, name):
    assert compare(spark, connection, FOLDER, name) == []


def test_every_query_has_sql_and_the_other_way_round():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert 0 < entry(spark).count() <= 25


def test_no_python_in_any_plan(spark):
    """Library code holds no UDF, runs Python for the lines of exports only, and collects no
    group into an array."""
    for file in (ROOT / "footfall").rglob("*.py"):
        if "llm" in file.relative_to(ROOT).parts:
            continue  # operators on texts have rules of their own
        text = file.read_text()
        # Lines are put together to records, and headers read, over Arrow batches.
        allowed = {"exports.py": 1, "records.py": 3}.get(file.name, 0)
        assert text.count("mapInArrow") == allowed, file
        text = text.replace("mapInArrow", "")
        for word in ("udf", "applyInPandas", "mapInPandas", ".rdd", "collect_list", "collect_set",
                     "crossJoin", "localCheckpoint", "toPandas"):
            assert word not in text, (file, word)
