from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm import neighbours

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        # Names that the operator uses on the way.
        T.StructField("v", T.StringType()),
        T.StructField("ids", T.LongType()),
        T.StructField("table", T.StringType()),
        T.StructField("query", T.StringType()),
    ]
)


def nearest(frame, **options):
    return neighbours.nearest(frame, F.col("id") % 100 == 0, **options)


@pytest.fixture
def make_vectors(spark):
    def build(rows):
        return spark.createDataFrame([(i, v, "x", 1, "t", None) for i, v in rows], VECTORS)

    return build


def brute(rows, k=10):
    """(query, rank, id, distance) by comparing everything."""
    good = [
        (i, np.array(v, dtype=np.float32).astype(float))
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    result = []
    for query in sorted({i for i, _ in good if i % 100 == 0}):
        best: dict[int, float] = {}
        for own in [v for i, v in good if i == query]:
            for i, v in good:
                if i != query and len(v) == len(own):
                    d = float(np.sqrt(((v - own) ** 2).sum()))
                    best[i] = min(best.get(i, math.inf), d)
        order = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
        result += [(query, rank, i, d) for rank, (i, d) in enumerate(order, 1)]
    return result


def ours(frame):
    assert frame.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in frame.collect())


def cloud(count, dims, seed=1, groups=20):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((groups, dims))
    points = centres[draw.integers(0, groups, count)] + 0.2 * draw.standard_normal((count, dims))
    return [(k, [float(np.float32(x)) for x in p]) for k, p in enumerate(points)]


def test_recall_and_exact_distances(make_vectors):
    rows = cloud(6000, 16)
    index = neighbours.fit(np.array([v for _, v in rows[:2000]]), len(rows) * 30)
    assert index.functions > 2
    got = ours(nearest(make_vectors(rows), index=index))
    want = brute(rows)
    assert len(got) == len(want)
    true = {(q, i) for q, _, i, _ in want}
    assert len(true & {(q, i) for q, _, i, _ in got}) / len(true) > 0.9
    known = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(d == np.sqrt(((known[q] - known[i]) ** 2).sum()) for q, _, i, d in got)
    assert not any(q == i for q, _, i, _ in got)


def test_copies_ties_and_odd_rows(make_vectors):
    # A third of all rows are one vector; ids repeat, with equal and with other vectors.
    rows = [(k, [1.0, 2.0, 2.0]) for k in range(300)]
    rows += [(k, [float(k % 7), 1.0, 0.5]) for k in range(300, 420)]
    rows += [(5, [1.0, 2.0, 2.0]), (100, [9.0, 9.0, 9.0]), (310, [1.0, 2.0, 2.25])]
    rows += [(500, None), (501, []), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 1.0]), (800, [math.nan, 1.0, 1.0])]
    rows += [(900, [math.inf, 0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1000, [1.0, 2.0])]
    got = ours(nearest(make_vectors(rows)))
    assert got == brute(rows)
    assert not {q for q, *_ in got} & {500, 600, 700, 800, 900, 1000}


def test_few_candidates_and_empty(make_vectors):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (100, [-1e6, 3.0])]
    assert ours(nearest(make_vectors(rows))) == brute(rows)
    assert ours(nearest(make_vectors([(0, [1.0, 0.0])]))) == []
    assert ours(nearest(make_vectors([]))) == []


def test_any_division_into_blocks_gives_the_same(make_vectors):
    rows = cloud(900, 8, seed=4, groups=3) + [(k, [0.5] * 8) for k in range(900, 1300)]
    index = neighbours.Index(functions=2, width=3.0, reach=0.6, probes=6)
    whole = ours(nearest(make_vectors(rows), index=index))
    parts = ours(nearest(make_vectors(rows), index=index, block=16, query_block=2))
    assert whole == parts


def test_a_query_that_finds_too_few_meets_everything(make_vectors):
    rows = cloud(400, 4, seed=9)
    # Cells so narrow that nothing shares one.
    index = neighbours.Index(functions=4, width=1e-4, reach=1e-4, probes=1)
    assert ours(nearest(make_vectors(rows), index=index, block=50)) == brute(rows)


def test_cells_are_probed_by_falling_chance():
    draw = np.random.default_rng(0)
    index = neighbours.Index(functions=3, width=1.5, reach=1.0, probes=40)
    query = draw.standard_normal((1, 6))
    probed = index.probed(query, 0)[0]
    assert len(set(probed.tolist())) == 40 and probed[0] == index.cells(query, 0)[0]
    # Neighbours at the typical distance fall into earlier cells more often.
    step = draw.standard_normal((20000, 6))
    step /= np.linalg.norm(step, axis=1)[:, None]
    cells = index.cells(query + step, 0)
    counts = [int((cells == p).sum()) for p in probed]
    assert counts[0] == max(counts) and sum(counts[:10]) > sum(counts[10:20]) > sum(counts[30:])


def test_large_numbers_and_doubles(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [-3e200, 1e200])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ours(nearest(frame))
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2)]
    assert [d for *_, d in got] == pytest.approx([2e200, 4e200])


def test_no_group_of_copies_is_shuffled_whole(make_vectors):
    plan = neighbours.classes(neighbours.valid(make_vectors([(1, [1.0])])), 11)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
