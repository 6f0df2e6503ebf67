from __future__ import annotations

import pytest

from footfall.llm import queries
from footfall.llm import url_filter as u

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@pytest.fixture
def no_record(spark):
    return spark.createDataFrame([], "host string, low double")


def judged(spark, urls, reputation):
    pages = spark.createDataFrame([(i, x, "noise") for i, x in enumerate(urls)], "page_id long, url string, verdict string")
    return [tuple(r) for r in u.judge_urls(pages, reputation, RULES).orderBy("page_id").collect()]


def test_parts_and_rules(spark, no_record):
    got = judged(
        spark,
        [
            "HTTP://Shop.Example.NET/en/x?y#z",
            "http://example.net",
            "http://badexample.net/en/",
            "https://a.example.com/de/1",
            "https://b.org/fr/",
            "no scheme at all/de/",
            None,
            "x://h?http://example.com/de/",
            "http://ÄB.org/FR/\n1",
        ],
        no_record,
    )
    assert got == [
        (0, "shop.example.net", "/en/x", "example.net/en/", "allow"),
        (1, "example.net", "", None, "allow"),
        (2, "badexample.net", "/en/", "net/", "block"),
        (3, "a.example.com", "/de/1", "example.com/de/", "block"),
        (4, "b.org", "/fr/", "org/fr/", "allow"),
        (5, "", "", None, "allow"),
        (6, "", "", None, "allow"),
        (7, "h", "", None, "allow"),
        (8, "Äb.org", "/FR/\n1", None, "allow"),
    ]


def test_bad_host_is_blocked_and_small_one_is_shrunk(spark):
    seen = [("bad.example.org", 0)] * 60 + [("bad.example.org", 1)] * 5
    seen += [("good.example.com", 1)] * 300 + [("new.example.com", 0)] + [(None, 0), ("good.example.com", None)]
    outcomes = spark.createDataFrame(seen, "host string, good int")
    found = {r.host: r for r in u.host_reputation(outcomes).collect()}
    assert (found["bad.example.org"].n, found["bad.example.org"].good) == (65, 5)
    assert found["good.example.com"].n == 300
    assert found["bad.example.org"].low < 0.3 < 0.8 < found["good.example.com"].low
    # One bad page is not held against a host whose domain is good.
    assert found["new.example.com"].mean > 0.5
    reputation = u.host_reputation(outcomes)
    got = judged(spark, ["http://bad.example.org/x", "http://good.example.com/", "http://bad.example.org/fr/"], reputation)
    assert [g[-1] for g in got] == ["block", "allow", "allow"]


def test_no_labels(spark):
    outcomes = spark.createDataFrame([], "host string, good int")
    assert u.host_reputation(outcomes).count() == 0
    assert judged(spark, [], u.host_reputation(outcomes)) == []


def test_only_functions(spark):
    outcomes = spark.createDataFrame([("a.b", 1)], "host string, good int")
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    plan = u.judge_urls(pages, u.host_reputation(outcomes), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_levels_of_hosts(spark):
    hosts = spark.createDataFrame([("a.b.c",), ("c",), ("",)], "host string")
    got = [tuple(r) for r in u.with_levels(hosts).select("host", "domain", "suffix").collect()]
    assert got == [("a.b.c", "b.c", "c"), ("c", "c", "c"), ("", "", "")]


def test_hosts_without_labels_get_their_prior(spark, tmp_path):
    pages, labels = [], []

    def page(host, good=None):
        pages.append((len(pages), f"http://{host}/"))
        if good is not None:
            labels.append((len(pages) - 1, good, 0))

    for k in range(40):
        for good in [0] * 19 + [1]:
            page(f"h{k}.bad.aa", good)
        for good in [1] * 20:
            page(f"h{k}.good.bb", good)
    page("one.bad.aa", 1)
    unlabelled = {
        "new.bad.aa": "block",
        "bad.aa": "block",
        "other.aa": "block",
        "new.good.bb": "allow",
        "other.bb": "allow",
        "else.where": "block",
    }
    for host in unlabelled:
        page(host)
    pages.append((len(pages), None))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op1_url_reputation(spark, str(tmp_path)).collect()
    assert len(rows) == len(pages)
    found = {r.host: r.verdict for r in rows}
    assert {host: found[host] for host in unlabelled} == unlabelled
    assert (found["one.bad.aa"], found["h0.bad.aa"], found["h0.good.bb"], found[""]) == ("block", "block", "allow", "block")


def test_a_good_label_never_lowers_the_bound(spark):
    seen = [(f"h{k}.a.b", int(k % 4 > 0)) for k in range(40) for _ in range(5)] + [("one.a.b", 1)]
    outcomes = spark.createDataFrame(seen, "host string, good int")
    hosts = spark.createDataFrame([("one.a.b",), ("new.a.b",), ("new.a.b",), (None,)], "host string")
    found = {r.host: r for r in u.host_reputation(outcomes, hosts=hosts).collect()}
    assert len(found) == 42 and (found["new.a.b"].n, found["new.a.b"].good) == (0, 0)
    assert found["new.a.b"].low < found["one.a.b"].low


def level_of(host, depth):
    return tuple([host.split(".")[-1], ".".join(host.split(".")[-2:]), host][:depth])


def pages(units, of, depth, without=None):
    """(n, good) of everything (depth 0), a suffix, a domain or a host, less some unit's."""
    chosen = [(n, g) for h, n, g in units if level_of(h, depth) == level_of(of, depth) and h not in (without or ())]
    return sum(n for n, _ in chosen), sum(g for _, g in chosen)


def chain(units, host, depth, strengths, own=True):
    """mean and variance of the unit that a host belongs to, by the rules."""
    mine = [h for h, _, _ in units if level_of(h, depth) == level_of(host, depth)]
    n, g = pages(units, host, 0, mine)
    mean = (g + 1) / (n + 2)
    variance = mean * (1 - mean) / (n + 3)
    for k in range(1, depth + own):
        n, g = pages(units, host, k, None if k == depth else mine)
        room = mean * (1 - mean)
        size = max(room / (variance + room / (strengths[k - 1] + 1)) - 1, u.LEAST_SIZE)
        mean = (g + size * mean) / (n + size)
        variance = mean * (1 - mean) / (n + size + 1)
    return mean, variance


def spread(units, depth, strengths):
    """The strength of a level, by moments."""
    extra = room = 0.0
    for name in {level_of(h, depth) for h, _, _ in units}:
        host = next(h for h, _, _ in units if level_of(h, depth) == name)
        n, g = pages(units, host, depth)
        if n > 1:
            p, _ = chain(units, host, depth, strengths, own=False)
            extra += (g - n * p) ** 2 - n * p * (1 - p)
            room += n * p * (1 - p) * (n - 1)
    return max(u.WEAKEST, min(u.STRONGEST, room / max(extra, 1e-9) - 1)) if room else u.STRONGEST


@pytest.mark.parametrize("copies", [1, 7])
def test_against_brute_force(spark, copies):
    units = [("a.x.org", 1, 1), ("b.x.org", 2, 0), ("c.y.org", 1, 1), ("d.z.com", 5, 4), ("z.com", 1, 1), ("lone", 3, 0)]
    units = [(h, n * copies, g * copies) for h, n, g in units]
    seen = [(h, int(k < g)) for h, n, g in units for k in range(n)]
    outcomes = spark.createDataFrame(seen, "host string, good int")
    hosts = spark.createDataFrame([("new.x.org",), ("other.net",), ("e.com",), ("lone",)], "host string")
    found = {r.host: r for r in u.host_reputation(outcomes, hosts=hosts).collect()}
    assert set(found) == {h for h, _, _ in units} | {"new.x.org", "other.net", "e.com"}
    strengths = []
    for depth in (1, 2, 3):
        strengths.append(spread(units, depth, strengths))
    for host, row in found.items():
        mean, variance = chain(units, host, 3, strengths)
        assert (row.mean, row.low) == pytest.approx((mean, mean - 1.645 * variance**0.5))
    # A handful of pages in all cannot vouch for a host.
    assert copies > 1 or all(row.low < 0.6 for row in found.values())


def test_more_pages_narrow_the_bounds(spark):
    def low(copies):
        seen = [(f"h{k}.d{k % 3}.org", 1) for k in range(6) for _ in range(copies)]
        outcomes = spark.createDataFrame(seen, "host string, good int")
        hosts = spark.createDataFrame([("new.org",)], "host string")
        return {r.host: r.low for r in u.host_reputation(outcomes, hosts=hosts).collect()}

    few, many = low(1), low(200)
    assert few["new.org"] < many["new.org"] and few["h0.d0.org"] < many["h0.d0.org"] > 0.9


def test_repeated_labels_count_a_page_once(spark, tmp_path):
    pages = [(k, f"http://h{k % 5}.a.org/") for k in range(50)]
    labels = [(k, int(k % 5 > 0), 0) for k in range(50)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/one/pages.parquet")
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/two/pages.parquet")
    schema = "doc_id long, quality int, toxic int"
    spark.createDataFrame(labels, schema).write.parquet(f"{tmp_path}/one/labels.parquet")
    spark.createDataFrame(labels + labels[:30] * 9 + [(1, 0, 0), (1, None, 1)], schema).write.parquet(f"{tmp_path}/two/labels.parquet")
    one, two = [{r.page_id: r.verdict for r in queries.op1_url_reputation(spark, f"{tmp_path}/{n}").collect()} for n in ("one", "two")]
    assert one == two
