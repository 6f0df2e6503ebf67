import pytest
from frames import one, rows

from footfall.operators import search as s


@pytest.fixture
def hits(make_hits):
    """Four visits of a museum: two see the whale, one of them only on the way, a third
    does not, and a machine does."""
    return make_hits(
        ("m9", "family", "/map", "2025-05-01T09:10:00Z", 1, 0),
        ("m2", "family", "/hall/whale", "2025-05-01T09:20:00Z", 0, 0),
        ("m3", "family", "/hall/whale/bones", "2025-05-01T09:30:00Z", 0, 0),
        ("m4", "painter", "/hall/whale", "2025-05-01T08:00:00Z", 1, 0),
        ("m5", "school", "/cafe", "2025-05-01T11:00:00Z", 1, 0),
        ("m6", "indexer", "/hall/whale", "2025-05-01T12:00:00Z", 1, 5),
    )


def found(frame):
    return rows(frame, "session", "match_reason")


def test_on_the_row_and_on_the_way(hits):
    assert found(s.search_visits(hits, "whale")) == [("family", "/hall/whale"), ("painter", "")]
    assert found(s.search_visits(hits, "bones")) == [("family", "/hall/whale/bones")]


def test_bots_on_request(hits):
    everyone = found(s.search_visits(hits, "whale", include_bots=True))
    assert everyone == [("indexer", ""), ("family", "/hall/whale"), ("painter", "")]


@pytest.mark.parametrize("query", ["%", "_", "\\", "wh%le", "w_ale"])
def test_wildcards_are_text(hits, query):
    assert found(s.search_visits(hits, query)) == []


def test_wildcard_text_is_found(make_hits):
    hits = make_hits(("m1", "sale", "/5%_less\\now", "2025-05-01T09:10:00Z", 1, 0))
    for query in ("%", "_", "\\", "5%_L"):
        assert found(s.search_visits(hits, query)) == [("sale", "")]


def test_an_empty_query_lists_the_newest(hits):
    assert found(s.search_visits(hits, "")) == [("school", ""), ("family", ""), ("painter", "")]
    assert found(s.recent_visits(hits, include_bots=True, limit=2)) == [("indexer", ""), ("school", "")]


@pytest.mark.parametrize("query", ["HERON", "Seeds", "pt"])
def test_any_case_over_the_row_fields(hits, query):
    matches = found(s.search_visits(hits, query))
    assert len(matches) == 3 and {reason for _, reason in matches} == {""}


def test_case_folding_beyond_ascii(make_hits):
    hits = make_hits(("m1", "a", "/ÑANDÚ", "2025-05-01T09:10:00Z", 1, 0))
    assert found(s.search_visits(hits, "ñandú")) == [("a", "")]


def test_the_reason_is_the_earliest_step_and_may_be_an_event(make_hits):
    tap = {"hit_key": "m8", "session": "a", "path": "play organ", "is_event": 1, "created_at": "2025-05-01T09:11:00Z"}
    hits = make_hits(
        ("m1", "a", "/organ/pipes", "2025-05-01T09:12:00Z", 0, 0),
        tap,
        ("m3", "a", "/", "2025-05-01T09:10:00Z", 1, 0),
    )
    assert found(s.search_visits(hits, "organ")) == [("a", "play organ")]


def test_unknown_entry_does_not_match_but_its_steps_do(make_hits):
    hits = make_hits(("m1", "a", "/attic", "2025-05-01T09:10:00Z", 0, 0))
    assert found(s.search_visits(hits, "attic")) == [("a", "/attic")]
    assert found(s.search_visits(hits, "heron")) == []


def test_steps_of_another_site_are_not_searched(make_hits):
    shared = {"session": "a", "created_at": "2025-05-01T09:10:00Z"}
    hits = make_hits({**shared, "site": "north", "path": "/whale"}, {**shared, "site": "south", "path": "/bat"})
    assert rows(s.search_visits(hits, "bat"), "site", "match_reason") == [("south", "/bat")]


def test_limit_keeps_the_newest(hits):
    assert found(s.search_visits(hits, "whale", limit=1)) == [("family", "/hall/whale")]


def test_reasons(hits):
    reasons = dict(rows(s.match_reasons(hits, "whale", include_bots=True)))
    assert reasons == {"": 2, "/hall/whale": 1}


def test_hidden_matches(make_hits):
    at = "2025-05-01T09:10:00Z"
    hits = make_hits(
        ("m1", "guest", "/", at, 1, 0),
        ("m2", "feed1", "/sitemap.xml", at, 1, 3),
        ("m3", "feed2", "/sitemap.xml", at, 0, 1),
    )
    assert tuple(one(s.hidden_matches(hits, "sitemap"))) == (0, 2)
    assert tuple(one(s.hidden_matches(hits, "sitemap", limit=1))) == (0, 1)
    assert tuple(one(s.hidden_matches(hits, "nowhere"))) == (0, 0)
    assert tuple(one(s.hidden_matches(hits, "heron"))) == (1, 0)
    assert tuple(one(s.hidden_matches(hits.where("bot > 0"), ""))) == (0, 2)
