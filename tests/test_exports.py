import gzip
import hashlib
import random

import pytest
from frames import rows

from footfall.sources import records
from footfall.sources.exports import ExportError, ExportVersionError, read_export
from footfall.sources.store import Store

# The format names its columns so; order and content are the test's own.
NAMES = [
    "Date", "Path", "Session", "FirstVisit", "Bot", "Event", "Title", "Referrer", "Referrer scheme",
    "Location", "Browser", "System", "Screen size", "UserAgent",
]
HEADER = "2" + ",".join(NAMES)
RECORDS = [
    ["2025-02-01T08:00:00Z", "/harbour", "gull", "1", "0", "0", "Harbour", "tides.example", "h", "PT", "Otter 9", "Pine 4", "800,600,2", "x"],
    ["2025-02-01T08:05:30Z", "ring bell", "gull", "0", "0", "1", "", "", "o", "PT", "Otter 9", "Pine 4", "800,600,2", ""],
    ["2025-02-02T23:59:59Z", "/pier", "crab", "1", "12", "true", 'The "old" pier,\nrebuilt', "", "o", "", "", "", "", '"quoted"'],
]
WHEN = "2025-02-01T08:00:00Z"


def line(cells):
    return ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in cells)


def key_of(*cells):
    return hashlib.sha256("".join(cell + "\0" for cell in cells).encode()).hexdigest()[:16]


@pytest.fixture
def write(tmp_path):
    def save(text, name="export.csv"):
        path = tmp_path / name
        data = text.encode()
        path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
        return str(path)

    return save


@pytest.fixture
def export(write):
    return write("\n".join([HEADER, *map(line, RECORDS)]) + "\n")


def test_typed_columns(spark, export):
    by_path = {hit.path: hit for hit in read_export(spark, export, "coast").collect()}
    harbour, bell, pier = by_path["/harbour"], by_path["ring bell"], by_path["/pier"]
    assert (harbour.screen_size, harbour.country, harbour.referrer, harbour.site) == ("800,600,2", "PT", "tides.example", "coast")
    assert [(h.is_event, h.bot, h.first_visit) for h in (harbour, bell, pier)] == [(0, 0, 1), (1, 0, 0), (1, 12, 1)]
    assert (pier.title, pier.browser) == ('The "old" pier,\nrebuilt', "")
    assert (str(bell.ts), str(pier.event_date)) == ("2025-02-01 08:05:30", "2025-02-02")


def test_keys_are_stable_distinct_and_cover_every_cell(spark, export):
    first = dict(rows(read_export(spark, export), "path", "hit_key"))
    assert first == dict(rows(read_export(spark, export), "path", "hit_key"))
    assert first == {cells[1]: key_of(*cells) for cells in RECORDS}
    for key, digest in rows(read_export(spark, export), "hit_key", "row_digest"):
        assert len(digest) == 64 and digest.startswith(key)


@pytest.mark.parametrize("number", ["1", "3", "22"])
def test_other_versions_are_refused(spark, write, number):
    with pytest.raises(ExportVersionError) as error:
        read_export(spark, write(f"{number}Date,Path,Session\n{WHEN},/,s\n"))
    assert (error.value.got, error.value.want) == (int(number), 2)


@pytest.mark.parametrize("header", ["Date,Path,Session", "2Date,Path", "2", "2path,session,date", '"Date",2Path,Session'])
def test_bad_headers_are_refused(spark, write, header):
    with pytest.raises(ExportError):
        read_export(spark, write(header + "\n/,x\n"))


def test_one_bad_file_refuses_all(spark, export, write):
    with pytest.raises(ExportVersionError):
        read_export(spark, [export, write("8" + HEADER[1:] + "\n", "bad.csv")])


def test_files_without_records(spark, export, write):
    nothing = write("", "nothing.csv")
    assert read_export(spark, nothing).collect() == []
    assert read_export(spark, [nothing, export]).count() == 3
    assert read_export(spark, write(HEADER + "\n", "header.csv")).collect() == []


def test_columns_are_found_by_name(spark, write):
    [hit] = read_export(spark, write(f"2Bot,Session,Date,Location,Path\n6,heron,{WHEN},KE,/reeds\n")).collect()
    assert (hit.path, hit.session, hit.bot, hit.country, hit.created_at) == ("/reeds", "heron", 6, "KE", WHEN)
    assert (hit.title, hit.browser, hit.first_visit) == ("", "", 0)
    assert hit.hit_key == key_of("6", "heron", WHEN, "KE", "/reeds")


def test_a_header_cell_may_hold_a_line_break(spark, write):
    path = write(f'"2Path","Two\nlines",Session,Date\n/a,x,s,{WHEN}\n')
    assert rows(read_export(spark, path), "path", "session", "hit_key") == [("/a", "s", key_of("/a", "x", "s", WHEN))]


def test_many_files_of_different_headers(spark, write, tmp_path):
    """Forty files, three headers, gzip and odd names: one path for any number."""
    expected = []
    for number in range(40):
        cells = {"Date": WHEN, "Path": f"/{number}", "Session": f"s{number % 3}", "Title": f"t{number}"}
        names = [["Date", "Path", "Session"], ["Session", "Title", "Path", "Date"], ["Path", "Date", "Session", "Other"]][number % 3]
        name = f"re ordered%20+[{number}].csv" + (".gz" if number % 5 == 0 else "")
        write("2" + ",".join(names) + "\n" + ",".join(cells.get(n, "x") for n in names) + "\n", name)
        expected.append((f"/{number}", f"s{number % 3}", f"t{number}" if number % 3 == 1 else "", key_of(*[cells.get(n, "x") for n in names])))
    write("", "empty.csv")
    assert sorted(rows(read_export(spark, str(tmp_path)), "path", "session", "title", "hit_key")) == sorted(expected)


def test_finding_headers_reads_only_the_beginning_of_files(spark, write):
    """Behind the first records a file may even be broken."""
    long = write("2Path,Session,Date\n" + f"/a,s,{WHEN}\n" * 200_000 + '/b,"s')
    [(_, header)] = rows(records.first_records(spark, [long]))
    assert header == "2Path,Session,Date"


def test_flags_and_numbers(spark, write):
    cells = [
        ("1", "7", "1"), ("TrUe", "+31", "TRUE"), ("false", "-4", "0"), ("2", "3 ", ""), ("", "seven", "01"),
        ("", "123456789012345678901", "1"), ("", "-123456789012345678901", "1"), ("", "0.5", "1"),
    ]
    body = "".join(f"/{n},s,{WHEN},{e},{b},{f}\n" for n, (e, b, f) in enumerate(cells))
    path = write("2Path,Session,Date,Event,Bot,FirstVisit\n" + body)
    assert rows(read_export(spark, path).orderBy("path"), "is_event", "bot", "first_visit") == [
        (1, 7, 1), (1, 31, 0), (0, -4, 0), (0, 0, 0), (0, 0, 0),
        (0, 2**63 - 1, 1), (0, -(2**63), 1), (0, 0, 1),
    ]


def test_records_shorter_or_longer_than_the_header(spark, write):
    cells = [
        ["/even", "s", WHEN, "t"], ["/blank", "s", WHEN, ""], ["/blank", "s", WHEN], ["/only"],
        ["/more", "s", WHEN, "t", 'and "so"', "5"], ["/more", "s", WHEN, "t", ""], ["/more", "s", WHEN, "t", "", ""],
        *[["/empty", "s", WHEN, "t", *[""] * n] for n in range(1, 12)], ["/odd", "\ue000", WHEN, "\ue000"],
    ]
    path = write("\n".join(["2Path,Session,Date,Title", *map(line, cells)]) + "\n")
    found = rows(read_export(spark, path), "path", "session", "created_at", "title", "hit_key")
    padded = [(*(r + [""] * 4)[:4], key_of(*r)) for r in cells]
    assert sorted(found) == sorted(padded)


@pytest.mark.parametrize("options", [{}, {"key_mode": "canonical"}, {"header": "2Path,Session,Date"}])
@pytest.mark.parametrize(
    "broken",
    [f'/b,"s,{WHEN}', f'/b,s,"{WHEN}', f'/b"b,s,{WHEN}', f'/b,"s"s,{WHEN}', f'"/b,s,{WHEN}'],
    ids=["open in the middle", "open at the end", "inside a cell", "after a cell", "open at the start"],
)
def test_misplaced_quotes_refuse_the_load(spark, write, tmp_path, broken, options):
    good = [f"/{n},s,{WHEN}" for n in range(5)]
    path = write("\n".join(["2Path,Session,Date", good[0], broken, *good[1:]]) + "\n")
    with pytest.raises(Exception, match="quote in export record"):
        read_export(spark, path, **options).select("path").collect()
    store = Store(str(tmp_path / "store"))
    with pytest.raises(Exception, match="quote in export record"):
        store.sync(spark, path, "main", WHEN, **options)
    assert store.hits(spark).count() == 0 and store.sync_log(spark).count() == 0


def test_windows_line_ends(spark, write):
    path = write(f'2Path,Session,Date,Title\r\n/,s,{WHEN},"up\r\ndown"\r\n')
    [hit] = read_export(spark, path).collect()
    assert (hit.title, hit.hit_key) == ("up\ndown", key_of("/", "s", WHEN, "up\ndown"))


def test_canonical_keys_survive_reordering(spark, write):
    one = write(f"2Path,Session,Date\n/,s,{WHEN}\n", "one.csv")
    two = write(f"2UserAgent,Date,Path,Session\nagent,{WHEN},/,s\n", "two.csv")
    assert len(set(rows(read_export(spark, [one, two]), "hit_key"))) == 2
    assert len(set(rows(read_export(spark, [one, two], key_mode="canonical"), "row_digest"))) == 1


def test_a_given_header_is_enforced(spark, export, write):
    given = rows(read_export(spark, export, header=HEADER))
    assert sorted(map(repr, given)) == sorted(map(repr, rows(read_export(spark, export))))
    with pytest.raises(ExportVersionError):
        read_export(spark, export, header="4Path,Session,Date")
    with pytest.raises(ExportError):
        read_export(spark, [export, write(f"2Date,Session,Path\n{WHEN},s2,/other\n", "other.csv")], header=HEADER)
    twice = "2Path,Title,Session,Date,Title"
    path = write(f"{twice}\n/,first,s,{WHEN},last\n", "twice.csv")
    assert rows(read_export(spark, path, header=twice), "title") == [("last",)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def tangled(count, seed):
    """Records whose cells hold line breaks, quotes and whole lines that look like records;
    some are longer than several splits."""
    draw = random.Random(seed)
    found = []
    for number in range(count):
        cell = "".join(draw.choice(["a", "\n", '"', ",", "\n/x,s,t\n", "é", "\n\n", " "]) for _ in range(draw.randrange(12)))
        if draw.random() < 0.03:
            cell = "long\n" * draw.randrange(400, 1200)
        found.append([f"/{number}", "s", WHEN, cell, draw.choice(["", "plain", '"', "end\n"])])
    return found


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_with_line_breaks_in_cells_are_split(spark, write, tmp_path, small_splits, end):
    expected = []
    for number, count in enumerate((300, 1, 150)):
        cells = tangled(count, number)
        names = ["2Path", "Session", "Date", "Title", "Other"]
        text = "\n".join([",".join(names), *map(line, cells)]) + ("\n" if number else "")
        write(text.replace("\n", end), f"{number}.csv")
        expected += [(c[0], c[3], key_of(*c)) for c in cells]
    write("\n\n2Path,Session,Date\n\n" + f"/gz,s,{WHEN}\n\n", "packed.csv.gz")
    expected.append(("/gz", "", key_of("/gz", "s", WHEN)))
    hits = read_export(spark, str(tmp_path))
    assert sorted(rows(hits, "path", "title", "hit_key")) == sorted(expected)
    every = records.lines(spark, [str(tmp_path)])
    assert every.rdd.getNumPartitions() > 20
    assert any(records._splits_inside(every, [str(tmp_path)]).values())


def test_an_unclosed_quote_in_a_split_file_refuses_the_load(spark, write, small_splits):
    body = "".join(f"/{n},s,{WHEN}\n" for n in range(300))
    for broken in (body + '/x,"s', '/x,"s\n' + body, body + '"a"b\n' + body):
        with pytest.raises(Exception, match="quote in export record"):
            read_export(spark, write("2Path,Session,Date\n" + broken)).select("path").collect()


def test_splits_that_were_not_counted_are_a_fault(spark, write, small_splits):
    path = write("2Path,Session,Date\n" + f"/a,s,{WHEN}\n" * 300)
    with pytest.raises(Exception, match="KeyError"):
        records._assembled(records.lines(spark, [path]), {}).collect()


def test_headers_of_files_that_share_a_task(spark, write, tmp_path):
    """Settings may pack files together; no header is lost."""
    for number in range(12):
        write(f"2Path,Session,Date,N{number}\n/{number},s,{WHEN},x\n", f"{number}.csv")
    spark.conf.set("spark.sql.files.maxPartitionNum", "1")
    try:
        assert sorted(rows(read_export(spark, str(tmp_path)), "path")) == sorted((f"/{n}",) for n in range(12))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionNum")


def test_any_number_of_headers_takes_one_scan(spark, write, tmp_path):
    for number in range(130):
        write(f"2Path,N{number},Session,Date\n/{number},x,s,{WHEN}\n", f"{number}.csv")
    hits = read_export(spark, str(tmp_path))
    assert hits.count() == 130 and hits.select("session").distinct().count() == 1
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and plan.count("MapInArrow") == 1


def test_a_plain_export_is_split(spark, write, small_splits):
    body = "".join(f"/{n},s,{WHEN}\n" for n in range(2000))
    hits = read_export(spark, write("2Path,Session,Date\n" + body))
    assert hits.rdd.getNumPartitions() > 4
    assert sorted(rows(hits, "path")) == sorted((f"/{n}",) for n in range(2000))
