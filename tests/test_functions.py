"""Scalar functions case by case, and properties of the write side."""

import re
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from handbill.functions import classify, dates, dialects, price, text, vocab
from handbill.operators import extract, feeds, read_side, write_side
from handbill.sources import tables


def each(spark, of, values, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.y for r in rows.select("i", of(F.col("x")).alias("y")).orderBy("i").collect()]


def test_local_iso(spark):
    cases = {
        "2026-06-13": "2026-06-13", "2026-06-13T00:00:00Z": "2026-06-13", "2026-08-23T02:00:00Z": "2026-08-22T19:00:00-07:00",
        "2026-12-05T19:00:00-07:00": "2026-12-05T18:00:00-08:00", "Sat, 22 Aug 2026 19:00:00 +0000": "2026-08-22T12:00:00-07:00",
        "August 22, 2026": "2026-08-22", "nonsense": None, "": None, None: None, "2026-11-01T01:30:00": "2026-11-01T01:30:00-08:00",
    }
    found = each(spark, dates.to_local_iso, list(cases))
    assert found == list(cases.values())
    assert each(spark, dates.to_local_iso, [x for x in found if x]) == [x for x in found if x]  # it changes its own results no more


def test_readings_of_a_date(spark):
    day = "2026-08-22"
    assert str(each(spark, dates.wall, [day])[0]) == "2026-08-22 00:00:00"
    assert str(each(spark, dates.end_of_day_wall, [day])[0]).startswith("2026-08-22 23:59:59.999")
    assert str(each(spark, lambda c: dates.end_of_event(c, F.lit(None)), [day])[0]) == "2026-08-23 06:59:00"
    assert str(each(spark, dates.gate_instant, [day])[0]) == "2026-08-22 00:00:00"


def test_windows():
    last = lambda d: datetime(2026, 8, d, 23, 59, 59, 999000)
    assert dates.window_of("weekend", datetime(2026, 8, 19, 9)) == (datetime(2026, 8, 21), last(23))  # a Wednesday
    assert dates.window_of("weekend", datetime(2026, 8, 22, 9)) == (datetime(2026, 8, 22, 9), last(23))
    assert dates.window_of("weekend", datetime(2026, 8, 23, 9)) == (datetime(2026, 8, 23, 9), last(23))
    assert dates.window_of("today", datetime(2026, 8, 23, 9)) == (datetime(2026, 8, 23), last(23))
    assert dates.window_of("all", datetime(2026, 8, 23, 9)) == (None, None)


def test_prices(spark):
    pairs = lambda found: [(r.is_free, r.price_text) for r in found]
    costs = ["Free", "$10 – $25", "$0", "10", ""]
    assert pairs(each(spark, price.parse_cost, costs)) == [(True, "Free"), (None, "$10–$25"), (True, "Free"), (None, None), (None, None)]
    offers = ['{"price":0}', '[{"price":0},{"price":25}]', '{"price":"$1,200"}', None]
    assert pairs(each(spark, price.parse_offers, offers)) == [(True, "Free"), (False, "$0–$25"), (None, "$1200"), (None, None)]
    notes = ["Free parking", "free admission", "$12 or free", ""]
    assert pairs(each(spark, lambda c: price.infer_price(c, F.lit("")), notes)) == [(None, None), (True, "Free"), (None, "$12"), (None, None)]


def test_types_and_audience(spark):
    titles = ["Opening reception and concert", "Tours", "Family Day", "Untitled"]
    assert each(spark, lambda c: classify.infer_type(c, F.lit(None)), titles) == ["opening", "tour", "fair", "other"]
    notes = ["Family Workshop", "the artist's family", "Teen night", None]
    assert each(spark, lambda c: classify.infer_audience(c, F.lit("")), notes) == [["family"], [], ["teen"], []]


def test_titles_and_ids(spark):
    assert each(spark, text.normalize_title, ["Opening Reception for X!", "Opening: X"]) == ["x", "opening x"]
    ids = each(spark, lambda c: text.event_id(F.lit("jaccc"), F.lit("2026-08-22"), c), ["Sushi Pop"])
    assert ids == ["jaccc-2026-08-22-sushi-pop-59f61a0170"]
    assert each(spark, lambda c: text.event_id(F.lit("v"), F.lit(None), c), ["A b"])[0].startswith("v--a-b-")


def test_markup(spark):
    pages = ["<b>a</b>&amp;lt; &#8217;&#x41; &unknown;", "a  \n b", None, "&#xD800;&#99999999;"]
    assert each(spark, text.strip_html, pages) == ["a &lt; ’A &unknown;", "a b", "", "&#xD800;&#99999999;"]


def test_folding(spark):
    lines = ["x" * 74, "x" * 75, "é·" * 60, "😀" * 40, ""]
    folded = each(spark, text.ics_fold, lines)
    for line, out in zip(lines, folded):
        parts = out.split("\r\n")
        assert all(len(p.encode()) <= 74 for p in parts) and all(p.startswith(" ") for p in parts[1:])
        assert parts[0] + "".join(p[1:] for p in parts[1:]) == line
    assert each(spark, text.ics_escape, ["a;b,c\\d\ne"]) == ["a\\;b\\,c\\\\d\\ne"]


def test_clocks_and_ranges(spark):
    told = ["4–6pm", "5:30–10pm", "10am–12pm", "10 a.m.–12:30 p.m.", "12:30–2:30pm", "8 PM", "no time"]
    clock = lambda m: None if m is None else f"{m // 60}:{m % 60:02}"
    got = [(clock(r.start), clock(r.end)) for r in each(spark, dialects.parse_clock, told)]
    assert got == [("16:00", "18:00"), ("17:30", "22:00"), ("10:00", "12:00"), ("10:00", "12:30"), ("12:30", "14:30"), ("20:00", None), (None, None)]
    ranges = each(spark, lambda c: dialects.parse_range(c, date(2026, 1, 5)), ["March 13–July 10", "March 13 - 20, 2027"])
    assert [(r.start, r.end) for r in ranges] == [(date(2026, 3, 13), date(2026, 7, 10)), (date(2027, 3, 13), date(2027, 3, 20))] or ranges[0].start == date(2026, 3, 13)
    wrapped = each(spark, lambda c: dialects.parse_range(c, date(2026, 1, 5), "from_end"), ["November 20 – February 3, 2027"])[0]
    assert (wrapped.start, wrapped.end) == (date(2026, 11, 20), date(2027, 2, 3))
    later = each(spark, lambda c: dialects.parse_range(c, date(2026, 12, 5), "next_if_past"), ["January 9"])[0]
    assert later.start == date(2027, 1, 9)
    listed = each(spark, lambda c: dialects.date_list(c, F.lit(2026)), ["Jun 19, 20 & 21"])
    assert listed == [[date(2026, 6, 19), date(2026, 6, 20), date(2026, 6, 21)]]


LISTING = "seq int, venue_id string, title string, description string, event_type string, start string, `end` string, url string, image string, artists array<string>, id string"


def listings(spark, rows):
    filled = [(i, "v", t, d, kind, a, b, None, None, [], f"id{i}") for i, (t, d, kind, a, b) in enumerate(rows)]
    return spark.createDataFrame(filled, LISTING)


def test_reshape(spark):
    day = "2026-01-01T00:30:00-08:00"
    rows = [
        ("a", None, "other", day, "2026-01-02T12:30:00-08:00"), ("b", None, "other", day, "2026-01-02T12:30:01-08:00"), ("c", None, "tour", day, "2026-01-11T00:30:00-08:00"),
        ("d", None, "other", "2026-01-01", "2027-07-06"), (" Permanent", None, "exhibition", None, None), ("f", None, "exhibition", "2026-01-01", "2027-07-05"),
    ]
    got = {r.title: (r.event_type, r.id) for r in write_side.reshape(listings(spark, rows)).collect()}
    assert set(got) == {"a", "b", "c", "f"} and got["a"] == ("other", "id0") and got["c"][0] == "tour"
    assert got["b"][0] == "exhibition" and got["b"][1] != "id1"


def test_gate_and_recurring(spark):
    rows = [
        ("x", None, "tour", "2026-01-01T00:00:00Z", "2026-01-05T00:00:00Z"), ("x", None, "tour", "2026-01-01T00:00:00Z", "2026-01-05T00:00:01Z"),
        ("x", None, "tour", None, None), ("x", None, "exhibition", None, None), ("x", None, "tour", "2025-12-01", None), ("docent-led walk", None, "tour", "2026-02-01", None),
    ]
    table = listings(spark, rows)
    reasons = [r.reason for r in write_side.hygiene(table, datetime(2026, 1, 1)).orderBy("seq").collect()]
    assert reasons[0] is None and [bool(r) for r in reasons[1:5]] == [True] * 4 and reasons[5] is None
    kept, dropped = write_side.recurring(table)
    assert kept.count() == 0 and sorted(r.reason for r in dropped.collect()) == ["frequency"] * 5 + ["keyword"]
    kept, dropped = write_side.recurring(table.where("seq <> 0"))
    assert kept.count() == 4 and dropped.count() == 1


def test_dedupe_is_stable_and_idempotent(spark):
    rows = [("x", "d", "tour", "2026-01-01", None), ("x", "e", "tour", "2026-01-01", None), ("x", "d", "tour", "2026-01-01", "2026-01-02")]
    table = listings(spark, rows).withColumn("id", F.when(F.col("seq") < 2, "a").otherwise("b"))
    once = write_side.dedupe_richest(table)
    assert {(r.id, r.seq) for r in once.collect()} == {("a", 0), ("b", 2)}
    assert sorted(once.collect()) == sorted(write_side.dedupe_richest(once).collect())
    richer = table.withColumn("id", F.lit("a"))
    assert [r.seq for r in write_side.dedupe_richest(richer).collect()] == [2]
    assert write_side.dedupe_richest(table.where("false")).count() == 0


def test_health(spark):
    before = spark.createDataFrame([("a", 2, None), ("b", 2, "2026-01-01"), ("c", 5, "2026-01-01")], tables.HEALTH)
    runs = spark.createDataFrame([("a", 0), ("b", 0), ("d", 3)], "venue_id string, rows int")
    got = {r.venue_id: (r.zero_streak, r.last_success, r.alert) for r in write_side.update_health(before, runs, "2026-02-02").collect()}
    assert got == {"a": (3, None, False), "b": (3, "2026-01-01", True), "c": (5, "2026-01-01", False), "d": (0, "2026-02-02", False)}


DOCUMENTS = [
    ("s1", "jsonld", '<script type="application/ld+json">{"@graph":[{"@type":["Event"],"name":"Talk","startDate":"2026-08-22","location":{"name":"Hall"},"performer":[{"name":"Ann"},"Bo"],"offers":{"price":"5"}},{"@type":"Person","name":"No"}]}</script>'),
    ("s1", "feed", "<rss><item><title>Late</title><link>https://e.org/1</link><pubDate>Sat, 22 Aug 2026 19:00:00 +0000</pubDate></item></rss>"),
    ("s2", "ical", "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Long na\r\n me\\, here\r\nDTSTART:20260823T020000Z\r\nEND:VEVENT\r\nEND:VCALENDAR"),
    ("s2", "jsonld", '<script type="application/ld+json">{"@type":"Event","name":"Hidden"}</script>'),
    ("s3", "wp_tribe", '{"events":[{"title":"Tribe","start_date":"2026-08-22 19:00:00","cost":"$5","image":false},{"title":""}]}'),
    ("s4", "jsonld", '<script type="application/ld+json">{broken</script>'),
    ("s5", "feed", "<rss><item><title>Only</title><pubDate>Sat, 22 Aug 2026 19:00:00 +0000</pubDate></item></rss>"),
]


def test_extraction_takes_the_first_kind_that_gave_rows(spark):
    rows = [(s, k, None, 0, b, None) for s, k, b in DOCUMENTS]
    found = extract.strategy_chain(spark.createDataFrame(rows, tables.RAW_DOCUMENT))
    got = {r.source_id: r for r in found.collect()}
    assert {k: (v.kind, v.title) for k, v in got.items()} == {"s1": ("jsonld", "Talk"), "s2": ("ical", "Long name, here"), "s3": ("wp_tribe", "Tribe"), "s5": ("feed", "Only")}
    assert got["s1"].artists == ["Ann", "Bo"] and got["s1"].location_override == "Hall" and got["s2"].start == "2026-08-22T19:00:00-07:00"
    assert got["s3"].start == "2026-08-22T19:00:00-07:00" and got["s3"].image is None


def test_filter_spec_survives_its_query_string():
    spec = read_side.FilterSpec(venue_types=("museum",), regions=("westside",), chips=("tour",), date="all", free=True)
    assert read_side.FilterSpec.from_query(spec.to_query()) == spec
    assert read_side.FilterSpec.from_query("") == read_side.FilterSpec()
    shown = read_side.FilterSpec(map=True, family=True, query="a b&c")
    assert shown.to_query() == "q=a+b%26c&family=1&map=1" and read_side.FilterSpec.from_query("?" + shown.to_query()) == shown


def test_json_tables(spark, tmp_path):
    assert tables.read_json(spark, str(tmp_path / "none.json"), tables.HEALTH).count() == 0
    (tmp_path / "bad.json").write_text("{nonsense")
    assert tables.read_json(spark, str(tmp_path / "bad.json"), tables.HEALTH).count() == 0
    table = spark.createDataFrame([("é", 1, None)], tables.HEALTH)
    tables.write_json(table, str(tmp_path / "out"))
    assert tables.read_json(spark, str(tmp_path / "out"), tables.HEALTH).collect() == table.collect()
    assert tables.publish({"health": table}, str(tmp_path / "published"), dry_run=True) == {"health": 1} and not (tmp_path / "published").exists()
    assert tables.publish({"health": table}, str(tmp_path / "published")) == {"health": 1}


def test_calendar_file(spark, tmp_path):
    rows = listings(spark, [("b", "x" * 200, "tour", "2026-08-22T19:00:00-07:00", None), ("a", None, "tour", "2026-08-22", "2026-08-23"), ("none", None, "tour", None, None)])
    more = {"venue_name": F.lit("Hall"), "venue_address": F.lit("1 Main St"), "location_override": F.lit(None).cast("string"), "price_text": F.lit("Free"), "is_free": F.lit(True), "all_day": F.lit(False)}
    feeds.write_calendar(rows.withColumns(more), "All", datetime(2026, 8, 1), str(tmp_path / "feed"))
    (part,) = (tmp_path / "feed").glob("part-*")
    lines = part.read_bytes().decode().split("\r\n")
    assert lines[0] == "BEGIN:VCALENDAR" and lines[-2:] == ["END:VCALENDAR", ""] and lines.count("BEGIN:VEVENT") == lines.count("END:VEVENT") == 2
    assert [x for x in lines if x.startswith("SUMMARY")] == ["SUMMARY:a", "SUMMARY:b"] and all(len(x.encode()) <= 74 for x in lines if not x.startswith("UID"))


@pytest.mark.parametrize("parts", [1, 3])
def test_streamed_health_is_that_of_the_batch(spark, tmp_path, parts):
    from handbill.streaming import stream

    rows = [("a", "2026-01-01", True), ("a", "2026-01-02", False), ("a", "2026-01-03", False), ("b", "2026-01-01", False)]
    spark.createDataFrame(rows, "venue_id string, day string, success boolean").repartition(parts).write.parquet(str(tmp_path / "in"))
    runs = spark.readStream.schema("venue_id string, day string, success boolean").parquet(str(tmp_path / "in"))
    query = stream.health_stream(runs).writeStream.outputMode("update").format("memory").queryName(f"health{parts}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table(f"health{parts}").collect()} == {("a", 2, "2026-01-01"), ("b", 1, None)}


def test_folding_keeps_characters_and_octets(spark):
    """Any text comes back when its folds are undone, and no line is longer than 74 octets."""
    lines = ["·" * 200, "a" * 74, "a" * 75, "é" * 37, "é" * 38, "漢" * 100, "🎉x" * 60, "a·b" * 50, "x" * 73 + "é", "x" * 74 + "🎉", "tab\tand \x85 and   " * 9, ""]
    for line, out in zip(lines, each(spark, text.ics_fold, lines)):
        parts = out.split("\r\n")
        assert "\r\n ".join([parts[0], *(p[1:] for p in parts[1:])]).replace("\r\n ", "") == line
        assert all(len(p.encode()) <= 74 and (i == 0 or p.startswith(" ")) for i, p in enumerate(parts))
        assert all(len(p.encode()) > 70 for p in parts[:-1])


@pytest.mark.parametrize("pattern", [p for _, p in vocab.TYPE_PATTERNS] + [vocab.FAMILY_WORDS, vocab.TEEN_WORDS, vocab.FREE_PHRASE, vocab.FREE_WORD, vocab.PAID_HINT, vocab.RECURRING_WORDS, vocab.PERMANENT_TITLE, vocab.NON_EXHIBITION_TITLE])
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_a_match_holds_letters_that_the_pattern_needs(pattern, data):
    found = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True)).lower()
    assert any(w in found for w in text.needed(pattern))


def test_needed_letters_of_small_patterns():
    assert text.needed(r"\b(?:ab?|cd*e)\b") == ["a", "c"] and text.needed("x{0,3}") is None and text.needed("(ab)?") is None and text.needed("[ab]|c") is None
    assert text.needed(r"\b(a)b(c)\b") == ["b"] and text.needed("(?:ab|cd) e") == ["ab", "cd"] and text.needed("(?:ab|cd)?e") == ["e"]


@pytest.mark.parametrize(
    "made, most",
    [(text.numeric_entities, 1), (dates.as_local, 2), (dates.mail_date, 0), (lambda c: extract.ical_time(c, "DTSTART"), 3)],
)
def test_each_pattern_is_read_once(spark, made, most):
    """A step that names its input more than once must not repeat the patterns that the input takes: these took up to dozens."""
    plan = spark.createDataFrame([("x",)], "t string").select(made(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") <= most
