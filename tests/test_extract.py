"""Extraction case by case: documents written by hand, with the rows that they must give."""

import hashlib
import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from handbill.functions import dialects, text
from handbill.operators import extract, nested
from handbill.sources.tables import RAW_DOCUMENT, Source, source_table

TRIBE = json.dumps(
    {
        "events": [
            {"title": "Opening Night", "description": "<p>Join us&nbsp;for <b>wine</b> &amp; more</p>", "start_date": "2026-08-22 19:00:00", "end_date": "2026-08-22 21:00:00", "url": "https://t.example/1", "image": {"url": "https://t.example/i.jpg"}, "cost": "$10"},
            {"title": " ", "start_date": "2026-01-01 10:00:00"},
            {"title": "Untitled", "description": "<i>" + "x" * 900 + "</i>", "start_date": "2026-12-05 00:00:00", "end_date": None, "url": None, "image": False, "cost": ""},
        ]
    }
)
ICAL = "\r\n".join(
    [
        "BEGIN:VCALENDAR", "BEGIN:VEVENT", "SUMMARY:Film\\, night", "DTSTART;TZID=America/New_York:20260822T190000", "DTEND;TZID=America/New_York:20260822T210000",
        "DESCRIPTION:one\\ntwo \\\\new <b>b</b>", "LOCATION:Hall\\; 2", "URL:https://c.example/1", "END:VEVENT",
        "BEGIN:VEVENT", "SUMMARY:A long na", " me", "DTSTART;VALUE=DATE:20260901", "DTEND;VALUE=DATE:20260902", "END:VEVENT",
        "BEGIN:VEVENT", "SUMMARY:Artist tour", "DTSTART:20261205T190000Z", "END:VEVENT", "END:VCALENDAR",
    ]
)
JSONLD = (
    """<html><script type="application/ld+json">{"@type":"Event","name":"Artist&#8217;s Talk","description":"<p>With Q&amp;A</p>","startDate":"2026-08-23T02:00:00Z","url":["https://j.example/1","x"],
"image":[{"url":"https://j.example/i.jpg"}],"location":{"name":"Hall"},"performer":[{"name":"Ann"},"Bob"],"offers":{"price":"0"}}</script>"""
    """<script type='application/ld+json'>{"@graph":[{"@type":"Organization","name":"No event"},{"@type":["Thing","schema:ScreeningEvent"],"name":"Untitled","startDate":"2026-12-05"},"""
    """{"@type":"http://schema.org/ExhibitionEvent","name":"Works","startDate":"2026-09-01","endDate":"2026-10-01","location":"Main St"}]}</script><script type="application/ld+json">{broken</script></html>"""
)
FEED = """<rss><channel><item><title><![CDATA[Gallery &#x26; Panel]]></title><link>https://f.example/1</link><pubDate>Sat, 22 Aug 2026 19:00:00 +0000</pubDate><description>&lt;p&gt;Talk&lt;/p&gt;</description></item>
<item><title></title></item></channel></rss>"""
DOCUMENTS = [
    ("t", "wp_tribe", "https://t.example", 0, TRIBE, "2026-08-01"), ("c", "ical", "https://c.example", 0, ICAL, "2026-08-01"), ("j", "jsonld", "https://j.example", 0, JSONLD, "2026-08-01"),
    ("f", "feed", "https://f.example", 0, FEED, "2026-08-01"), ("t", "ical", "https://t.example/ical", 0, ICAL, "2026-08-01"), ("e", "wp_tribe", "https://e.example", 0, "no json", "2026-08-01"),
    ("e", "feed", "https://e.example/rss", 0, FEED, "2026-08-01"),
]
SOURCES = [Source("t", "t.example", default_event_type="screening"), Source("j", "j.example", default_event_type="lecture", id_salt="::exh"), Source("f", "f.example", reshape=False)]


NEXT = """<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"title":"Noir","days":["2026-08-22"]}}}</script>"""
ARRAY = """window.x = {"title": "a ] b", "items" : [{"n": 1, "t": "x]\\"]"}, [2], {}], "more": [3]}; window.y = 1"""
TREE = """{"nodeType":"document","content":[{"nodeType":"paragraph","content":[{"nodeType":"text","value":"Two  films","marks":[{"type":"bold"}]},{"nodeType":"text","value":"and a \\"talk\\""}]}]}"""


REFERENCES = [("&#8217;&#x1F600;", "’😀"), ("&#65;&#xzz;&#;&#1114112;", "A&#xzz;&#;&#1114112;"), ("a &amp;#38; b", "a &#38; b"), ("&#xD800;&#38;lt;", "&#xD800;&lt;"), ("plain", "plain"), (None, "")]


CLOCKS = [
    # text, strict start, strict end, "PT" start, 24 h start, 24 h end
    ("7 pm – 9:30 pm PT", 1140, 1290, 1140, None, None), ("4–6pm", 1080, None, None, None, None), ("doors 19:00 – 21:30", None, None, None, 1140, 1290), ("at 11 a.m.", 660, None, None, None, None), ("no time", None, None, None, None, None),
]


YEARS = [
    # text, as of 2026-11-10: same, more than 300 days back, more than 60 days back, month not past, end's year
    ("January 5", "2026-01-05", "2027-01-05", "2027-01-05", "2027-01-05", "2026-01-05"), ("August 1", "2026-08-01", "2026-08-01", "2027-08-01", "2027-08-01", "2026-08-01"),
    ("October 1", "2026-10-01", "2026-10-01", "2026-10-01", "2027-10-01", "2026-10-01"), ("November 1", "2026-11-01", "2026-11-01", "2026-11-01", "2026-11-01", "2026-11-01"),
    ("December 12 – January 10, 2027", "2026-12-12", "2026-12-12", "2026-12-12", "2026-12-12", "2026-12-12"),
]




@pytest.fixture(scope="module")
def documents(spark):
    return extract.with_settings(spark.createDataFrame(DOCUMENTS, RAW_DOCUMENT), source_table(spark, SOURCES))


def made(venue, day, slug, norm):
    return f"{venue}-{day}-{slug}-" + hashlib.sha1(f"{venue}|{day}|{norm}".encode()).hexdigest()[:10]


def told(rows, source):
    plain = ("id", "title", "description", "event_type", "start", "end", "all_day", "url", "image", "location_override")
    found = rows.where(F.col("source_id") == source).select(*plain, F.array_join("artists", "|").alias("artists"), "source", "reshape")
    return sorted(map(tuple, found.collect()))


def test_tribe(documents):
    assert told(extract.tribe(documents), "t") == [
        (made("t", "2026-08-22", "opening-night", "opening night"), "Opening Night", "Join us for wine & more", "opening", "2026-08-22T19:00:00-07:00", "2026-08-22T21:00:00-07:00", False, "https://t.example/1", "https://t.example/i.jpg", None, "", "t.example", True),
        (made("t", "2026-12-05", "untitled", "untitled"), "Untitled", "x" * 800, "screening", "2026-12-05", None, False, None, None, None, "", "t.example", True),
    ]


def test_ical(documents):
    assert told(extract.ical(documents), "c") == sorted([
        (made("c", "2026-08-22", "film-night", "film night"), "Film, night", "one two \\new b", "screening", "2026-08-22T16:00:00-07:00", "2026-08-22T18:00:00-07:00", False, "https://c.example/1", None, "Hall; 2", "", "c", True),
        (made("c", "2026-09-01", "a-long-name", "a long name"), "A long name", "", "other", "2026-09-01", "2026-09-02", True, None, None, None, "", "c", True),
        (made("c", "2026-12-05", "artist-tour", "artist tour"), "Artist tour", "", "tour", "2026-12-05T11:00:00-08:00", None, False, None, None, None, "", "c", True),
    ])


def test_ical_zones(spark):
    """Every zone of the database is read; a name that isn't one is local time."""
    zones = {"Asia/Kathmandu": "2026-08-22T06:15:00-07:00", "Australia/Lord_Howe": "2026-08-22T01:30:00-07:00", "Etc/GMT+12": "2026-08-23T00:00:00-07:00", "No/Where": "2026-08-22T19:00:00-07:00"}
    body = "".join(f"BEGIN:VEVENT\r\nSUMMARY:{z}\r\nDTSTART;TZID={z}:20260822T190000\r\nEND:VEVENT\r\n" for z in zones)
    rows = extract.ical(spark.createDataFrame([("c", "ical", "", 0, body, "")], RAW_DOCUMENT))
    assert {r.title: r.start for r in rows.collect()} == zones


def test_jsonld(documents):
    assert told(extract.jsonld(documents), "j") == sorted([
        (made("j", "2026-08-22", "artists-talk", "artists talk"), "Artist’s Talk", "With Q&A", "lecture", "2026-08-22T19:00:00-07:00", None, False, "https://j.example/1", "https://j.example/i.jpg", "Hall", "Ann|Bob", "j.example", True),
        (made("j", "2026-12-05", "untitled", "untitled"), "Untitled", "", "lecture", "2026-12-05", None, False, None, None, None, "", "j.example", True),
        (made("j", "2026-09-01", "worksexh", "worksexh"), "Works", "", "exhibition", "2026-09-01", "2026-10-01", False, None, None, "Main St", "", "j.example", True),
    ])


def page(*values):
    return "".join(f'<script type="application/ld+json">{json.dumps(v)}</script>' for v in values)


def test_json_of_any_depth(spark):
    deep = {"@type": "Event", "name": "core"}
    for i in range(150):
        deep = [{"@type": "List", "@graph": deep}, {"@type": "Event", "name": f"level {i}"}]
    body = page(deep, {"@type": "Event", "name": "alone", "subEvent": {"@type": "Event", "name": "not opened"}}, "text", 3, None, [])
    rows = spark.createDataFrame([("a", "jsonld", "u", 0, body, ""), ("b", "jsonld", "u", 0, None, ""), ("c", "jsonld", "u", 0, "<p>", "")], RAW_DOCUMENT)
    found = [json.loads(r.node)["name"] for r in nested.events_of(rows, "source_id").orderBy("seq").collect()]
    assert found == ["core", *(f"level {i}" for i in range(150)), "alone"]
    assert nested.events_of(rows.limit(0), "source_id").count() == 0


def test_profile(spark, tmp_path):
    event = {"name": "Night", "@type": ["Thing", "MusicEvent"], "startDate": "2026-01-01", "offers": {"@type": "Offer"}, "description": "x" * 2000}
    one = page({"@type": "WebSite", "about": [{"potential": {"@type": "SearchAction", "target": event}}]}, {"@type": "Event", "name": "later"})
    rows = [("a", "h", "u", 1, one + '<link rel="x" href="/rss">', ""), ("a", "h", "u", 0, "<script src='/wp-json/x'>", ""), ("b", "h", "u", 0, "BEGIN:VCALENDAR", ""), ("c", "h", "u", 0, None, "")]
    found = {r.source_id: r for r in extract.profile(spark.createDataFrame(rows, RAW_DOCUMENT)).collect()}
    assert found["a"].types == "Event,MusicEvent,Offer,SearchAction,Thing,WebSite" and found["a"].signals == "rss-link,wordpress" and found["a"].documents == 2
    assert found["a"].sample.startswith('{"@type":["Thing","MusicEvent"],"description":"xxx') and len(found["a"].sample) == nested.SAMPLE_CHARS
    assert (found["b"].signals, found["b"].types, found["b"].sample, found["c"].signals) == ("ical-direct", "", None, "")
    paths = {(r.path, r.type): r.n for r in nested.types_by_path(spark.createDataFrame(rows, RAW_DOCUMENT)).collect()}
    assert paths["$.about[].potential.target.offers", "Offer"] == 1 and paths["$", "Event"] == 1
    extract.write_report(extract.profile(spark.createDataFrame(rows, RAW_DOCUMENT)), str(tmp_path / "report"))
    lines = "\n".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert lines.index("## a\n- documents: 2\n") < lines.index("## b\n") < lines.index("## c\n") and "- jsonld @types: (none)" in lines


def test_feed(documents, spark):
    assert told(extract.feed(documents), "f") == [
        (made("f", "2026-08-22", "gallery-panel", "gallery panel"), "Gallery & Panel", "Talk", "lecture", "2026-08-22T12:00:00-07:00", None, False, "https://f.example/1", None, None, "", "f.example", False),
    ]
    broken = "<rss><channel><item><title>Two &nbsp; open</title><br><link>https://x</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">&lt;b&gt;Bold&lt;/b&gt;</title><link rel="enclosure" href="https://no"/><link rel="alternate" href="https://yes"/><published>2026-08-22T19:00:00Z</published></entry></feed>'
    rows = extract.feed(spark.createDataFrame([("a", "feed", "", 0, broken, ""), ("b", "feed", "", 0, atom, ""), ("c", "feed", "", 0, None, "")], RAW_DOCUMENT))
    assert sorted((r.source_id, r.title, r.url, r.start) for r in rows.collect()) == [("a", "Two open", "https://x", None), ("b", "Bold", "https://yes", "2026-08-22T12:00:00-07:00")]


def test_strategies(spark):
    raw = spark.createDataFrame(DOCUMENTS, RAW_DOCUMENT)
    found = extract.outcomes(extract.strategy_chain(raw, sources=source_table(spark, SOURCES)))
    assert sorted(map(tuple, found.collect())) == sorted([("t", "wp_tribe", 2, 0), ("c", "ical", 3, 0), ("j", "jsonld", 2, 1), ("f", "feed", 1, 0), ("e", "feed", 1, 0)])


def test_custom_parsers(spark):
    def words(body, url):
        for w in body.split():
            yield {"title": w, "url": url, "start": "2026-08-22 19:00"}

    def fails(body, url):
        yield {"title": "before"}
        raise RuntimeError(url)

    sources = source_table(spark, [Source("a", "a.example", parser="words", default_event_type="tour"), Source("b", "b", parser="fails"), Source("c", "c", parser="nowhere"), Source("d", "d")])
    rows = [(s, "custom", f"https://{s}", 0, body, "") for s, body in (("a", "one two"), ("a", None), ("b", "x"), ("c", "x"), ("d", "x"))]
    found = extract.custom(extract.with_settings(spark.createDataFrame(rows, RAW_DOCUMENT), sources), {"words": words, "fails": fails})
    assert sorted((r.source_id, r.title, r.event_type, r.start, r.url, r.source) for r in found.collect()) == [("a", w, "tour", "2026-08-22T19:00:00-07:00", "https://a", "a.example") for w in ("one", "two")]


def test_embedded_json(spark):
    rows = spark.createDataFrame([("next", NEXT), ("no next", "<p>"), ("array", ARRAY), ("no array", '{"item": []}'), ("open array", '"items": [1, [2]'), ("rich", TREE)], "what string, body string")
    body = F.col("body")
    found = {r.what: r for r in rows.select("what", extract.next_data(body, "$.props.pageProps.title").alias("next"), extract.json_value_after(body, "items").alias("array"), extract.rich_text(body).alias("rich"), F.array_join(extract.all_strings(body, ("nodeType",)), "|").alias("strings")).collect()}
    assert found["next"].next == "Noir" and found["no next"].next is None
    assert found["array"].array == """[{"n": 1, "t": "x]\\"]"}, [2], {}]""" and found["no array"].array is None and found["open array"].array is None
    assert found["rich"].rich == 'Two films and a "talk"' and found["rich"].strings == 'Two  films|bold|and a "talk"'
    data = '{"nodeType":"embed","data":{"target":{"value":"no text"}},"content":[{"nodeType":"text","value":"a {brace}","data":{},"marks":[]}]}'
    assert spark.range(1).select(extract.rich_text(F.lit(data)).alias("x")).first().x == "a {brace}"


def test_pages_and_links(spark):
    rows = [("a", 0, "1"), ("a", 0, "2"), ("a", 1, "2"), ("a", 1, "3"), ("a", 2, "3"), ("a", 3, "4"), ("b", 0, "1"), ("b", 0, "1"), ("b", 2, "9")]
    found = extract.pages_in_order(spark.createDataFrame(rows, "source_id string, page_no int, id string")).select("source_id", "id", "page_no")
    assert sorted(map(tuple, found.collect())) == [("a", "1", 0), ("a", "2", 0), ("a", "3", 1), ("b", "1", 0)]
    to = lambda u: json.dumps({"links": {"next": {"href": u}}}) if u else "{}"
    rows = [("a", "j", "u0", 0, to("u1"), ""), ("a", "j", "u1", 1, to("u2"), ""), ("a", "j", "u2", 2, to("u0"), ""), ("a", "j", "u9", 3, to(None), ""), ("b", "j", "u0", 0, to("u1"), "")]
    found = extract.linked_pages(spark.createDataFrame(rows, RAW_DOCUMENT)).select("source_id", "url", "step")
    assert sorted(map(tuple, found.collect())) == [("a", "u0", 0), ("a", "u1", 1), ("a", "u2", 2), ("b", "u0", 0)]
    details = spark.createDataFrame([("a", "d", "u1", 0, "old", "2026-01-01"), ("a", "d", "u1", 0, "new", "2026-01-02"), ("a", "d", "u3", 0, "x", "2026-01-02")], RAW_DOCUMENT)
    found = extract.with_details(spark.createDataFrame([("one", "u1"), ("two", "u2")], "title string, url string"), details).select("title", "detail")
    assert sorted(map(tuple, found.collect())) == [("one", "new"), ("two", None)]


def test_numeric_references(spark):
    rows = spark.createDataFrame(REFERENCES, "given string, want string").select("want", text.strip_html(F.col("given")).alias("got"))
    assert all(r.want == r.got for r in rows.collect())


def test_clocks(spark):
    c = F.col("told")
    strict, pt, day = dialects.parse_clock_strict(c), dialects.parse_clock_strict(c, "PT", first_only=True), dialects.parse_clock_24(c)
    rows = spark.createDataFrame([(x[0],) for x in CLOCKS], "told string").select("told", strict["start"], strict["end"], pt["start"], day["start"], day["end"])
    assert sorted(map(tuple, rows.collect())) == sorted(CLOCKS)


def test_year_policies(spark):
    day = date(2026, 11, 10)
    named = [("same", 14), ("next_if_past", 300), ("next_if_past", 60), ("month", 14), ("from_end", 14)]
    rows = spark.createDataFrame([(y[0], p, n, want) for y in YEARS for (p, n), want in zip(named, y[1:])], "told string, policy string, days int, want string")
    by_row = dialects.parse_range(F.col("told"), day, F.col("policy"), F.col("days"))["start"].cast("string")
    assert all(r.want == r.got for r in rows.select("want", by_row.alias("got")).collect())
    for (p, n), column in zip(named, range(1, 6)):
        alone = rows.select("told", dialects.parse_range(F.col("told"), day, p, n)["start"].cast("string").alias("got")).distinct()
        assert {tuple(r) for r in alone.collect()} == {(y[0], y[column]) for y in YEARS}


def test_local_times(spark):
    rows = spark.createDataFrame([("2026-06-13", 1140), ("2026-12-05", 1140), ("2026-12-06", None)], "day string, minute int")
    at, minute = F.col("day").cast("date"), F.col("minute")
    found = rows.select("day", dialects.local_time(at, minute).alias("wall"), dialects.local_time(at, minute, "-07:00").alias("constant"))
    assert sorted(map(tuple, found.collect())) == [("2026-06-13", "2026-06-13T19:00:00-07:00", "2026-06-13T19:00:00-07:00"), ("2026-12-05", "2026-12-05T19:00:00-08:00", "2026-12-05T18:00:00-08:00"), ("2026-12-06", "2026-12-06", "2026-12-06")]


def test_times_required(spark):
    rows = spark.createDataFrame([("v", "Talk", 600), ("v", "No clock", None)], "venue_id string, title string, minute int")
    assert [tuple(r) for r in dialects.time_required(rows, "minute")[1].collect()] == [("v", "No clock", "dropped (no time)")]


def test_nested_json_writes_nothing(spark):
    """However deep a page nests, nothing of it is written on the way; each level was, before."""
    value = {"@type": "Event", "name": "deep"}
    for i in range(40):
        value = {"@type": "WebPage", "@graph": [[value], i], "about": {"@type": "Thing"}}
    rows = spark.createDataFrame([("a", "jsonld", "u", 0, page(value), "")], RAW_DOCUMENT)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = sorted(folder.rglob("*"))
    assert sum(r.n for r in nested.types_by_path(rows).collect()) == 81
    assert [json.loads(r.node)["name"] for r in nested.events_of(rows, "source_id").collect()] == ["deep"]
    assert extract.profile(rows).first().sample.startswith('{"@type":"Event"')
    assert sorted(folder.rglob("*")) == before


def test_an_event_of_any_depth_is_text(spark):
    """A node of a thousand levels ended the session, before."""
    inner = '{"a":' * 999 + "1" + "}" * 999
    scripts = [f'{{"@type":"Event","b":{inner}}}', f'{{"@type":"Event","b":{{"c":{inner}}}}}', '{"@type":"Event","name":"last"}']
    body = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    rows = spark.createDataFrame([("a", "jsonld", "u", 0, body, "")], RAW_DOCUMENT)
    # One level more than DEEPEST is no JSON.
    assert [(r.seq, r.node) for r in nested.events_of(rows, "source_id").collect()] == [(0, scripts[0]), (1, scripts[2])]


@pytest.mark.parametrize("told, node", [
    ('{"@type":"Event","b":10.50,"a":1.0,"c":[-0,-0.0,1e2,12345678901234567890.125]}', '{"@type":"Event","a":1,"b":10.5,"c":[0,0,100.0,"12345678901234567890.125"]}'),
    ('\t{"@type":["x/y:z","http://schema.org/SCREENINGEvent",3,null]} tail', '{"@type":["x/y:z","http://schema.org/SCREENINGEvent",3,null]}'),
    ('{"@type":"Event","n":"\\ud800é\\u00e9\\/<"}', '{"@type":"Event","n":"?éé/<"}'),
    ('{"@type":"Event","a":1e400}', '{"@type":"Event","a":"Infinity"}'), ('{"@type":"Event","@type":"Event"}', None), ('{"@type":"Event","a":NaN}', None), ('{"@type":"Event",}', None), ("[" * 100000, None), ("", None),
])
def test_what_counts_as_json(told, node):
    assert nested.event_texts(nested.objects_in(f"<SCRIPT x type=application/ld+JSON>{told}</Script>", nested.GRAPH)) == ([] if node is None else [node])


def test_a_chain_reads_no_kind_of_a_served_source(spark):
    ld = page({"@type": "Event", "name": "a"}, {"@type": "ExhibitionEvent", "name": "Exhibition"})
    nothing = [(s, k, "", 0, "", "") for s in ("t", "n") for k in ("wp_tribe", "custom", "other")]
    more = [("n", "eventbrite", "", 0, ld, ""), ("n", "feed", "", 0, FEED, ""), (None, "feed", "", 0, FEED, ""), (None, "ical", "", 0, ICAL, ""), ("j", "eventbrite", "", 0, ld, ""), ("j", "feed", "", 0, FEED, "")]
    raw = spark.createDataFrame([*DOCUMENTS, *nothing, *more], RAW_DOCUMENT)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.glob("chain-*"))
    expected = [("c", "ical", 3, 0), ("e", "feed", 1, 0), ("f", "feed", 1, 0), ("j", "jsonld", 2, 1), ("n", "eventbrite", 1, 1), ("null", "ical", 3, 0), ("t", "wp_tribe", 2, 0)]
    told = lambda rows: sorted((str(r.source_id or "null"), *r[1:]) for r in rows.collect())
    assert told(extract.chain_outcomes(raw, sources=source_table(spark, SOURCES))) == expected
    written = [str(p) for p in set(folder.glob("chain-*")) - before]
    # Every kind was counted for every source, before.
    assert len(written) == 1 and told(spark.read.parquet(*written)) == expected
    own = extract.ical(raw.where("kind = 'ical' AND source_id = 'c'"))
    customs = own.withColumn("kind", F.lit("custom")).unionByName(own).unionByName(own.withColumn("venue_id", F.lit("x")).withColumn("source_id", F.lit("x")).withColumn("kind", F.lit("custom")))
    assert told(extract.chain_outcomes(raw, customs, source_table(spark, SOURCES))) == sorted([x if x[0] != "c" else ("c", "ical", 6, 0) for x in expected] + [("x", "custom", 3, 0)])
