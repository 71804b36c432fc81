"""Published versions, the JSON gate, links, and settings of sources."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from handbill.functions import text, vocab
from handbill.operators import write_side
from handbill.sources import tables


def test_a_run_reads_the_version_before_while_it_writes_the_next(spark, tmp_path):
    at = f"file://{tmp_path}/published"
    assert tables.published(spark, at, "health", tables.HEALTH).count() == 0
    first = spark.createDataFrame([("v", 1, None)], tables.HEALTH)
    assert tables.publish({"health": first}, at, dry_run=True) == {"health": 1} and tables.latest_version(spark, at) is None
    tables.publish({"health": first}, at)
    more = tables.published(spark, at, "health", tables.HEALTH).unionByName(spark.createDataFrame([("w", 0, "2026-01-01")], tables.HEALTH))
    assert tables.publish({"health": more}, at) == {"health": 2}
    assert tables.latest_version(spark, at) == 2
    assert sorted(r.venue_id for r in tables.published(spark, at, "health", tables.HEALTH).collect()) == ["v", "w"]
    first.write.parquet(f"{at}/version=3/health")  # a run that died: its list of tables is lacking
    assert tables.latest_version(spark, at) == 2


def test_json_gate(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"a": 1}]')
    (tmp_path / "bad.json").write_text('[{"a": 1}')
    paths = [f"{tmp_path}/good.json", f"{tmp_path}/bad.json"]
    assert [r.path.rsplit("/", 1)[1] for r in tables.corrupt_files(spark, paths).collect()] == ["bad.json"]
    with pytest.raises(ValueError, match="bad.json"):
        tables.require_json(spark, paths)
    tables.require_json(spark, paths[:1])


def test_links_in_a_fixed_order(spark):
    rows = spark.createDataFrame([({"youtube": "y", "instagram": "i", "facebook": "", "other": "o"},), (None,)], "socials map<string,string>")
    got = [[(x.network, x.url) for x in r.links] for r in rows.select(text.social_links(F.col("socials")).alias("links")).collect()]
    assert got == [[("instagram", "i"), ("youtube", "y")], []]


def test_what_sources_do_not_publish(spark):
    rules = tables.source_table(spark, [tables.Source("a", "a", skip_titles=("General admission",), skip_pattern=vocab.CALLED_OFF), tables.Source("b", "b", skip_types=("tour",), drop_past=True, require_time=True), tables.Source("c", "c")])
    rows = [
        ("a", " GENERAL admission", "other", None), ("a", "past: a show", "other", None), ("a", "The past: a show", "other", "1990-01-01"), ("a", None, None, None),
        ("b", "Walk", "tour", None), ("b", "Talk", "lecture", "2026-01-02"), ("b", "Talk", "lecture", None), ("b", "Talk", "lecture", "2026-01-01T10:00:00-08:00"),
        ("b", "Talk", "lecture", "2026-01-02T00:00:00-08:00"), ("b", "Talk", None, "T"), ("c", "General admission", "tour", None), ("unknown", "Past: it", "tour", None), (None, None, None, None),
    ]
    listings = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, venue_id string, title string, event_type string, start string")
    judged = write_side.publishable(listings, rules, date(2026, 1, 2))
    assert judged.columns == [*listings.columns, "skip"]
    got = [r.skip for r in judged.orderBy("seq").collect()]
    assert got == ["title", "pattern", None, None, "type", "no time", "no time", "past", None, None, None, None, None]
    assert [tuple(r) for r in write_side.skip_warnings(judged).collect()] == [("b", "Talk", "dropped (no time)")]
    assert write_side.publishable(listings.limit(0), rules, date(2026, 1, 2)).count() == 0


@pytest.mark.parametrize(
    "given, told, bare",
    [
        (None, "", ""), ("<p>a</p>\n b", "a b", "a b"), ("&LdQuo;x&rdquo;", "“x”", "&LdQuo;x&rdquo;"), ("&amp;lt;", "&lt;", "&amp;lt;"),
        ("&#38;amp; &#x41; &x; & &;", "& A &x; & &;", "&#38;amp; &#x41; &x; & &;"), ("a&nbsp;&nbsp;b", "a b", "a&nbsp;&nbsp;b"), ("\u00a0a\u2003", "a", "a"),
    ],
)
def test_text_as_a_page_shows_it(spark, given, told, bare):
    rows = spark.createDataFrame([(given,)], "t string")
    assert tuple(rows.select(text.display_text(F.col("t")), text.display_text(F.col("t"), None)).first()) == (told, bare)
