"""Feeds hold all upcoming one-off events, links are of all upcoming listings; a calendar may have many part files."""

from datetime import datetime

import pytest
from oracle import DATA, by_duckdb

from handbill.operators import feeds
from handbill.plans import registry
from handbill.sources import star

WITH = f"WITH {star.SQL_TABLES.strip()} SELECT seq FROM placed WHERE {registry.LIVE}"


@pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")
def test_feeds_and_links_have_all_upcoming_events(spark):
    of = lambda more="": sorted(r[0] for r in by_duckdb(WITH + more)[1])
    lines = registry.ics_lines(spark, str(DATA)).where("pos = 0").select("feed", "seq").collect()
    started = " AND event_type <> 'exhibition' AND s_wall IS NOT NULL"
    for name, more in (("all", ""), ("free", " AND is_free IS NOT DISTINCT FROM true"), ("family", " AND family")):
        got = sorted(r.seq for r in lines if r.feed == name)
        assert got and got == of(started + more)
    assert sorted(r.seq for r in registry.calendar_link(spark, str(DATA)).collect()) == of()


def test_calendar_is_its_part_files_in_order(spark, tmp_path):
    columns = "id string, title string, start string, end string, all_day boolean, url string, description string, price_text string, is_free boolean, location_override string, venue_name string, venue_address string"
    rows = [(f"e{i}", f"Title {i:03}", f"2026-08-{1 + i % 28:02}", None, True, None, None, None, None, None, "Hall", None) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        feeds.write_calendar(spark.createDataFrame(rows, columns), "All", datetime(2026, 8, 1), str(tmp_path / "feed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "feed").glob("part-*"))
    lines = b"".join(p.read_bytes() for p in parts).decode().split("\r\n")
    assert len(parts) > 1 and lines[0] == "BEGIN:VCALENDAR" and lines[-2:] == ["END:VCALENDAR", ""]
    want = [f"UID:{r[0]}@listings" for r in sorted(rows, key=lambda r: (r[2], r[1], r[0]))]
    assert [x for x in lines if x.startswith("UID:")] == want


def test_feeds_of_a_listing(spark):
    from pyspark.sql import functions as F

    from handbill.operators import write_side

    rows = spark.createDataFrame(
        [(1, "tour", True, ["family"]), (2, "tour", None, []), (3, "exhibition", True, []), (4, "fair", False, ["teen", "family"]), (5, "fair", True, [])],
        "seq int, event_type string, is_free boolean, audience array<string>",
    )
    once = write_side.one_off(rows).select("seq", F.explode(write_side.feeds_of()).alias("feed")).collect()
    apart = [(r.seq, name) for name in ("all", "free", "family") for r in write_side.feed(rows, name).collect()]
    assert sorted((r.seq, r.feed) for r in once) == sorted(apart)
