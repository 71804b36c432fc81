"""What costs grow with: how often a plan names what is dear, and values that a cast would tell by an error."""

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from handbill.functions import dates, dialects, text
from handbill.plans import registry

needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_data
def test_source_policies_reads_a_range_once(spark):
    assert optimized(registry.QUERIES["source_policies"](spark, str(DATA))).count("bthrough") == 1


def test_number_of_an_empty_text_is_null(spark):
    rows = spark.createDataFrame([("7",), ("",), ("x",), (None,)], "t string")
    assert [r.n for r in rows.select(text.number(F.col("t")).alias("n")).collect()] == [7, None, None, None]


def test_dates_without_year_day_or_month(spark):
    from datetime import date

    told = ["Mar 5", "March 5th, 2024", "Sept. 30 2021", "May", "2024", "", None, "Mar 31 to Apr 2", "June 13 - 20, 2026", "on Xyz 4"]
    span = dialects.parse_range(F.col("t"), date(2025, 1, 1))
    got = [(str(r.a), str(r.b)) for r in spark.createDataFrame([(t,) for t in told], "t string").select(span["start"].alias("a"), span["end"].alias("b")).collect()]
    none = ("None", "None")
    assert got == [("2025-03-05",) * 2, ("2024-03-05",) * 2, ("2021-09-30",) * 2, none, none, none, none, ("2025-03-31", "2025-04-02"), ("2025-06-13", "2026-06-20"), none]


@needs_data
@pytest.mark.parametrize("name", ["reshape", "warnings"])
def test_no_time_is_converted_from_utc_to_itself(spark, name):
    assert "convert_timezone(UTC, UTC" not in optimized(registry.QUERIES[name](spark, str(DATA)))


def test_an_offset_is_at_the_end(spark):
    told = ["1998-06-17T19:00:00-07:00", "1998-06-17T19:00:00+0530", "1998-06-17T19:00:00Z", "1998-06-17T19:00:00-07:00\n", "1998-06-17T19:00:00", "1998-06-17", "Z", "", None]
    rows = spark.createDataFrame([(t,) for t in told], "t string")
    assert [r.o for r in rows.select(dates.offset_of(F.col("t")).alias("o")).collect()] == ["-07:00", "+0530", "Z", "-07:00", "", "", "Z", "", None]


@needs_data
def test_reshape_looks_for_permanent_titles_once(spark):
    plan = optimized(registry.QUERIES["reshape"](spark, str(DATA)))
    # One pattern for ASCII, one for other letters.
    assert plan.count("semi[- ]permanent") == 2


@needs_data
def test_warnings_make_a_reason_once(spark):
    assert optimized(registry.QUERIES["warnings"](spark, str(DATA))).count("undated exhibition") == 1


@needs_data
def test_a_condition_on_ends_makes_each_text_once(spark):
    from handbill.operators import read_side
    from handbill.plans.sql import NOW
    from handbill.sources import star

    old = star.listings(spark, str(DATA)).where(~read_side.is_upcoming(F.col("start"), F.col("end"), NOW)).select("seq")
    # A date or a time of each end: as it was, they stood there twelve times.
    assert optimized(old).count("date_add(") == 2


@needs_data
@pytest.mark.parametrize("name, what, most", [("infer_type", "vernissage", 3), ("embedded_json", "regexp_instr", 1), ("feed_parse", "from_xml", 1), ("normalized", "charge", 3), ("single_ics", "date_add(", 5), ("display_texts", "regexp_extract(", 1)])
def test_what_is_dear_is_named_once(spark, name, what, most):
    assert optimized(registry.QUERIES[name](spark, str(DATA))).count(what) <= most


@needs_data
def test_only_what_is_asked_for_is_sorted_and_kept(spark):
    assert "description" not in optimized(registry.QUERIES["dedupe_richest"](spark, str(DATA))).split("WindowGroupLimit")[0]
    kept = optimized(registry.QUERIES["venue_listings"](spark, str(DATA)))
    assert "title" not in kept and "artists" not in kept


@needs_data
def test_saved_ids_shuffle_no_listing(spark):
    plan = optimized(registry.QUERIES["saved_semi"](spark, str(DATA)))
    # Ids of both kinds are joined to one reading of the listings.
    assert len([x for x in plan.splitlines() if "Relation" in x and "l_orderkey" in x]) == 1


def test_ids_of_several_kinds(spark):
    from handbill.operators import read_side

    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), (None, "4"), ("2", "a")], "venue_id string, seq string")
    ids = spark.createDataFrame([("a",), ("2",), ("a",), (None,)], "saved string")
    assert sorted(r.seq for r in read_side.of_saved(rows, ids, "saved", ("venue_id", "seq")).collect()) == ["1", "2", "a"]


def test_searches_read_the_keys_once(spark, tmp_path):
    from handbill.operators import search

    rows = spark.createDataFrame([(1, "Red hall", "blue"), (2, "red", None), (3, None, "")], "n long, one string, two string")
    path = str(tmp_path / "index")
    search.write_index(rows, "n", [F.col("one"), F.col("two")], path, 2)
    found = search.find_all(spark, path, ["red", "Blue", "hall"], 2)
    assert sorted((r.query, r.key) for r in found.collect()) == [("Blue", 1), ("hall", 1), ("red", 1), ("red", 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert spark.read.parquet(f"{path}/keys").count() == 2


def test_json_after_a_key_ends_with_its_bracket(spark):
    from handbill.operators import extract

    told = ['"k": [1, "]", {"a": "\\"]"}] tail "a ] b"', '"k": [1, "] a"', '"k": [1 "open ] x', '{"k" : {"é": [{}]}} "', "none", None]
    rows = spark.createDataFrame([(t,) for t in told], "t string").select(extract.json_value_after(F.col("t"), "k").alias("v"))
    assert [r.v for r in rows.collect()] == ['[1, "]", {"a": "\\"]"}]', None, '[1 "open ]', '{"é": [{}]}', None, None]


def test_leaves_are_read_together_or_each(spark):
    from handbill.operators import extract

    leaf = lambda v: '{"nodeType":"text","value":"' + v + '"}'
    told = ["[" + leaf("a") + "," + leaf("b \\u0041") + ',{"data":{"value":"x"}}]', "[" + leaf("a") + ',{"nodeType" "text"},' + leaf("[b]") + "]", "[]", None]
    rows = spark.createDataFrame([(t,) for t in told], "t string").select(extract.rich_text(F.col("t")).alias("v"))
    assert [r.v for r in rows.collect()] == ["a b A", "a [b]", "", None]
    strings = F.array_join(extract.all_strings(F.lit('{"id":"x","a":"","b" : ["c","d\\n",{"id":"y"}],"e":""}'), ("id",)), "|")
    assert spark.range(1).select(strings.alias("v")).first().v == "|c|d\n|"


@pytest.mark.parametrize("told, shown", [("a &lt; b&hellip;", "a < b…"), ("&LT;&nosuch;&lt", "<&nosuch;&lt"), ("x  é  y\tz", "x é y z"), ("&amp;lt; ; &", "&lt; ; &")])
def test_display_text(spark, told, shown):
    assert spark.range(1).select(text.display_text(F.lit(told)).alias("v")).first().v == shown


def test_local_iso_of_all_kinds(spark):
    told = ["1998-06-17 19:00:00", "1998-01-17T19:00", "1998-06-17T02:00:00Z", "Wed, 17 Jun 1998 19:00:00 +0000", "1998-04-05 02:30:00", "1998-10-25 01:30:00", "1998-06-17T00:00:00", "Wednesday June 17, 1998", "x", "", None]
    rows = spark.createDataFrame([(t,) for t in told], "t string").select(dates.to_local_iso(F.col("t")).alias("v"))
    assert [r.v for r in rows.collect()] == [
        "1998-06-17T19:00:00-07:00", "1998-01-17T19:00:00-08:00", "1998-06-16T19:00:00-07:00", "1998-06-17T12:00:00-07:00", "1998-04-05T03:30:00-07:00", "1998-10-25T01:30:00-08:00", "1998-06-17", "1998-06-17", None, None, None,
    ]


@needs_data
def test_carryover_makes_the_listings_in_one_pass(spark):
    plan = optimized(registry.QUERIES["carryover_merge"](spark, str(DATA)))
    # Once all of them, once for the venues of the new ones; a union's small part gets one task for its joins.
    assert "Union" not in plan
    assert len([x for x in plan.splitlines() if "Relation" in x and "l_orderkey" in x]) == 2


def test_carry_over_within_one_table(spark):
    from handbill.operators import write_side

    told = [("1", "a", False), ("2", "a", True), ("3", "b", False), ("4", None, False), ("5", None, True), ("6", "a", None), ("7", "c", None), ("8", "a", True)]
    rows = spark.createDataFrame(told, "seq string, venue_id string, new boolean")
    expected = [(0, "3"), (0, "4"), (0, "7"), (1, "2"), (1, "5"), (1, "8")]
    got = write_side.carried(rows, "new")
    assert got.columns == ["seq", "venue_id"] and sorted(tuple(r.seq) for r in got.collect()) == expected
    known = F.coalesce("new", F.lit(False))
    apart = write_side.carry_over(rows.where(~known).drop("new"), rows.where(known).drop("new"))
    assert apart.columns == ["seq", "venue_id"] and sorted(tuple(r.seq) for r in apart.collect()) == expected
    assert not write_side.carried(rows.limit(0), "new").collect()


@needs_data
@pytest.mark.parametrize("name", ["jsonld_flatten", "jsonld_types", "jsonld_events", "source_profile"])
def test_a_page_is_opened_once(spark, name):
    plan = optimized(registry.QUERIES[name](spark, str(DATA)))
    # SQL functions copied what lies below a node at each level.
    assert "variant" not in plan and sum("ArrowEvalPython" in x for x in plan.splitlines()) == (3 if name == "source_profile" else 1)


@needs_data
def test_fields_of_an_event_are_read_at_once(spark):
    plan = optimized(registry.QUERIES["jsonld_events"](spark, str(DATA)))
    assert "get_json_object(node" not in plan and plan.count("StructField(startDate,StringType,true), StructField(endDate") == 1


@needs_data
def test_a_profile_puts_a_body_in_lower_case_once(spark):
    # Once for each kind of document.
    assert optimized(registry.QUERIES["source_profile"](spark, str(DATA))).count("lower(body") <= 3
