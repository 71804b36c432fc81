"""Calendar feeds: events to lines, lines to one document."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.functions import dates, text, vocab

BLURB = 400


def utc_stamp(value: Column) -> Column:
    """yyyyMMddTHHmmssZ of a time; one without offset is local."""
    at = dates.instant(value, vocab.TIME_ZONE).cast("string")
    return F.concat(F.replace(F.replace(F.replace(F.substring(at, 1, 19), F.lit("-"), F.lit("")), F.lit(":"), F.lit("")), F.lit(" "), F.lit("T")), F.lit("Z"))


def date_value(value: Column) -> Column:
    return F.replace(F.substring(value, 1, 10), F.lit("-"), F.lit(""))


def event_lines(now: datetime, domain: str = "listings") -> Column:
    """The folded lines of one event as an array, from listing columns and venue_name and venue_address.

    Null for a listing without a readable start. An end date is written as it is, inclusive.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    timed = F.col("start").contains("T") & ~F.coalesce(F.col("all_day"), F.lit(False))
    location = F.coalesce(some("location_override"), some("venue_address"), some("venue_name"))
    cost = F.coalesce(some("price_text"), F.when(F.col("is_free"), "Free"))
    head = F.concat_ws(" · ", some("venue_name"), cost, some("url"))
    blurb = F.substring(F.trim(text.text_or_empty(F.col("description"))), 1, BLURB)
    body = F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.nullif(blurb, F.lit("")))
    end = F.when(timed, F.when(F.col("end").contains("T"), F.concat(F.lit("DTEND:"), utc_stamp(F.col("end"))))).otherwise(F.concat(F.lit("DTEND;VALUE=DATE:"), date_value(some("end"))))
    start = F.when(timed, F.concat(F.lit("DTSTART:"), utc_stamp(F.col("start")))).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), date_value(F.col("start"))))
    told = lambda name, value: text.ics_fold(F.concat(F.lit(f"{name}:"), value))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("id"), F.lit(f"@{domain}")), F.lit(f"DTSTAMP:{now:%Y%m%dT%H%M%SZ}"), start, end,
        told("SUMMARY", text.ics_escape(F.col("title"))), told("LOCATION", text.ics_escape(location)), told("URL", some("url")),
        told("DESCRIPTION", F.nullif(text.ics_escape(body), F.lit(""))), F.lit("END:VEVENT"),
    )
    lines = F.filter(lines, lambda x: x.isNotNull() & (x != "LOCATION:"))
    return F.when(dates.wall(F.col("start")).isNotNull(), lines)


def single_event(now: datetime, domain: str = "listings") -> Column:
    """A calendar of one event, lines unfolded, from listing columns and venue_name and venue_address; null without a readable start.

    Without an end a time lasts two hours and a date one day; an end that is given stays as it is.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    timed = F.col("start").contains("T") & ~F.coalesce(F.col("all_day"), F.lit(False))
    known = dates.wall(F.col("end")).isNotNull()
    # A date stands for its midnight in UTC wherever a time is wanted.
    stamp = lambda c: F.when(dates.is_date(c), F.concat(date_value(c), F.lit("T000000Z"))).otherwise(utc_stamp(c))
    day = lambda c: F.when(dates.is_date(c), date_value(c)).otherwise(F.substring(utc_stamp(c), 1, 8))
    later = (dates.instant(F.col("start"), vocab.TIME_ZONE) + F.expr("INTERVAL 2 HOURS")).cast("string")
    end_time = F.when(known, stamp(F.col("end"))).otherwise(F.concat(F.regexp_replace(F.replace(F.substring(later, 1, 19), F.lit(" "), F.lit("T")), "[-:]", ""), F.lit("Z")))
    end_date = F.when(known, day(F.col("end"))).otherwise(date_value(F.date_add(dates.wall(F.col("start")).cast("date"), 1).cast("string")))
    location = F.coalesce(some("location_override"), some("venue_address"), some("venue_name"))
    told = lambda name, value: F.concat(F.lit(f"{name}:"), text.ics_escape(value))
    lines = F.array(
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("PRODID:-//listings//EN"), F.lit("CALSCALE:GREGORIAN"), F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.col("id"), F.lit(f"@{domain}")), F.lit(f"DTSTAMP:{now:%Y%m%dT%H%M%SZ}"),
        F.when(timed, F.concat(F.lit("DTSTART:"), stamp(F.col("start")))).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), day(F.col("start")))),
        F.when(timed, F.concat(F.lit("DTEND:"), end_time)).otherwise(F.concat(F.lit("DTEND;VALUE=DATE:"), end_date)),
        told("SUMMARY", F.col("title")), F.when(some("description").isNotNull(), told("DESCRIPTION", F.col("description"))),
        told("LOCATION", location), F.when(some("url").isNotNull(), told("URL", F.col("url"))), F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    )
    return F.when(dates.wall(F.col("start")).isNotNull(), F.array_join(F.array_compact(lines), "\r\n"))


def calendar_rows(events: DataFrame, name: str, now: datetime) -> DataFrame:
    """(place, line): the lines of a calendar in order; ``place`` sorts them, by start text and title."""
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//listings//EN", "CALSCALE:GREGORIAN", f"X-WR-CALNAME:{name}", f"X-WR-TIMEZONE:{vocab.TIME_ZONE}"]
    spark = events.sparkSession
    place = lambda part, *more: F.struct(F.lit(part).alias("part"), *more)
    nothing = [F.lit("").alias("start"), F.lit("").alias("title"), F.lit("").alias("id")]
    own = [text.text_or_empty(F.col("start")).alias("start"), text.text_or_empty(F.col("title")).alias("title"), F.col("id").alias("id")]
    lines = events.select(place(1, *own).alias("at"), F.posexplode(event_lines(now)).alias("pos", "line"))
    ends = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, 0, "END:VCALENDAR")], "part int, pos int, line string")
    fixed = ends.select(F.struct("part", *nothing).alias("at"), "pos", "line")
    return fixed.unionByName(lines).select(F.struct("at", "pos").alias("place"), "line")


def write_calendar(events: DataFrame, name: str, now: datetime, path: str) -> None:
    """A calendar with CRLF line ends, sorted over part files: those of ``path`` in the order of their names are the calendar."""
    rows = calendar_rows(events, name, now).orderBy("place").select("line")
    rows.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def calendar_link(base: str = "https://calendar.google.com/calendar/render") -> Column:
    """A link that adds one event to a calendar; without end two hours for a time, one day for a date."""
    timed = F.col("start").contains("T") & ~F.coalesce(F.col("all_day"), F.lit(False))
    begins = dates.wall(F.col("start"))
    ends = F.coalesce(dates.wall(F.col("end")), begins + F.expr("INTERVAL 2 HOURS"))
    compact = lambda c, n: F.regexp_replace(F.replace(F.substring(c.cast("string"), 1, n), F.lit(" "), F.lit("T")), "[-:]", "")
    span = F.when(timed, F.concat(compact(begins, 19), F.lit("/"), compact(ends, 19))).otherwise(F.concat(compact(begins, 10), F.lit("/"), compact(F.date_add(ends.cast("date"), 1), 10)))
    details = F.concat_ws("\n\n", F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("url"), F.lit("")))
    return F.concat(F.lit(f"{base}?action=TEMPLATE&text="), F.url_encode(text.text_or_empty(F.col("title"))), F.lit("&dates="), span, F.lit("&details="), F.url_encode(details), F.lit(f"&ctz={quote(vocab.TIME_ZONE, safe='')}"))
