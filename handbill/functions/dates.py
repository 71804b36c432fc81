"""Dates and times of listings.

A start or end is a text: a date of ten characters, or a time with its offset.
Three readings of it coexist: wall fields as written (the read side), the instant
(archive and hygiene), and the end of the day for a date. Every function takes
the current time as an argument.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from handbill.functions import freeform, vocab
from handbill.functions.text import let, missing

NTZ = "timestamp_ntz"


def is_date(text: Column) -> Column:
    return F.length(text) == 10


def wall(text: Column) -> Column:
    """The wall clock fields as written, offset ignored; a date is its midnight; null if unreadable."""
    return F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")).try_cast(NTZ)


def end_of_day_wall(text: Column) -> Column:
    """As wall(), but a date is the last millisecond of its day."""
    return let(text, lambda t: F.when(is_date(t), wall(t) + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")).otherwise(wall(t)))


def last_text(start: Column, end: Column) -> Column:
    # A condition is pushed down to where texts are made: named by a variable, they are made once there, and its code stays short enough to be compiled.
    return let(end, lambda e: F.when(missing(e), start).otherwise(e))


def offset_of(text: Column) -> Column:
    """Z or an offset at the end of a text, else empty; looked for in its last characters alone."""
    return F.regexp_extract(F.substring(text, -7, 7), r"(Z|[+-]\d{2}:?\d{2})$", 1)


def instant(text: Column, zone: str, clock: str = "00:00:00") -> Column:
    """The instant as UTC wall fields; a date, or a time without offset, is read in ``zone``, a date at ``clock``."""

    def read(x: Column) -> Column:
        at, offset = x["at"], x["offset"]
        sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
        minutes = sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int"))
        own = F.when(offset == "Z", at).otherwise(at - F.make_dt_interval(mins=minutes))
        # Names of zones are looked up anew in each row, so nothing is converted from UTC to itself.
        local = at if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), at)
        return F.when(offset == "", local).otherwise(own)

    def parts(t: Column) -> Column:
        plain = F.when(is_date(t), F.concat(t, F.lit(f" {clock}"))).otherwise(F.replace(F.substring(t, 1, 19), F.lit("T"), F.lit(" ")))
        return F.struct(plain.try_cast(NTZ).alias("at"), F.when(is_date(t), "").otherwise(offset_of(t)).alias("offset"))

    return let(let(text, parts), read)


def end_of_event(start: Column, end: Column) -> Column:
    """When an event is over, as UTC fields: 23:59 local time for a date, else the instant."""
    return instant(last_text(start, end), vocab.TIME_ZONE, "23:59:00")


def gate_instant(text: Column) -> Column:
    """As the hygiene gate reads it: a date is midnight UTC."""
    return instant(text, "UTC")


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end: of instants, or of wall fields if just one is a date; null if either is missing."""
    mixed = is_date(start) != is_date(end)
    span = F.when(mixed, seconds(wall(end)) - seconds(wall(start))).otherwise(seconds(gate_instant(end)) - seconds(gate_instant(start)))
    return F.when(missing(start) | missing(end), F.lit(None)).otherwise(span)


def seconds(at: Column) -> Column:
    """Seconds of wall fields since 1970, whatever the session's time zone."""
    return (at - F.lit("1970-01-01").cast(NTZ)).cast("interval second").cast("bigint")


def to_local_iso(text: Column, as_of: date | None = None) -> Column:
    """ISO text in local time: dates stay, midnight in its own zone becomes a date, times get the local offset.

    Also reads "Month d, yyyy", "Mon d, yyyy", "m/d/yyyy" and mail dates, and with ``as_of`` whatever
    freeform.parse_date() does. Null if unreadable. At the end of daylight saving an ambiguous local time
    without offset is standard time.
    """
    # What begins below the letters begins with no weekday.
    bare = lambda t: F.when(t < "A", t).otherwise(F.regexp_replace(t, r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""))
    read = let(let(F.trim(text), bare), as_iso)
    return let(read if as_of is None else F.coalesce(read, freeform.parse_date(text, as_of)), as_local)


def as_iso(bare: Column) -> Column:
    """A date or time in any of the forms that to_local_iso() reads, as ISO text with its own offset if it has one."""
    day = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)).cast("date") for f in ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy")])
    mail = mail_date(bare)
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"), F.replace(bare, F.lit(" "), F.lit("T")))
    return F.coalesce(iso, mail, F.date_format(day, "yyyy-MM-dd"))


def as_local(whole: Column) -> Column:
    """Each part of the text is read once: other steps name it by a variable."""
    offset = offset_of(whole)
    fields = F.regexp_extract(whole, r"T(\d{2}:\d{2}(?::\d{2})?)", 1)
    day = F.substring(whole, 1, 10)
    return F.when(is_date(whole), day).when(whole.isNotNull(), let(F.struct(day.alias("day"), fields.alias("fields"), offset.alias("offset")), read_parts))


def read_parts(parts: Column) -> Column:
    day, offset = parts["day"], parts["offset"]
    clock = F.when(F.length(parts["fields"]) == 5, F.concat(parts["fields"], F.lit(":00"))).otherwise(parts["fields"])
    minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int")
    back = F.make_dt_interval(mins=F.when(F.substring(offset, 1, 1) == "-", -minutes).otherwise(minutes))
    utc = lambda t: F.when(offset == "", local_to_utc(t)).when(offset == "Z", t.try_cast(NTZ)).otherwise(t.try_cast(NTZ) - back)
    return let(clock, lambda c: F.when(c == "00:00:00", day).otherwise(let(let(F.concat(day, F.lit(" "), c), utc), local_text)))


MAIL = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4}) (\d{2}:\d{2})(:\d{2})? ?(GMT|UTC|Z|[+-]\d{4})$"


def mail_date(text: Column) -> Column:
    """ISO text of "22 Aug 2026 19:00:00 +0000"; null for anything else."""

    def written(part: Column) -> Column:
        month = (F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), part[1]) + 2) / 3
        clock = F.concat(part[3], F.when(part[4] == "", ":00").otherwise(part[4]))
        zone = F.when(part[5].isin("GMT", "UTC"), "Z").otherwise(part[5])
        day = F.concat_ws("-", part[2], F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(part[0], 2, "0"))
        return F.concat(day, F.lit("T"), clock, zone)

    return F.when(text.rlike(MAIL), let(F.split(F.regexp_replace(text, MAIL, "$1|$2|$3|$4|$5|$6"), "[|]"), written))


def local_to_utc(text: Column) -> Column:
    """UTC fields of local wall fields; the later instant of an hour that comes twice."""

    def latest(x: Column) -> Column:
        late = x["early"] + F.expr("INTERVAL 1 HOUR")
        return F.when(F.convert_timezone(F.lit("UTC"), F.lit(vocab.TIME_ZONE), late) == x["at"], late).otherwise(x["early"])

    early = lambda at: F.struct(at.alias("at"), F.convert_timezone(F.lit(vocab.TIME_ZONE), F.lit("UTC"), at).alias("early"))
    return let(let(text.try_cast(NTZ), early), latest)


def local_text(utc: Column) -> Column:
    """ISO text with offset, in local time, of UTC fields."""

    def written(local: Column) -> Column:
        hours = F.lpad(F.floor((seconds(utc) - seconds(local)) / 3600).cast("string"), 2, "0")
        behind = F.when(utc - local == F.expr("INTERVAL 7 HOURS"), "07").when(utc - local == F.expr("INTERVAL 8 HOURS"), "08").otherwise(hours)
        return F.concat(F.replace(F.substring(local.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("-"), behind, F.lit(":00"))

    return let(F.convert_timezone(F.lit("UTC"), F.lit(vocab.TIME_ZONE), utc), written)


def window_of(preset: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """The inclusive wall window of a date preset; (None, None) for no restriction."""
    today = now.replace(hour=0, minute=0, second=0, microsecond=0)
    last = timedelta(hours=23, minutes=59, seconds=59, milliseconds=999)
    if preset == "today":
        return today, today + last
    if preset == "next7":
        return now, today + timedelta(days=7) + last
    if preset in ("weekend", "nextweekend"):
        friday = today + timedelta(days=-2 if today.weekday() == 6 else 4 - today.weekday())
        if preset == "nextweekend":
            friday += timedelta(days=7)
            return friday, friday + timedelta(days=2) + last
        return max(friday, now) if friday < now else friday, friday + timedelta(days=2) + last
    return None, None


def ntz(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(NTZ)


def relative_label(start: Column, end: Column, exhibition: Column, now: datetime) -> Column:
    """Now, Today, Tomorrow, This weekend or This week; null for what is past or further off."""
    at = wall(start)
    days = F.datediff(at.cast("date"), F.lit(now.date()))
    running = ~exhibition & (at <= ntz(now)) & (F.coalesce(wall(end), at) >= ntz(now)) & ~missing(end)
    weekend = F.dayofweek(at.cast("date")).isin(1, 6, 7)
    return (
        F.when(at.isNull(), F.lit(None)).when(running, "Now").when(days < 0, F.lit(None)).when(days == 0, "Today").when(days == 1, "Tomorrow")
        .when((days <= 7) & weekend, "This weekend").when(days <= 7, "This week")
    )


def days_until_close(start: Column, end: Column, now: datetime) -> Column:
    """Whole days, rounded half up, from today's midnight to the end."""
    spent = seconds(wall(last_text(start, end))) - seconds(ntz(now.replace(hour=0, minute=0, second=0, microsecond=0)))
    return F.floor(spent / 86400 + 0.5).cast("long")
