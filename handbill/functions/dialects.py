"""Date and clock dialects of source pages, with the policies for missing years as arguments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.functions.dates import to_local_iso
from handbill.functions.text import let, number

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
CLOCK = r"(?i)(?<![\d$])(\d{1,2})(?::(\d{2}))?\s*([ap])?\.?\s?(?:m\b\.?)?"
RANGE = rf"{CLOCK}\s*(?:-|–|—|to)\s*{CLOCK.replace('(?i)', '')}"


def minutes(hour: Column, minute: Column, half: Column) -> Column:
    h = number(hour) % 12 + F.when(F.lower(half) == "p", 12).otherwise(0)
    return h * 60 + F.coalesce(number(minute), F.lit(0))


def parse_clock(text: Column) -> Column:
    """(start, end) in minutes of the day; a range first, else one time with a.m. or p.m.

    A range's start without a.m. or p.m. takes that of its end, unless that would put it after the end.
    """
    part = lambda i: F.regexp_extract(text, RANGE, i)
    end = minutes(part(4), part(5), part(6))
    like_end = minutes(part(1), part(2), part(6))
    other = minutes(part(1), part(2), F.when(F.lower(part(6)) == "p", "a").otherwise("p"))
    start = F.when(part(3) != "", minutes(part(1), part(2), part(3))).when(like_end <= end, like_end).otherwise(other)
    one = r"(?i)(?<![\d$])(\d{1,2})(?::(\d{2}))?\s*([ap])\.?\s?m\b"
    alone = minutes(F.regexp_extract(text, one, 1), F.regexp_extract(text, one, 2), F.regexp_extract(text, one, 3))
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.when(part(6) != "", pair(start, end)).when(F.regexp_extract(text, one, 3) != "", pair(alone, F.lit(None))).otherwise(pair(F.lit(None), F.lit(None)))


def parse_clock_strict(text: Column, marker: str | None = None, first_only: bool = False) -> Column:
    """As parse_clock(), for sources whose prose holds other numbers: both sides of a range need their a.m. or p.m.

    With ``marker`` ("PT") a time counts only where that follows. ``first_only`` gives no end.
    """
    after = rf"\s*{marker}\b" if marker else ""
    side = r"(\d{1,2})(?::(\d{2}))?\s*([ap])\.?\s?m\b\.?"
    ranged, one = rf"(?i)(?<![\d$]){side}\s*(?:-|–|—|to)\s*{side}{after}", rf"(?i)(?<![\d$]){side}{after}"
    part = lambda i: F.regexp_extract(text, ranged, i)
    alone = lambda i: F.regexp_extract(text, one, i)
    start = F.when(part(6) != "", minutes(part(1), part(2), part(3))).when(alone(3) != "", minutes(alone(1), alone(2), alone(3)))
    end = F.when((part(6) != "") & F.lit(not first_only), minutes(part(4), part(5), part(6)))
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def parse_clock_24(text: Column) -> Column:
    """(start, end) in minutes of "19:00" or "19:00 – 21:30", a clock of 24 hours without a.m. or p.m."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:[01]?\d|2[0-3]):[0-5]\d)\b(?!\s*[AaPp]\.?[Mm])"), F.lit(1))
    of = lambda c: (F.split_part(c, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(c, F.lit(":"), F.lit(2)).cast("int")).cast("int")
    return F.struct(of(F.get(found, F.lit(0))).alias("start"), of(F.get(found, F.lit(1))).alias("end"))


def local_time(day: Column, minute: Column, offset: str | None = None) -> Column:
    """ISO text, in local time, of a date and a minute of the day; a date alone if the minute is null.

    The minute is a local wall clock. With ``offset`` ("-07:00") it is read at that
    constant offset, as some sources do: in winter the result is then an hour early.
    """
    wall = F.format_string("%sT%02d:%02d:00", day.cast("string"), F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))
    return F.when(minute.isNull(), day.cast("string")).otherwise(to_local_iso(F.concat(wall, F.lit(offset or ""))))


def time_required(rows: DataFrame, minute: str) -> tuple[DataFrame, DataFrame]:
    """(kept, warnings): rows with a clock time, and (venue_id, title, reason) of those without."""
    return rows.where(F.col(minute).isNotNull()), rows.where(F.col(minute).isNull()).select("venue_id", "title", F.lit("dropped (no time)").alias("reason"))


def month_number(name: Column) -> Column:
    at = F.instr(F.lit(MONTHS), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, (at + 2) / 3).cast("int")


def month_day(text: Column, year: Column) -> Column:
    """The date of "March 13", "Mar. 13, 2026" and the like; ``year`` where the text has none."""
    found = r"[A-Za-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?"
    padded = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def read(x: Column) -> Column:
        # Of what was found, the first digits are the day, and only a year is four digits at its end.
        own = F.when(x.rlike(r"\d{4}$"), F.substring(x, -4, 4).try_cast("int")).otherwise(year)
        parts = F.concat(padded(own, 4), F.lit("-"), padded(month_number(x), 2), F.lit("-"), padded(F.regexp_extract(x, r"\d{1,2}", 0), 2))
        return F.when(x != "", parts.try_cast("date"))

    return let(F.regexp_extract(text, found, 0), read)


def year_in(text: Column) -> Column:
    return number(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1))


#: What is done about a year that a text lacks.
YEAR_POLICIES = ("same", "from_end", "next_if_past", "month")


def parse_range(text: Column, as_of: date, policy: str | Column = "same", past_days: int | Column = 14) -> Column:
    """(start, end) dates of "A – B"; a single date is both. ``policy`` and ``past_days`` may be columns: settings of a row's source.

    Years that the text lacks: ``same`` takes that of ``as_of``; ``from_end``
    copies the end's year, or the one before if the months wrap; ``next_if_past``
    moves to the next year what lies more than ``past_days`` days back; ``month``
    what lies in an earlier month than that of ``as_of``. An unknown policy is ``same``.
    """
    chosen = F.lit(policy) if isinstance(policy, str) else policy
    back = F.lit(past_days) if isinstance(past_days, int) else past_days
    now = F.lit(as_of.year)
    sides = F.split(F.regexp_replace(text, r"(?i)\s*(?:-|–|—|\bthrough\b|\bto\b)\s*", "|"), "\\|")

    # Each part is read once: later steps name it by a variable.
    def parted(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        has_month = F.coalesce(right.rlike(r"^\s*[A-Za-z]{3}"), F.lit(False))
        # "March 13 - 20, 2026": the second side lacks its month.
        whole = F.when(right.isNull() | has_month, right).otherwise(F.concat(F.regexp_extract(left, r"([A-Za-z]{3,9})", 1), F.lit(" "), F.trim(right)))
        years = lambda r: F.struct(left.alias("left"), r.alias("right"), year_in(left).alias("left_year"), year_in(r).alias("right_year"))
        return let(let(whole, years), lambda x: let(month_day(x["right"], F.coalesce(x["right_year"], now)), lambda end: begun(x, end)))

    def begun(x: Column, end: Column) -> Column:
        start = month_day(x["left"], F.coalesce(x["left_year"], F.when(chosen == "from_end", F.year(end)), now))
        wrapped = lambda s: F.when((chosen == "from_end") & x["left_year"].isNull() & (s > end), F.add_months(s, -12)).otherwise(s)
        return let(let(start, wrapped), lambda s: ended(moved(s, x["left_year"]), moved(end, x["right_year"])))

    def moved(day: Column, year: Column) -> Column:
        late = ((chosen == "next_if_past") & (F.datediff(F.lit(as_of), day) > back)) | ((chosen == "month") & (F.month(day) < as_of.month))
        return F.when(year.isNull() & late, F.add_months(day, 12)).otherwise(day)

    def ended(start: Column, end: Column) -> Column:
        return let(start, lambda s: F.struct(s.alias("start"), F.coalesce(end, s).alias("end")))

    return let(sides, parted)


def date_list(text: Column, year: Column) -> Column:
    """All dates of "Jun 19, 20 & 21", as an array."""
    month = month_number(F.regexp_extract(text, r"([A-Za-z]{3,9})", 1))
    days = F.regexp_extract_all(F.regexp_replace(text, r"\b\d{4}\b", ""), F.lit(r"\b(\d{1,2})\b"), 1)
    return F.transform(days, lambda d: F.format_string("%04d-%02d-%02d", F.coalesce(year_in(text), year), month, d.cast("int")).try_cast("date"))
