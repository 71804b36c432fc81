"""Dates and times as people write them: a text is cut into tokens, each token has a class, and the classes tell which token is what.

Every class is one letter, so the classes of a text are a text themselves, as
long as the list of its tokens: where a letter stands is where its token is.
Fields that a text lacks are those of ``as_of``. All of it is native functions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from handbill.functions.text import let

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
DAYS = "montuewedthufrisatsun"
TOKEN = (
    r"\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}(?!\d)"  # a date in numbers
    r"|\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"  # a clock
    r"|(?<=:\d{2}(?:\.\d{1,9})? ?)[+-]\d{2}:?\d{2}"  # an offset behind one
    r"|\d{1,2}/\d{1,2}(?!\d)|\d{1,2}(?:st|nd|rd|th)\b|'\d{2}\b|\d+|[a-z]+|\S"
)
#: The first pattern that a token matches as a whole gives its class; j is passed over, x makes the text unreadable.
CLASSES = [
    ("D", r"\d{1,4}([/.\-])\d{1,2}\1\d{1,4}"), ("C", r"\d{1,2}:\d{2}.*"), ("Z", r"[+-]\d{2}:?\d{2}|z|utc|gmt"), ("F", r"\d{1,2}/\d{1,2}"), ("O", r"\d{1,2}(st|nd|rd|th)"),
    ("A", r"'\d{2}"), ("E", r"\d{8}"), ("Y", r"\d{4}"), ("N", r"\d{1,2}"), ("H", r"[ap]m?"),
    ("M", r"jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?"),
    ("W", r"mon(day)?|tues?(day)?|wed(nesday)?|thu(r|rs|rsday)?|fri(day)?|sat(urday)?|sun(day)?"),
    ("j", r"[,;./()\-–]|at|on|of|and|ad|t|m|[ecmp][sd]?t"),
]
#: No field twice, and no mark of a half of the day without an hour.
READABLE = r"^(?!.*x)(?!.*([DCZFAEYMWO]).*\1)(?!.*N.*N.*N)(?!.*[DEF].*[DEFMNOY])(?!.*h.*C)(?!.*C.*h)(?!(?:.*[^hC])?H)[A-Zh]+$"


def tokens(text: Column) -> Column:
    """The tokens of a text in lower case that count."""
    plain = F.regexp_replace(F.lower(text), r"(?<=[a-z])\.", "")
    found = F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: class_of(t) != "j")


def class_of(token: Column) -> Column:
    found = F.lit("x")
    for letter, pattern in reversed(CLASSES):
        found = F.when(token.rlike(f"^(?:{pattern})$"), letter).otherwise(found)
    return found


def classes(found: Column) -> Column:
    """The classes of tokens; a number before "am" or "pm" is an hour: h."""
    return F.regexp_replace(F.array_join(F.transform(found, class_of), ""), "NH", "hH")


def whole_year(year: Column, as_of: date) -> Column:
    """A year of two digits is the one nearest to ``as_of``, less than fifty years ahead."""
    near = year + as_of.year // 100 * 100
    near = F.when(near >= as_of.year + 50, near - 100).when(near < as_of.year - 50, near + 100).otherwise(near)
    return F.when(year < 100, near).otherwise(year)


def parse_date(text: Column, as_of: date) -> Column:
    """ISO text of a date, or of a time with its own offset if it has one; null if the text isn't readable.

    Months come before days in numbers unless they can't. A day that the text
    lacks is that of ``as_of``, or the month's last; a weekday alone is the next one from ``as_of`` on.
    """
    return let(tokens(text), lambda t: let(classes(t), lambda c: F.when(c.rlike(READABLE), fields(t, c, as_of))))


def fields(found: Column, kinds: Column, as_of: date) -> Column:
    at = lambda letter: F.when(F.instr(kinds, letter) > 0, F.get(found, F.instr(kinds, letter) - 1))
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    # The parts of a date in numbers, the two of month and day, and eight digits.
    parts = F.split(at("D"), r"[/.\-]")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    year_first = F.length(F.get(parts, F.lit(0))) > 2
    pair = F.split(at("F"), "/")
    one, two = F.coalesce(F.when(year_first, part(1)).otherwise(part(0)), F.get(pair, F.lit(0)).try_cast("int")), F.coalesce(F.when(year_first, part(2)).otherwise(part(1)), F.get(pair, F.lit(1)).try_cast("int"))
    eight = lambda a, n: F.substring(at("E"), a, n).try_cast("int")
    # Of plain numbers the first is the day, unless it is none; the other is a year.
    n1, n2 = number(at("N")), number(F.get(found, F.instr(kinds, "N") - 1 + F.instr(F.substr(kinds, F.instr(kinds, "N") + 1), "N")))
    second = F.when(kinds.rlike("N.*N"), n2)
    swapped = (n1 > 31) | (n1 == 0)
    day_n, year_n = F.when(swapped, second).otherwise(n1), F.when(swapped, n1).otherwise(second)
    month_name = F.when(at("M").isNotNull(), ((F.instr(F.lit(MONTHS), F.substring(at("M"), 1, 3)) + 2) / 3).cast("int"))
    month = F.coalesce(month_name, F.when(one > 12, two).otherwise(one), eight(5, 2))
    day = F.coalesce(number(at("O")), F.when(one > 12, one).otherwise(two), eight(7, 2), day_n)
    year = F.coalesce(number(at("Y")), F.when(year_first, part(0)).otherwise(part(2)), number(at("A")), eight(1, 4), year_n)
    year = F.coalesce(whole_year(year, as_of), F.lit(as_of.year))
    first = F.format_string("%04d-%02d-01", year, F.coalesce(month, F.lit(as_of.month))).try_cast("date")
    told = F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(as_of.month)), day).try_cast("date")
    lacking = F.least(F.date_add(first, as_of.day - 1), F.last_day(first))
    weekday = ((F.instr(F.lit(DAYS), F.substring(at("W"), 1, 3)) + 2) / 3).cast("int") - 1
    ahead = F.when(at("W").isNotNull(), F.pmod(weekday - F.weekday(lacking), F.lit(7))).otherwise(0)
    whole = F.when(day.isNull(), F.date_add(lacking, ahead)).otherwise(told)
    clock = F.split(at("C"), ":")
    hour = F.coalesce(F.get(clock, F.lit(0)), at("h")).try_cast("int")
    half = F.substring(at("H"), 1, 1)
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second_of = (F.coalesce(F.get(clock, F.lit(i)).try_cast("double").cast("int"), F.lit(0)) for i in (1, 2))
    zone = F.when(at("Z").rlike(r"^\D+$"), "Z").otherwise(F.coalesce(at("Z"), F.lit("")))
    timed = F.when((hour < 24) & (minute < 60) & (second_of < 60), F.concat(whole.cast("string"), F.format_string("T%02d:%02d:%02d", hour, minute, second_of), zone))
    return F.when(at("C").isNull() & at("h").isNull(), whole.cast("string")).otherwise(timed)
