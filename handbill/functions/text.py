"""Text as Column functions: markup, titles, ids, calendar escapes and folding."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.functions import vocab

#: Letters, digits and white space of a pattern count beyond ASCII too, in either case.
ANY_CASE = "(?Ui)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written once, however often ``body`` names it: nested texts stay short."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(text: Column) -> Column:
    """A text as an int, null if it is none. An empty one, what a pattern gives that isn't found, isn't cast: each failed cast makes an error first, which costs far more than the row."""
    return let(text, lambda t: F.when(t != "", t.try_cast("int")))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def missing(c: Column) -> Column:
    """Null or empty: what scripting languages take for absent."""
    return F.coalesce(c, F.lit("")) == ""


#: What a match may lack: groups, classes, escapes and single letters, each with how often it occurs.
UNSURE = re.compile(r"(?:\((?:[^()]|\([^()]*\))*\)|\[[^]]*\]|\\.)(?:[?*+]|\{[^}]*\})?|[a-z0-9](?:[?*]|\{[^}]*\})")


def needed(pattern: str) -> list[str] | None:
    """Runs of letters one of which is in any match of a pattern, by its alternatives; None if one of them has none."""
    body = re.sub(r"^\\b|\\b$", "", pattern)
    if re.fullmatch(r"\((?!\?[^:]).*\)", body) and closing(body) == len(body) - 1:
        body = re.sub(r"^\((?:\?:)?", "", body[:-1])
    parts, depth = [""], 0
    for i, c in enumerate(body):
        depth += (c in "([") - (c in ")]")
        parts = [*parts, ""] if c == "|" and depth == 0 else [*parts[:-1], parts[-1] + c]
    found: list[str] = []
    for part in parts:
        # An alternative that begins with a group needs what the group needs.
        inner = needed(part[: closing(part) + 1]) if part.startswith("(?:") and not part[closing(part) + 1 :].startswith(("?", "*", "{")) else None
        own = inner or [max(re.findall("[a-z0-9]+", UNSURE.sub("|", part)), key=len, default="")]
        if "" in own:
            return None
        found += own
    return sorted({w for w in found if not any(o != w and o in w for o in found)})


def closing(pattern: str) -> int:
    """Where the group that a pattern begins with ends."""
    depth = 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i
    return -1


def matches(c: Column, pattern: str, low: Column | None = None, plain: Column | None = None, unless: str = "") -> Column:
    """Whether a pattern is found in a text, in either case; false for null. A text of ASCII alone takes the faster form.

    ``low`` is the text in lower case where a column holds it: then the pattern is
    tried only if letters that it needs are there, which is far cheaper to tell.
    ``plain`` tells whether the text is ASCII, where that is known; ``unless`` is what must not come before the pattern.
    """
    plain = F.octet_length(c) == F.length(c) if plain is None else plain
    known = needed(pattern) if low is not None else None
    there = reduce(lambda a, b: a | b, [low.contains(w) for w in known]) if known else F.lit(True)
    found = F.when(plain, there & F.regexp_like(c, F.lit("(?i)" + unless + pattern))).otherwise(F.regexp_like(c, F.lit(ANY_CASE + unless + pattern)))
    return F.coalesce(found, F.lit(False))


def with_low(c: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of a text, the text in lower case and whether it is ASCII, each made once: what matches() takes."""
    parts = lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"), (F.octet_length(t) == F.length(t)).alias("plain"))
    return let(let(c, parts), lambda x: body(x["text"], x["low"], x["plain"]))


def described(title: Column, description: Column) -> Column:
    return F.concat(text_or_empty(title), F.lit(" \n "), text_or_empty(description))


def squeezed(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    # Of ASCII only what isn't a single space is worth replacing.
    plain = lambda t: F.regexp_replace(t, r"\s{2,}|[\t-\r]", " ")
    return let(text, lambda t: F.trim(F.when(F.octet_length(t) == F.length(t), plain(t)).otherwise(F.regexp_replace(t, r"(?U)\s{2,}|[^\S ]", " "))))


def without_tags(text: Column) -> Column:
    return let(text_or_empty(text), lambda t: F.when(t.contains("<"), F.regexp_replace(t, "(?s)<[^>]+>", " ")).otherwise(t))


def numeric_entities(text: Column) -> Column:
    """&#123; and &#x1f; as characters; what names no character stays. Each step names its input by a variable, so that nothing is computed twice."""

    def read(part: Column, code: Column) -> Column:
        number = F.when(code.rlike("^[xX][0-9a-fA-F]+$"), F.conv(F.substring(code, 2, 7), 16, 10)).when(code.rlike("^[0-9]+$"), code).try_cast("long")
        known = lambda n: n.between(0, 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & (n != 0xFEFF)
        character = lambda n: F.when(n.between(1, 127), F.char(n)).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        rest = F.substr(part, F.length(code) + 2)
        return let(number, lambda n: F.when(F.coalesce(known(n), F.lit(False)), F.concat(character(n), rest)).otherwise(F.concat(F.lit("&#"), part)))

    def one(part: Column, place: Column) -> Column:
        code = F.regexp_extract(part, "^([xX]?[0-9a-zA-Z]{1,8});", 1)
        return F.when(place == 0, part).otherwise(let(code, lambda c: read(part, c)))

    return F.array_join(F.transform(F.split(text, "&#", -1), one), "")


def strip_html(text: Column, numeric: bool = True) -> Column:
    """Tags to spaces, character references to characters, runs of white space to one space; null becomes empty.

    Named references go by one table, so a result is not decoded again: "&amp;" is replaced last.
    """
    ordered = [x for x in vocab.ENTITIES.items() if x[0] != "&amp;"]

    def decoded(bare: Column) -> Column:
        named = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ordered, bare)
        if numeric:
            named = let(named, lambda n: F.when(n.contains("&#"), numeric_entities(n)).otherwise(n))
        return F.replace(named, F.lit("&amp;"), F.lit("&"))

    return squeezed(let(without_tags(text), lambda bare: F.when(bare.contains("&"), decoded(bare)).otherwise(bare)))


def named_entities(text: Column, names: dict[str, str]) -> Column:
    """&name; as the character that ``names`` gives it, in any case; once, so "&amp;lt;" becomes "&lt;". Unknown names stay."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def one(part: Column, place: Column) -> Column:
        # Known names are letters alone, so what ends at the first semicolon is one or none.
        decoded = lambda name: F.concat(F.try_element_at(known, F.lower(name)), F.substr(part, F.length(name) + 2))
        found = F.when(part.contains(";"), let(F.substring_index(part, ";", 1), decoded))
        return F.when(place == 0, part).otherwise(F.coalesce(found, F.concat(F.lit("&"), part)))

    return F.array_join(F.transform(F.split(text, "&", -1), one), "")


def display_text(text: Column, names: dict[str, str] | None = vocab.DISPLAY_ENTITIES) -> Column:
    """Tags to spaces, numeric and then named references to characters, runs of white space to one space; null becomes empty.

    Unlike strip_html() it keeps curly quotes. Without ``names`` references stay as they are.
    """
    bare = without_tags(text)
    if names is not None:
        numeric = lambda b: F.when(b.contains("&#"), numeric_entities(b)).otherwise(b)
        bare = let(bare, lambda b: F.when(b.contains("&"), named_entities(numeric(b), names)).otherwise(b))
    return squeezed(bare)


#: Lower-case letters, digits and spaces alone; each named, as a class of single characters is tried in one step.
PLAIN = r"^[abcdefghijklmnopqrstuvwxyz0123456789 ]*+\z"


def normalize_title(title: Column) -> Column:
    """Lower case, only a-z, 0-9 and single spaces, without the first of each known prefix that it starts with."""
    bare = lambda low: F.when(F.octet_length(low) == F.length(low), F.regexp_replace(low, r"[^a-z0-9\s]+", "")).otherwise(F.regexp_replace(low, r"(?U)[^a-z0-9\s]+", ""))
    # Most titles are plain already, which one look at each character tells.
    plain = lambda low: F.when(low.rlike(PLAIN) & ~low.contains("  "), F.trim(low)).otherwise(squeezed(let(low, bare)))
    # Punctuation is gone, so a prefix with a colon can't be there. Each step names its input once.
    known = [p for p in vocab.TITLE_PREFIXES if ":" not in p]
    cut = lambda t: F.when(reduce(lambda a, b: a | b, [t.startswith(p) for p in known]), F.regexp_replace(t, "^" + "".join(f"(?:{p})?" for p in known), "")).otherwise(t)
    return let(let(F.lower(text_or_empty(title)), plain), cut)


def event_id(venue_id: Column, start: Column, title: Column, norm: Column | None = None) -> Column:
    """venue-date-slug-digest; the slug goes if it is empty. The date is that of the raw start text.

    ``norm`` is normalize_title(title) where a column of its own holds it, so that it isn't computed twice.
    """
    date = F.substring(text_or_empty(start), 1, 10)
    norm = normalize_title(title) if norm is None else norm
    # Between letters and digits a normalized title has single spaces alone.
    slug = F.btrim(F.substring(F.replace(norm, F.lit(" "), F.lit("-")), 1, 40), F.lit("-"))
    digest = F.substring(F.sha1(F.concat_ws("|", venue_id, date, norm)), 1, 10)
    return F.concat_ws("-", venue_id, date, F.nullif(slug, F.lit("")), digest)


def with_event_id(rows: DataFrame, title: str = "title", salt: str = "", name: str = "id") -> DataFrame:
    """``rows`` with the id of venue_id, start and a title; the normalized title is computed once a row."""
    salted = F.concat(F.col(title), F.lit(salt)) if salt else F.col(title)
    kept = rows.withColumn("_norm", normalize_title(salted))
    return kept.withColumn(name, event_id(F.col("venue_id"), F.col("start"), salted, F.col("_norm"))).drop("_norm")


def ics_escape(text: Column) -> Column:
    pairs = [("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")]
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs, text_or_empty(text))


def ics_fold(line: Column, octets: int = 74) -> Column:
    """Folds a line at ``octets`` UTF-8 octets; each continuation starts with a space and no character is split."""
    # A letter for each octet: then patterns count octets, and 80 to BF are those that no cut may stand before.
    each = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    head = F.regexp_extract(each, f"(?s)^.{{1,{octets}}}(?![\\x80-\\xBF])", 0)
    rest = F.regexp_replace(F.substr(each, F.length(head) + 1), f"(?s)(.{{1,{octets - 1}}})(?![\\x80-\\xBF])", "\r\n $1")
    folded = F.decode(F.encode(F.concat(head, rest), "ISO-8859-1"), "UTF-8")
    return F.when(F.octet_length(line) <= octets, line).otherwise(folded)


def host(url: Column) -> Column:
    """The host of a URL without a leading www."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))


def social_links(socials: Column, order: tuple[str, ...] = ("instagram", "facebook", "twitter", "youtube", "tiktok")) -> Column:
    """(network, url) of the links in a map, in a fixed order; null and empty ones are left out."""
    each = F.array(*[F.struct(F.lit(k).alias("network"), F.try_element_at(socials, F.lit(k)).alias("url")) for k in order])
    return F.filter(each, lambda x: ~missing(x["url"]))


def directions_url(address: Column, base: str = "https://www.google.com/maps/dir/?api=1&destination=") -> Column:
    return F.concat(F.lit(base), F.url_encode(address))


def query_value(text: str) -> str:
    return quote(text, safe="")
