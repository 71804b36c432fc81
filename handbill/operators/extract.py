"""Extraction: table functions from raw documents to listings, all in SQL functions.

Input rows are raw documents (source_id, kind, url, body); output rows have the
listing's columns and ``kind``. A document that can't be read gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbill.functions import classify, dates, text, vocab
from handbill.operators import nested
from handbill.sources import storage

BLURB = 800
TRIBE = "struct<events:array<struct<title:string,description:string,start_date:string,end_date:string,url:string,image:string,cost:string>>>"
#: What listing() needs to know of a row's source.
SETTINGS = ("default_event_type", "id_salt", "label", "reshape")


def with_settings(documents: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``documents`` with all settings of their source; those of unknown or no sources have the defaults.

    ``sources`` is the source table, one row a source; Spark broadcasts it while it is small.
    """
    named = {"default_event_type": F.lit("other"), "id_salt": F.lit(""), "label": F.col("source_id"), "reshape": F.lit(True), "year_policy": F.lit("same"), "past_days": F.lit(14), "parser": F.lit("")}
    if sources is None:
        return documents.withColumns(named)
    own = sources.select(F.col("venue_id").alias("_source"), *[F.col(c).alias(f"_{c}") for c in named])
    joined = documents.drop(*named).join(own, F.col("source_id") == F.col("_source"), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", d) for c, d in named.items()}).drop("_source", *[f"_{c}" for c in named])


def listing(rows: DataFrame, hint: Column | None = None, all_day: Column | None = None, **given: Column) -> DataFrame:
    """Rows with the listing's raw columns; what isn't given is null or empty.

    Start and end become local time, the description loses its markup and is then
    cut, and the type comes from the words of both, else from ``hint``, else from
    the source. The id is made from all that, so it is the one that history has.
    """
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    columns = {
        "venue_id": F.col("source_id"), "title": F.col("_headed"), "_told": text.strip_html(given.get("description", none)),
        "_hint": F.lit("other") if hint is None else hint, "event_types": empty, "start": dates.to_local_iso(given.get("start", none)), "end": dates.to_local_iso(given.get("end", none)),
        "all_day": F.lit(False) if all_day is None else all_day, "url": given.get("url", none), "image": given.get("image", none), "location_override": given.get("location", none),
        "artists": given.get("artists", empty), "audience": empty, "source": F.col("label"), "is_free": F.lit(None).cast("boolean"),
        "price_text": none, "offers": given.get("offers", none), "cost": given.get("cost", none),
    }
    # A row without a title has no list to open: as a condition, all that the title is made of would be computed once more.
    titled = F.filter(F.array(F.trim(text.text_or_empty(given["title"]))), lambda t: t != "")
    out = rows.select("*", F.explode(titled).alias("_headed")).select("source_id", "kind", "seq", "default_event_type", "id_salt", "reshape", *[c.alias(k) for k, c in columns.items()])
    default = F.when(F.col("_hint") != "other", F.col("_hint")).otherwise(F.col("default_event_type"))
    out = out.withColumn("_words", classify.words_text(F.col("title"), F.col("_told")))
    out = out.withColumns({"event_type": classify.infer_type(F.col("title"), F.col("_told"), default, F.col("_words")), "description": F.substring("_told", 1, BLURB)})
    # A salt is part of the title that the id is made of, for exhibitions alone.
    out = out.withColumn("_named", F.when(F.col("event_type") == "exhibition", F.concat("title", "id_salt")).otherwise(F.col("title")))
    return text.with_event_id(out, "_named").drop("_named", "_told", "_words", "_hint", "default_event_type", "id_salt")


def opened(documents: DataFrame, kinds: list[str], inner: Column, name: str) -> DataFrame:
    """One row for each item of the documents of some kinds, in their order."""
    found = documents if "default_event_type" in documents.columns else with_settings(documents)
    rows = found.where(F.col("kind").isin(kinds))
    return rows.select("source_id", "kind", *SETTINGS, F.posexplode(inner).alias("seq", name))


def tribe(documents: DataFrame) -> DataFrame:
    """The events list of a calendar plugin's REST answer."""
    rows = opened(documents, ["wp_tribe"], F.from_json("body", TRIBE)["events"], "e")
    image = F.when(F.col("e.image").startswith("{"), F.get_json_object("e.image", "$.url"))
    return listing(
        rows, title=F.col("e.title"), description=F.col("e.description"), start=F.col("e.start_date"), end=F.col("e.end_date"),
        url=F.col("e.url"), image=image, cost=F.col("e.cost"),
    )


def one_text(value: Column, inner: str) -> Column:
    """A value that may be a text, an object with ``inner``, or a list of either: its first text."""
    first = F.when(value.startswith("["), F.get(F.from_json(value, "array<string>"), F.lit(0))).otherwise(value)
    return text.let(first, lambda v: F.when(v.startswith("{"), F.get_json_object(v, f"$.{inner}")).otherwise(v))


def names(value: Column) -> Column:
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.array_compact(F.transform(F.array_compact(listed), lambda v: F.when(v.startswith("{"), F.get_json_object(v, "$.name")).otherwise(v)))


#: What is read of an event, each a text, or JSON if it is none.
EVENT = "struct<`@type`:string,name:string,description:string,startDate:string,endDate:string,url:string,image:string,location:string,performer:string,performers:string,offers:string>"


def jsonld(documents: DataFrame, kinds: tuple[str, ...] = ("jsonld", "eventbrite")) -> DataFrame:
    """Events in the JSON-LD scripts of a page, in lists and graphs of any depth."""
    found = documents if "default_event_type" in documents.columns else with_settings(documents)
    rows = nested.events_of(found.where(F.col("kind").isin(*kinds)), "source_id", "kind", *SETTINGS)
    # Its own column: all fields are read at once.
    rows = rows.withColumn("e", F.from_json("node", EVENT)).drop("node")
    types = F.col("e.@type")
    first = F.when(types.startswith("["), F.get(F.from_json(types, "array<string>"), F.lit(0))).otherwise(types)
    none = F.array().cast("array<string>")
    performers = F.coalesce(names(F.col("e.performers")), none)
    artists = text.let(F.coalesce(names(F.col("e.performer")), none), lambda some: F.filter(F.when(F.size(some) > 0, some).otherwise(performers), lambda a: a != ""))
    place = F.col("e.location")
    location = F.when(place.startswith("{"), F.get_json_object(place, "$.name")).when(~place.startswith("["), place)
    return listing(
        rows, hint=classify.jsonld_type_hint(first), title=text.strip_html(F.col("e.name")),
        description=F.col("e.description"), start=F.col("e.startDate"), end=F.col("e.endDate"),
        url=one_text(F.col("e.url"), "url"), image=one_text(F.col("e.image"), "url"), location=location, artists=artists, offers=F.col("e.offers"),
    )


def ical_property(block: Column, name: str) -> Column:
    """The text of a property, its escapes resolved in one pass: an escaped backslash before n is no line end."""
    value = F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
    # Escaped backslashes wait as a character that no calendar text holds.
    held = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    plain = F.regexp_replace(F.regexp_replace(held, r"\\[nN]", "\n"), r"\\([,;:\"])", "$1")
    return F.nullif(F.replace(plain, F.lit("\x00"), F.lit("\\")), F.lit(""))


def ical_time(block: Column, name: str) -> Column:
    """20260822, 20260822T190000Z or a time with TZID as ISO text; a zone that no database knows is local, like none."""
    value = F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
    zone = F.regexp_extract(block, rf'(?m)^{name};(?:[^:\r\n]*;)?TZID="?([^":;\r\n]+)', 1)

    def timed(x: Column) -> Column:
        # Any zone that this JVM knows, by name; a text with an unknown one is no time and stays null.
        moved = F.when(x["zone"] != "", F.try_to_timestamp(F.concat_ws(" ", F.replace(x["wall"], F.lit("T"), F.lit(" ")), x["zone"]), F.lit("yyyy-MM-dd HH:mm:ss VV")))
        there = F.concat(F.replace(F.convert_timezone(F.current_timezone(), F.lit("UTC"), moved.cast("timestamp_ntz")).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
        return F.when(x["value"].endswith("Z"), F.concat(x["wall"], F.lit("Z"))).otherwise(F.coalesce(there, x["wall"]))

    def read(x: Column) -> Column:
        date = F.regexp_replace(x["value"], r"^(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3")
        at = lambda clock: F.concat(date, F.lit("T"), F.regexp_replace(clock, r"(\d{2})(\d{2})(\d{2})", "$1:$2:$3"))
        of = lambda clock: F.when(clock == "", date).otherwise(text.let(F.struct(x["value"].alias("value"), x["zone"].alias("zone"), at(clock).alias("wall")), timed))
        return F.when(x["value"] != "", text.let(F.regexp_extract(x["value"], r"^\d{8}T(\d{6})", 1), of))

    return text.let(F.struct(value.alias("value"), zone.alias("zone")), read)


def ical(documents: DataFrame) -> DataFrame:
    """The events of a calendar document; folded lines are joined first, repeat rules aren't expanded."""
    unfolded = F.regexp_replace("body", "\r?\n[ \t]", "")
    rows = opened(documents, ["ical"], F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), 1), "block")
    block = F.col("block")
    of = lambda name: ical_property(block, name)
    start = ical_time(block, "DTSTART")
    return listing(
        rows, all_day=F.coalesce(dates.is_date(start), F.lit(False)), title=of("SUMMARY"), description=of("DESCRIPTION"), start=start, end=ical_time(block, "DTEND"), url=of("URL"), location=of("LOCATION"),
    )


LINK = "array<struct<_href:string,_rel:string,_VALUE:string>>"
ENTRY = f"array<struct<title:string,link:{LINK},summary:string,description:string,pubDate:string,published:string,updated:string>>"
#: RSS has its items in a channel or, in its first form, beside it; Atom has entries.
FEED = f"struct<channel:struct<item:{ENTRY}>,item:{ENTRY},entry:{ENTRY}>"


def feed_entries(body: Column) -> Column:
    """The items of an RSS or Atom document read as XML, whatever its prefixes; null if it isn't well formed."""
    found = F.from_xml(body, FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true", "attributePrefix": "_", "valueTag": "_VALUE"})
    return text.let(found, lambda x: F.coalesce(x["channel"]["item"], x["item"], x["entry"]))


def loose_entries(body: Column) -> Column:
    """The same of a document that is no XML, by patterns: undeclared references and open tags don't hide its items."""

    def of(item: Column, tag: str) -> Column:
        return F.nullif(F.regexp_extract(item, rf"(?s)<{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1), F.lit(""))

    def entry(item: Column) -> Column:
        href = F.nullif(F.regexp_extract(item, r"""<link[^>]*href=["']([^"']+)""", 1), F.lit(""))
        link = F.array(F.struct(href.alias("_href"), F.lit(None).cast("string").alias("_rel"), of(item, "link").alias("_VALUE")))
        return F.struct(of(item, "title").alias("title"), link.alias("link"), *[of(item, t).alias(t) for t in ("summary", "description", "pubDate", "published", "updated")])

    return F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<(?:item|entry)[\s>].*?</(?:item|entry)>"), 0), entry)


def feed(documents: DataFrame) -> DataFrame:
    """The items of an RSS or Atom feed; the start is the time of publication."""
    rows = opened(documents, ["feed"], F.coalesce(feed_entries(F.col("body")), loose_entries(F.col("body"))), "item")
    of = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"item.{n}")), F.lit("")) for n in names])
    # The link of an entry is its text, or else the address of the one that stands for the entry itself.
    texts = F.array_compact(F.transform("item.link", lambda x: F.nullif(F.trim(x["_VALUE"]), F.lit(""))))
    hrefs = F.transform(F.filter("item.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), lambda x: x["_href"])
    link = F.coalesce(F.get(texts, F.lit(0)), F.get(F.array_compact(hrefs), F.lit(0)))
    return listing(rows, title=text.strip_html(of("title")), description=text.strip_html(of("summary", "description")), start=of("pubDate", "published", "updated"), url=link)


#: A parser of a source's own: the page's text and address to rows with any of CUSTOM's fields.
CUSTOM = "title string, description string, start string, `end` string, url string, image string, location string, cost string"


def custom(documents: DataFrame, parsers: dict[str, Callable[[str, str], Iterable[dict]]], kinds: tuple[str, ...] = ("custom",)) -> DataFrame:
    """Listings of the pages of sources with a parser of their own, named by the source's ``parser`` setting.

    A page is parsed in one task by the function registered under its source's
    name for it; a parser that fails on a page gives none of that page's rows. Pages of sources whose parser isn't registered give none.
    """
    fields = [f.split()[0].strip("`") for f in CUSTOM.split(", ")]
    found = documents.where(F.col("kind").isin(*kinds) & F.col("parser").isin(*parsers))
    storage.ship(documents.sparkSession)
    kept = ("source_id", "kind", *SETTINGS)
    rows = found.select(*kept, "parser", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("url", F.lit("")).alias("url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    given = list(parsers[row.parser](row.body, row.url))
                except Exception:  # whatever a source's own code trips over, other pages go on
                    given = []
                out += [[*(getattr(row, k) for k in kept), i, *(x.get(f) for f in fields)] for i, x in enumerate(given)]
            yield pd.DataFrame(out, columns=[*kept, "seq", *(f"_{f}" for f in fields)], dtype=object)

    schema = "source_id string, kind string, default_event_type string, id_salt string, label string, reshape boolean, seq int, " + CUSTOM.replace("`end`", "end").replace(", ", ", _")
    schema = schema.replace("seq int, title", "seq int, _title")
    parsed = rows.mapInPandas(run, schema)
    return listing(parsed, **{f: F.col(f"_{f}") for f in fields})


def next_data(body: Column, path: str = "$") -> Column:
    """The JSON that a page of a common web framework carries in its __NEXT_DATA__ script, from ``path`` on; null without one."""
    found = F.regexp_extract(body, r"""(?s)<script[^>]*\bid=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)
    return F.get_json_object(F.nullif(found, F.lit("")), path)


def json_value_after(body: Column, key: str) -> Column:
    """The JSON array or object after ``"key":`` in a text that is no JSON itself, by matching brackets; null if there is none, or no end.

    Brackets in strings don't count: strings are taken out of the way first, each
    replaced by as many other characters, so that places stay. The end is where the depth is 0 again.
    """
    strings = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    # A piece ends with a bracket, the last one with the text: a step each of those, whatever lies between.
    piece = rf"(?s)(?:[^\[\]{{}}\"]++|{strings}|\")*+(?:[\[\]{{}}]|\z)"

    def depth(a: Column, p: Column) -> Column:
        opens, closes = p.endswith("[") | p.endswith("{"), p.endswith("]") | p.endswith("}")
        step = F.struct((a["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"), (a["size"] + F.length(p)).alias("size"), (closes & (a["depth"] == 1)).alias("done"))
        return F.when(a["done"], a).otherwise(step)

    def cut(tail: Column) -> Column:
        none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))
        end = F.aggregate(F.regexp_extract_all(tail, F.lit(piece), F.lit(0)), none, depth, lambda a: F.when(a["done"], a["size"]))
        return F.substr(tail, F.lit(1), end)

    def value(rest: Column) -> Column:
        return text.let(F.substr(rest, F.length(F.regexp_extract(rest, rf'^"{key}"\s*:\s*', 0)) + 1), cut)

    place = lambda b: F.regexp_instr(b, F.lit(rf'"{key}"\s*:\s*[\[{{]'))
    return text.let(body, lambda b: text.let(place(b), lambda start: F.when(start > 0, text.let(F.substr(b, start), value))))


def rich_text(node: Column) -> Column:
    """The text of a JSON tree of paragraphs, marks and text leaves ({"nodeType": ..., "content": [...], "value": ...}), in order.

    Only a value beside a node type "text" counts: other fields named so are data, not text.
    """
    quoted = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    # Without their marks and data, leaves are the objects that hold no other.
    bare = F.regexp_replace(node, r'"(?:marks|data)"\s*:\s*(?:\[[^\[\]]*\]|\{\s*\})', '"_":null')
    leaves = F.regexp_extract_all(bare, F.lit(rf"(?s)\{{[^\"{{}}]*+(?:{quoted}[^\"{{}}]*+)*+\}}"), F.lit(0))
    options = {"allowUnquotedControlChars": "true"}
    one = lambda x: F.struct(F.get_json_object(x, "$.nodeType").alias("nodeType"), F.get_json_object(x, "$.value").alias("value"))

    def read(found: Column) -> Column:
        # All leaves are read at once; one without a type or with what may be a list is read by itself, and so are all if one is no JSON.
        together = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<struct<nodeType:string,value:string>>", options)
        sure = lambda x: x["nodeType"].isNotNull() & ~F.coalesce(x["value"].startswith("["), F.lit(False))
        each = lambda t: F.zip_with(found, t, lambda leaf, x: F.when(sure(x), x).otherwise(one(leaf)))
        return text.let(together, lambda t: F.when(F.size(t) == F.size(found), each(t)).otherwise(F.transform(found, one)))

    texts = F.transform(F.filter(text.let(leaves, read), lambda x: x["nodeType"] == "text"), lambda x: x["value"])
    return F.trim(F.regexp_replace(F.array_join(texts, " "), r"\s+", " "))


def all_strings(node: Column, skipped: tuple[str, ...] = ()) -> Column:
    """All text values of a JSON text, in order, but those of ``skipped`` keys."""
    inner = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
    one = f'"{inner}"'
    # A key with its text, a key of something else, or a text alone, in that order of preference.
    pairs = F.filter(F.regexp_extract_all(node, F.lit(rf"{one}(?:\s*:(?:\s*{one})?)?"), F.lit(0)), lambda p: ~p.endswith(":"))
    # Without escapes, quotes part a key from its text.
    escaped = lambda p: p.contains("\\")
    head = lambda p: F.substring_index(p, '"', 2)
    plain_key = lambda p: F.when(F.length(p) > F.length(head(p)) + 1, F.substring_index(head(p), '"', -1)).otherwise("")
    key = lambda p: F.when(escaped(p), F.regexp_extract(p, rf'^"({inner})"\s*:', 1)).otherwise(plain_key(p))
    kept = F.filter(pairs, lambda p: ~key(p).isin(*skipped)) if skipped else pairs
    read = lambda p: F.get_json_object(F.concat(F.lit('{"x":'), F.regexp_replace(p, rf'^{one}\s*:\s*', ""), F.lit("}")), "$.x")
    return F.transform(kept, lambda p: F.when(escaped(p), read(p)).otherwise(F.substring_index(F.substring_index(p, '"', -2), '"', 1)))


def pages_in_order(rows: DataFrame, key: str = "id", source: str = "source_id", page: str = "page_no", most: int = 12) -> DataFrame:
    """The rows of a source's numbered pages up to the first page that brings nothing new, each ``key`` once, where it came first.

    ``most`` pages are read, as a crawler would. Pages are few a source; the rows of a key are combined before they are shuffled.
    """
    read = rows.where(F.col(page) < most)
    first = read.groupBy(source, key).agg(F.min(page).alias("_first"))
    fresh = first.groupBy(source).agg(F.array_sort(F.collect_set("_first")).alias("_fresh"))
    # Page numbers from the first on without a gap: a page that brought nothing new ends them.
    run = F.aggregate("_fresh", F.lit(-1), lambda last, p: F.when(p == last + 1, p).otherwise(last))
    ends = fresh.select(F.col(source).alias("_source"), run.alias("_last"))
    marked = read.join(first.withColumnsRenamed({source: "_s", key: "_k"}), (F.col(source) == F.col("_s")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col(page) == F.col("_first")))
    kept = marked.join(ends, F.col(source) == F.col("_source")).where(F.col("_first") <= F.col("_last"))
    return kept.drop("_s", "_k", "_first", "_source", "_last").dropDuplicates([source, key])


def linked_pages(documents: DataFrame, most: int = 6, next_path: str = "$.links.next.href") -> DataFrame:
    """Documents that a chain of next links reaches from each source's page 0, ``most`` at most a source, with their ``step``.

    Links are joined page by page: as many joins as pages are allowed, each on (source, url).
    """
    pages = documents.select("source_id", "url", "body", "page_no", F.get_json_object("body", next_path).alias("_next"))
    at = pages.where("page_no = 0").select("source_id", "url", "body", "_next", F.lit(0).alias("step"))
    found = at
    for step in range(1, most):
        link = at.select(F.col("source_id").alias("_s"), F.col("_next").alias("_u")).where("_u IS NOT NULL").distinct()
        at = pages.join(link, (F.col("source_id") == F.col("_s")) & (F.col("url") == F.col("_u"))).select("source_id", "url", "body", "_next", F.lit(step).alias("step"))
        found = found.unionByName(at)
    first = found.groupBy("source_id", "url").agg(F.min("step").alias("step"), F.min_by("body", "step").alias("body"))
    return first.select("source_id", "url", "body", "step")


def with_details(rows: DataFrame, documents: DataFrame, keep_unmatched: bool = True, url: str = "url") -> DataFrame:
    """List rows joined to the detail document of their url, as ``detail``; rows without one stay unless told otherwise."""
    details = documents.groupBy(F.col("url").alias("_url")).agg(F.max_by("body", "fetched_at").alias("detail"))
    return rows.join(details, F.col(url) == F.col("_url"), "left" if keep_unmatched else "inner").drop("_url")


def strategy_chain(documents: DataFrame, custom: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """All listings of each source's first kind of document, in a fixed order of kinds, that gave any.

    ``custom`` holds listings of a source's own parser; ``sources`` the settings of each source.
    """
    found = of_every_kind(documents, custom, sources)
    best = found.groupBy("source_id").agg(F.min(priority()).alias("_best"))
    return found.join(best, "source_id").where(priority() == F.col("_best")).drop("_best")


def of_every_kind(documents: DataFrame, custom: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The listings of all documents, whatever their kind."""
    known = with_settings(documents, sources)
    found = tribe(known).unionByName(ical(known)).unionByName(jsonld(known)).unionByName(feed(known))
    return found if custom is None else found.unionByName(custom, allowMissingColumns=True)


def priority() -> Column:
    return F.array_position(F.array(*map(F.lit, vocab.STRATEGIES)), F.col("kind"))


def chain_outcomes(documents: DataFrame, custom: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """outcomes() of strategy_chain(), a kind at a time: documents of a kind are read only of sources that no kind before it gave any listing.

    What each source's kind gave is written on the way, so that Spark knows its size when it is joined.
    """
    spark, known = documents.sparkSession, with_settings(documents, sources)
    readers = {"wp_tribe": tribe, "ical": ical, "feed": feed} | {k: partial(jsonld, kinds=(k,)) for k in ("jsonld", "eventbrite")}
    path = storage.fresh_path(spark, "chain")
    schema = "source_id string, kind string, one_off bigint, exhibitions bigint"
    served = spark.createDataFrame([], schema)
    for kind in sorted(readers, key=vocab.STRATEGIES.index):
        outcomes(readers[kind](unserved(known.where(F.col("kind") == kind), served))).write.mode("append").parquet(path)
        served = spark.read.schema(schema).parquet(path)
    if custom is None:
        return served
    counts = served.unionByName(outcomes(custom)).groupBy("source_id", "kind").agg(F.sum("one_off").alias("one_off"), F.sum("exhibitions").alias("exhibitions"))
    best = counts.groupBy("source_id").agg(F.min_by(F.struct("kind", "one_off", "exhibitions"), priority()).alias("_best"))
    return best.select("source_id", "_best.*")


def unserved(rows: DataFrame, served: DataFrame) -> DataFrame:
    """``rows`` of sources that aren't in ``served``."""
    known = served.select(F.col("source_id").alias("_served"))
    return rows.join(known, F.col("source_id").eqNullSafe(F.col("_served")), "left_anti")


def outcomes(listings: DataFrame) -> DataFrame:
    """(source_id, kind, one_off, exhibitions): what each source's strategy gave, or each kind of its documents."""
    exhibition = F.col("event_type") == "exhibition"
    return listings.groupBy("source_id", "kind").agg(F.count_if(~exhibition).alias("one_off"), F.count_if(exhibition).alias("exhibitions"))


def carry_forward(nodes: DataFrame, group: str, pos: str, column: str) -> DataFrame:
    """``column`` of each node, or the last one before it in its document: how section headings date the rows below."""
    order = Window.partitionBy(group).orderBy(pos)
    return nodes.withColumn(column, F.last(column, ignorenulls=True).over(order))


def nights(rows: DataFrame, first: str, last: str, most: int = 8) -> DataFrame:
    """One row a night of a run of at most ``most`` days; longer runs stay one row."""
    span = F.datediff(last, first)
    each = F.when((span >= 0) & (span < most), F.sequence(F.col(first), F.col(last))).otherwise(F.array(F.col(first)))
    return rows.withColumn("night", F.explode(each))


SIGNALS = {
    "wordpress": ("/wp-content/", "/wp-json/"), "tribe-events": ("tribe-events", "tribe_events"), "drupal": ("drupal",), "ical-link": ("?ical=1",),
    "fullcalendar": ("fullcalendar",), "nextjs": ("next/data", "__next_data__"),
}


def profile(documents: DataFrame) -> DataFrame:
    """(source_id, documents, types, signals, sample): what each source's pages offer.

    ``types`` are all JSON-LD types, at any depth; ``sample`` is the first object that looks like an event.
    """
    storage.ship(documents.sparkSession)
    low = F.col("_low")
    seen = [F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(k)) for k, words in SIGNALS.items()]
    seen += [F.when(F.substring("body", 1, 500).contains("BEGIN:VCALENDAR"), F.lit("ical-direct")), F.when(low.rlike("<link[^>]+(rss|feed)"), F.lit("rss-link"))]
    merged = lambda kind: F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("_fact.kind") == kind, F.col("_fact.word"))))), ",")
    # Columns of their own: a body is put in lower case once, and one without the scripts' type has no need to leave the JVM.
    lowered = documents.withColumn("_low", F.lower("body")).withColumn("_seen", F.array_compact(F.array(*seen)))
    opened = lowered.withColumn("_read", nested.types_and_sample(F.when(low.contains("application/ld+json"), F.col("body"))))
    tagged = lambda kind, words: F.transform(words, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    # A row for the document, which the sample is beside, and one for each of its types and signals: few a source once counted.
    facts = F.concat(tagged("document", F.array(F.lit(""))), tagged("type", F.col("_read.types")), tagged("signal", F.col("_seen")))
    first = F.when(F.col("_read.sample").isNotNull(), F.struct("page_no", "_read.place", "_read.sample"))
    told = opened.select("source_id", first.alias("_first"), F.explode(facts).alias("_fact"))
    told = told.select("source_id", "_fact", F.when(F.col("_fact.kind") == "document", F.col("_first")).alias("_first"))
    counted = told.groupBy("source_id", "_fact").agg(F.count(F.lit(1)).alias("n"), F.min("_first").alias("_first"))
    return counted.groupBy("source_id").agg(
        F.sum(F.when(F.col("_fact.kind") == "document", F.col("n"))).alias("documents"), merged("type").alias("types"), merged("signal").alias("signals"), F.min("_first")["sample"].alias("sample"),
    )


def write_report(profiled: DataFrame, path: str) -> None:
    """profile()'s rows as Markdown, a section a source; the part files in the order of their names are the report."""
    shown = lambda c: F.when(F.col(c) == "", "(none)").otherwise(F.col(c))
    lines = [
        F.concat(F.lit("## "), F.col("source_id")), F.concat(F.lit("- documents: "), F.col("documents").cast("string")), F.concat(F.lit("- jsonld @types: "), shown("types")),
        F.concat(F.lit("- platform signals: "), shown("signals")), F.concat(F.lit("- first event-like JSON-LD object:\n```json\n"), F.col("sample"), F.lit("\n```")), F.lit(""),
    ]
    ordered = profiled.repartitionByRange("source_id").sortWithinPartitions("source_id")
    ordered.select(F.array_join(F.array_compact(F.array(*lines)), "\n").alias("value")).write.mode("overwrite").text(path)
