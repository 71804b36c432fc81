"""Raw documents that hold the star schema's listings, so that reading them must give the listings back.

A document holds the listings of one venue and a stretch of orders, so that none
grows with the data. Everything is made by joins, grouping and JSON functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from handbill.sources import star

#: Characters of ``seq`` that listings of one document share: a thousand orders.
STRETCH = 9
LINE, QUANTITY = "CAST(substr(seq, 14, 2) AS INT)", "CAST(substr(seq, 35, 3) AS INT)"


def line_of() -> Column:
    return F.substring("seq", 14, 2).cast("int")


def quantity_of() -> Column:
    return F.substring("seq", 35, 3).cast("int")


def pages(rows: DataFrame, item: Column, **more: Column) -> DataFrame:
    """(source_id, stretch, items, *more): the items of each venue and stretch in the order of ``seq``; ``more`` are aggregates."""
    grouped = rows.groupBy(F.col("venue_id").alias("source_id"), F.substring("seq", 1, STRETCH).alias("stretch"))
    return grouped.agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item"))))["item"].alias("items"), *[c.alias(k) for k, c in more.items()])


def document(rows: DataFrame, kind: str, body: Column) -> DataFrame:
    """Raw documents of pages()."""
    url = F.concat(F.lit("https://www.example.org/"), "source_id", F.lit("/"), "stretch")
    return rows.select("source_id", F.lit(kind).alias("kind"), url.alias("url"), F.col("stretch").cast("int").alias("page_no"), body.alias("body"), F.lit("1998-06-17").alias("fetched_at"))


def wall(text: Column, clock: str = "00:00:00") -> Column:
    """A start or end as "yyyy-mm-dd hh:mm:ss", its offset dropped."""
    return F.when(F.length(text) == 10, F.concat(text, F.lit(f" {clock}"))).otherwise(F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")))


def tribe(listings: DataFrame) -> DataFrame:
    """REST answers with marked-up descriptions, wall times and images as objects or false."""
    told = F.concat(F.lit("<p>"), F.col("description"), F.lit("</p>&nbsp;"))
    image = F.when(F.col("image").isNotNull(), F.concat(F.lit('{"url":"'), F.col("image"), F.lit('"}'))).otherwise("false")
    start, end = wall(F.col("start")), wall(F.col("end"))
    plain = F.to_json(F.struct(F.concat(F.lit(" "), "title").alias("title"), told.alias("description"), start.alias("start_date"), end.alias("end_date"), "url", F.col("price_text").alias("cost")))
    item = F.concat(F.expr("substr(_plain, 1, length(_plain) - 1)"), F.lit(',"image":'), image, F.lit("}"))
    rows = pages(listings.withColumn("_plain", plain), item)
    return document(rows, "wp_tribe", F.concat(F.lit('{"events":['), F.array_join("items", ","), F.lit("]}")))


def jsonld(listings: DataFrame) -> DataFrame:
    """Pages whose listings lie in lists and graphs nested two to twelve deep, beside objects that are no events."""
    kind = F.when(quantity_of() % 2 == 0, F.array(F.lit("Thing"), F.lit("schema:Event"))).otherwise(F.array(F.lit("http://schema.org/Event")))
    people = F.transform("artists", lambda a: F.struct(a.alias("name")))
    item = F.to_json(
        F.struct(
            kind.alias("@type"), F.col("title").alias("name"), F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("description"), F.col("start").alias("startDate"),
            F.col("end").alias("endDate"), F.array("url").alias("url"), F.struct(F.col("image").alias("url")).alias("image"), F.struct(F.lit("Hall").alias("name")).alias("location"), people.alias("performer"),
        )
    )
    rows = pages(listings, item)
    deep = ((F.col("stretch").cast("int") + F.substr("source_id", F.lit(2)).cast("int")) % 6 + 1).cast("int")
    nest = F.concat(F.repeat(F.lit('{"@type":"WebPage","about":{"@type":"Event","name":"not listed"},"@graph":[['), deep), F.array_join("items", ","), F.repeat(F.lit("]]}"), deep))
    body = F.concat(F.lit('<html><script type="application/ld+json">'), nest, F.lit("</script><script type='application/ld+json'>{broken</script></html>"))
    return document(rows, "jsonld", body)


def ical(listings: DataFrame) -> DataFrame:
    """Calendars with folded lines; times in local time, in UTC and in two zones, one of them far off."""
    digits = lambda c: F.regexp_replace(c, "[-: ]", "")

    def time(name: str, text: Column) -> Column:
        date, at = digits(F.substring(text, 1, 10)), wall(text)
        moved = lambda zone: F.convert_timezone(F.lit("America/Los_Angeles"), F.lit(zone), at.cast("timestamp_ntz"))
        stamp = lambda c: F.concat(digits(F.substring(c.cast("string"), 1, 10)), F.lit("T"), digits(F.substring(c.cast("string"), 12, 8)))
        zoned = (
            F.when(quantity_of() % 4 == 0, F.concat(F.lit(f"{name}:"), stamp(moved("UTC")), F.lit("Z"))).when(quantity_of() % 4 == 1, F.concat(F.lit(f'{name};TZID="Asia/Kathmandu":'), stamp(moved("Asia/Kathmandu"))))
            .when(quantity_of() % 4 == 2, F.concat(F.lit(f"{name};X=1;TZID=America/Los_Angeles:"), stamp(at.cast("timestamp_ntz")))).otherwise(F.concat(F.lit(f"{name}:"), stamp(at.cast("timestamp_ntz"))))
        )
        return F.when(F.length(text) == 10, F.concat(F.lit(f"{name};VALUE=DATE:"), date)).otherwise(zoned)

    title = F.concat(F.substring("title", 1, 5), F.lit("\r\n "), F.expr("substr(title, 6)"))
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("SUMMARY:"), title), time("DTSTART", F.col("start")), time("DTEND", F.col("end")), F.concat(F.lit("DESCRIPTION:"), F.replace("description", F.lit(" for "), F.lit(" for\\n"))),
        F.concat(F.lit("URL:"), "url"), F.lit("LOCATION:Hall\\; 2"), F.lit("END:VEVENT"),
    )
    rows = pages(listings, F.array_join(F.array_compact(lines), "\r\n"))
    return document(rows, "ical", F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join("items", "\r\n"), F.lit("\r\nEND:VCALENDAR")))


def xml_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def feeds(listings: DataFrame) -> DataFrame:
    """RSS for stretches of even number, with CDATA and mail dates, and Atom with a prefix for the others; listings without a time of publication too."""
    at = wall(F.col("start"), "12:00:00").cast("timestamp_ntz")
    mail = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss")
    one = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    told = F.concat(F.lit("<p>"), "description", F.lit("</p>"))
    rss = F.array(
        one("title", F.concat(F.lit("<![CDATA["), "title", F.lit("]]>"))), one("link", F.col("url")), one("description", xml_text(told)), one("pubDate", F.concat(mail, F.lit(" +0000"))),
    )
    atom = F.array(
        one("a:title", xml_text(F.col("title"))), F.lit('<a:link rel="self" href="https://www.example.org/self"/>'), F.concat(F.lit('<a:link href="'), "url", F.lit('"/>')), one("a:summary", F.concat(F.lit("<![CDATA["), told, F.lit("]]>"))),
        one("a:updated", F.concat(F.replace(F.substring(at.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))),
    )
    even = F.substring("seq", STRETCH, 1).cast("int") % 2 == 0
    item = F.when(even, one("item", F.array_join(F.array_compact(rss), ""))).otherwise(one("a:entry", F.array_join(F.array_compact(atom), "")))
    rows = pages(listings, item, even=F.first(even))
    whole = F.when(F.col("even"), F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>All</title>'), F.array_join("items", ""), F.lit("</channel></rss>")))
    whole = whole.otherwise(F.concat(F.lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>All</a:title>'), F.array_join("items", ""), F.lit("</a:feed>")))
    return document(rows, "feed", whole)


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every kind: all venues have a feed, other kinds are left out by the venue's number, so that each kind is some source's best."""
    rows = star.listings(spark, sf_dir)
    number = F.substr("venue_id", F.lit(2)).cast("long") % 4
    kinds = tribe(rows.where(number == 0)).unionByName(ical(rows.where(number <= 1))).unionByName(jsonld(rows.where(number <= 2)))
    return kinds.unionByName(feeds(rows))
