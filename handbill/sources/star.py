"""Venues and listings drawn from a star schema (lineitem, orders, part, supplier, nation, region).

It gives the engine's queries tables of any scale. SQL_TABLES is the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handbill.functions import text

PHRASES = {
    "STANDARD": ("Gallery talk", "lecture"), "ECONOMY": ("Film screening", "screening"), "MEDIUM": ("Family workshop", "workshop"),
    "SMALL": ("Daily tour", "tour"), "LARGE": ("Opening reception", "other"), "PROMO": ("Exhibition", "exhibition"),
}
VENUE_KINDS = ("museum", "community", "alternative", "academic")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kinds = F.array(*map(F.lit, VENUE_KINDS))
    return rows.select(
        F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.get(kinds, (F.col("s_suppkey") % 4).cast("int")).alias("type"), F.col("r_name").alias("region"), F.col("n_name").alias("neighborhood"),
        F.concat(F.col("s_suppkey").cast("string"), F.lit(" Main St")).alias("address"),
        F.when(F.col("s_suppkey") % 10 == 0, F.array(F.lit("Red Hall"), F.concat(F.lit("Hall of "), F.col("n_name")))).alias("aliases"),
        (F.lit(-118.95) + F.pmod(F.col("s_suppkey") * 13, F.lit(140)) / 100).alias("lng"),
        (F.lit(33.6) + F.pmod(F.col("s_suppkey") * 7, F.lit(130)) / 100).alias("lat"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing a lineitem. Spans of 0 to 588 days, some without start or end; rows may be equal but for ``seq``."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    line, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    pick = lambda i: F.try_element_at(F.create_map(*[x for k, v in PHRASES.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("p_type"))
    first = F.col("o_orderdate").cast("date")
    last = F.date_add(first, F.when(quantity <= 10, quantity - 1).otherwise((quantity - 1) * 12))
    told = lambda d, clock: F.when(line % 2 == 0, d.cast("string")).otherwise(F.concat(d.cast("string"), F.lit(clock)))
    note = F.when(F.col("l_returnflag") == "R", ". Free admission for families.").when(F.col("l_returnflag") == "A", ". Tickets $12 or free for members.").otherwise(".")
    digits = lambda c, n: F.lpad(c.cast("bigint").cast("string"), n, "0")
    out = rows.select(
        F.concat_ws("-", digits(F.col("l_orderkey"), 12), digits(line, 2), digits(F.col("l_partkey"), 9), digits(F.col("l_suppkey"), 7), digits(quantity, 3), digits(F.round(F.col("l_extendedprice") * 100), 12)).alias("seq"),
        F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("venue_id"), F.concat(pick(0), F.lit(" "), F.col("p_name")).alias("title"),
        F.when(line != 4, F.concat(F.lit("By "), F.col("p_brand"), note)).alias("description"), pick(1).alias("event_type"),
        F.when(line != 7, told(first, "T19:00:00-07:00")).alias("start"),
        F.when((line != 5) & ~((line == 7) & (quantity <= 10)), told(last, "T21:00:00-07:00")).alias("end"),
        F.when(line != 3, F.concat(F.lit("https://www.example.org/"), F.col("l_orderkey").cast("string"))).alias("url"),
        F.when(F.col("l_linestatus") != "O", F.lit("image.jpg")).alias("image"),
        F.when(F.col("l_discount") == 0, F.lit(True)).when(F.col("l_discount") > 0.08, F.lit(False)).alias("is_free"),
        F.when(F.col("l_discount") == 0, F.lit("Free")).otherwise(F.concat(F.lit("$"), F.floor("l_extendedprice").cast("string"))).alias("price_text"),
        F.when(F.col("l_tax") > 0.04, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("artists"),
        F.when(F.col("p_type") == "MEDIUM", F.array(F.lit("family"))).otherwise(F.array().cast("array<string>")).alias("audience"),
    )
    return text.with_event_id(out).withColumns(
        {
            "event_types": F.array("event_type"),
            "all_day": F.coalesce(~F.col("start").contains("T"), F.lit(False)), "location_override": F.lit(None).cast("string"),
        }
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(venue_id, day, success): one run a user and day of the event stream; it fails if all its rows are errors."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("venue_id"), F.col("ts").cast("date").cast("string").alias("day"), (F.col("event_type") != "error").alias("ok"))
    return rows.groupBy("venue_id", "day").agg(F.bool_or("ok").alias("success"))


def _case(i: int) -> str:
    return "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in PHRASES.items()) + " END"


SQL_TABLES = f"""
venue AS (
    SELECT 'v' || s_suppkey AS id, s_name AS name, ['museum', 'community', 'alternative', 'academic'][(s_suppkey % 4) + 1] AS type, r_name AS region,
           n_name AS neighborhood, s_suppkey || ' Main St' AS address,
           CASE WHEN s_suppkey % 10 = 0 THEN ['Red Hall', 'Hall of ' || n_name] END AS aliases,
           CAST(-118.95 AS DOUBLE) + CAST((s_suppkey * 13) % 140 AS DOUBLE) / 100 AS lng, CAST(33.6 AS DOUBLE) + CAST((s_suppkey * 7) % 130 AS DOUBLE) / 100 AS lat
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), raw AS (
    SELECT *, CAST(l_quantity AS INT) AS q, CAST(o_orderdate AS DATE) AS d1,
           CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN l_quantity <= 10 THEN l_quantity - 1 ELSE (l_quantity - 1) * 12 END AS INT) AS DATE) AS d2
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), listing AS (
    SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' ||
           lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || '-' || lpad(CAST(q AS VARCHAR), 3, '0') || '-' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') AS seq,
           'v' || l_suppkey AS venue_id, {_case(0)} || ' ' || p_name AS title,
           CASE WHEN l_linenumber <> 4 THEN 'By ' || p_brand || CASE l_returnflag WHEN 'R' THEN '. Free admission for families.' WHEN 'A' THEN '. Tickets $12 or free for members.' ELSE '.' END END AS description,
           {_case(1)} AS event_type,
           CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN CAST(d1 AS VARCHAR) ELSE d1 || 'T19:00:00-07:00' END AS start,
           CASE WHEN l_linenumber = 5 OR (l_linenumber = 7 AND q <= 10) THEN NULL WHEN l_linenumber % 2 = 0 THEN CAST(d2 AS VARCHAR) ELSE d2 || 'T21:00:00-07:00' END AS "end",
           CASE WHEN l_linenumber <> 3 THEN 'https://www.example.org/' || l_orderkey END AS url, CASE WHEN l_linestatus <> 'O' THEN 'image.jpg' END AS image,
           CASE WHEN l_discount = 0 THEN true WHEN l_discount > 0.08 THEN false END AS is_free,
           CASE WHEN l_discount = 0 THEN 'Free' ELSE '$' || CAST(floor(l_extendedprice) AS BIGINT) END AS price_text,
           l_tax > 0.04 AS has_artist, p_brand AS brand, p_type = 'MEDIUM' AS family
    FROM raw
), timed AS (
    SELECT *, TRY_CAST(replace(substr(start, 1, 19), 'T', ' ') AS TIMESTAMP) AS s_wall, TRY_CAST(replace(substr("end", 1, 19), 'T', ' ') AS TIMESTAMP) AS e_wall,
           coalesce("end", start) AS u, TRY_CAST(replace(substr(coalesce("end", start), 1, 19), 'T', ' ') AS TIMESTAMP) AS u_wall
    FROM listing
), placed AS (
    SELECT *, CASE WHEN length(u) = 10 THEN u_wall + INTERVAL 86399999 MILLISECONDS ELSE u_wall END AS u_last,
           CASE WHEN length(start) = 10 THEN s_wall ELSE s_wall + INTERVAL 7 HOURS END AS s_utc, CASE WHEN length("end") = 10 THEN e_wall ELSE e_wall + INTERVAL 7 HOURS END AS e_utc
    FROM timed
)"""
