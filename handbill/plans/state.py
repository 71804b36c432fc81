"""Registered queries of time, state and place: free-form dates, sessions, merged tables, polygons."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handbill.functions import classify, dates, vocab
from handbill.operators import places, read_side, search, write_side
from handbill.plans.extraction import iso_sql, settings, winter_sql
from handbill.plans.sql import AMOUNTS, DESCRIBED, NOW, kinds_sql, pattern, query, quoted, range_sql, shown, window_sql, word_price_sql
from handbill.sources import landed, star
from handbill.sources.buckets import BucketedTable
from handbill.sources.storage import fresh_path
from handbill.sources.tables import chosen
from handbill.streaming import stream

TODAY = date(1998, 6, 17)
#: How many forms dates are written in, by the order's number.
FORMS = 13


def early_sql(at: str) -> str:
    return f"({at} - CASE WHEN {winter_sql(f'CAST({at} AS DATE)')} THEN INTERVAL 8 HOUR ELSE INTERVAL 7 HOUR END)"


@query(f""", o AS (SELECT o_orderkey, o_orderkey % {FORMS} AS form, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL (720 + (o_orderkey * 17) % 660) MINUTE AS moment FROM orders)
        SELECT o_orderkey, CASE WHEN form IN (0, 3, 11) THEN CAST(d AS VARCHAR) WHEN form IN (1, 2, 4, 7) THEN {iso_sql('moment')} WHEN form = 5 THEN {iso_sql(early_sql('moment'))}
            WHEN form = 6 THEN {iso_sql(f"(moment + CASE WHEN {winter_sql('CAST(moment AS DATE)')} THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END)")}
            WHEN form = 8 THEN CAST(TRY_CAST('1998' || strftime(d, '-%m-%d') AS DATE) AS VARCHAR) WHEN form = 9 THEN strftime(d, '%Y-%m-17')
            WHEN form = 10 THEN {iso_sql("date_trunc('hour', moment)")} END AS start FROM o""")
def free_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of all orders, each in one of thirteen forms, as local ISO text; the last form is no date."""
    form = F.col("o_orderkey") % FORMS
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    at = day + F.make_dt_interval(mins=(720 + (F.col("o_orderkey") * 17) % 660).cast("int"))
    told = lambda pattern: F.date_format(at, pattern)
    ordinal = F.concat(told("MMM d"), F.when(F.dayofmonth(day).isin(1, 21, 31), "st").when(F.dayofmonth(day).isin(2, 22), "nd").when(F.dayofmonth(day).isin(3, 23), "rd").otherwise("th"))
    patterns = {0: "EEEE, MMMM d, yyyy", 2: "d MMMM yyyy h:mma", 3: "M/d/yyyy", 4: "d-MMM-yy HH:mm", 5: "yyyy-MM-dd'T'HH:mm:ss'Z'", 6: "EEE, dd MMM yyyy HH:mm:ss '-0800'", 7: "yyyy/MM/dd h:mm 'p.m.'", 8: "MMMM d", 9: "MMMM yyyy", 10: "M/d/yy h a", 11: "yyyyMMdd", 12: "'the' d'th of' MMMM"}
    written = F.when(form == 1, F.concat(ordinal, told(", yyyy 'at' h:mm a")))
    for k, pattern in patterns.items():
        written = written.when(form == k, told(pattern))
    rows = star.table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return rows.select("o_orderkey", dates.to_local_iso(F.col("written"), TODAY).alias("start"))


@query("""SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM (
        SELECT *, sum(CASE WHEN ts - before <= INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
        SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, island""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a pause of over two hours."""
    rows = star.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = stream.sessions(rows, "user_id", gap="2 hours", errors=F.count_if(F.col("event_type") == "error"))
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n", "errors")


@query("""SELECT event_type, start, start + 21600 AS until, count(*) AS n FROM (SELECT event_type, (epoch_us(ts) // 7200000000 - unnest([0, 1, 2])) * 7200 AS start FROM events) GROUP BY ALL""")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in windows of six hours, a window every two."""
    rows = star.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = stream.sliding_counts(rows, "event_type", width="6 hours", slide="2 hours")
    return found.select("event_type", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("until"), "n")


RECORD = "id string, seq long, title string, description string, start string, end string, url string, image string, artists array<string>"


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of their customer, some richer than others."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    return star.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), key.alias("seq"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", F.lit("filled")).alias("description"), F.col("o_orderdate").cast("date").cast("string").alias("start"),
        none.alias("end"), F.when(key % 3 == 0, F.lit("url")).alias("url"), F.when(key % 5 == 0, F.lit("image")).alias("image"), F.array().cast("array<string>").alias("artists"),
    )


@query("""SELECT id, seq FROM (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY
        CAST(o_orderstatus = 'F' AS INT) + CAST(o_orderkey % 3 = 0 AS INT) + 2 * CAST(o_orderkey % 5 = 0 AS INT) DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest record of each customer after four batches of orders, the last of which comes twice."""
    table = BucketedTable(spark, fresh_path(spark, "bucket-merge"), "id", buckets=32)
    rows = order_records(spark, sf_dir)
    batch_of = F.pmod(F.col("seq"), F.lit(8))
    for batch, chosen_rows in enumerate((batch_of < 5, batch_of == 5, batch_of == 6, batch_of == 7)):
        table.merge(rows.where(chosen_rows), write_side.dedupe_richest, batch)
    table.merge(rows.where(batch_of == 7), write_side.dedupe_richest, 3)
    table.expire()
    return table.read(RECORD).select("id", "seq")


#: A ten-pointed outline in hundredths of a degree: neither convex nor along the axes.
OUTLINE = [(30, 0), (10, 7), (9, 29), (-4, 12), (-24, 18), (-12, 0), (-24, -18), (-4, -12), (9, -29), (10, -7)]
_EDGES = list(zip(OUTLINE, OUTLINE[1:] + OUTLINE[:1]))
_CROSSINGS = " + ".join(
    f"CAST(((cy + {b} > py) <> (cy + {d} > py)) AND px < (({c} - {a})::DOUBLE * (py - (cy + {b})) / {d - b if d != b else 1}::DOUBLE + (cx + {a})) AS INT)" for (a, b), (c, d) in _EDGES
)


@query(f"""SELECT c_custkey, n_name AS polygon FROM (SELECT c_custkey, ((c_custkey * 37) % 4000)::DOUBLE / 10 AS px, ((c_custkey * 91) % 3000)::DOUBLE / 10 AS py FROM customer),
        (SELECT n_name, (n_nationkey * 53 % 400)::DOUBLE AS cx, (n_nationkey * 71 % 300)::DOUBLE AS cy FROM nation) WHERE ({_CROSSINGS}) % 2 = 1""")
def polygon_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations' outlines, overlapping and not convex, hold each customer's place."""
    corner = lambda x, y: F.struct((F.col("n_nationkey") * 53 % 400 + x).cast("double").alias("x"), (F.col("n_nationkey") * 71 % 300 + y).cast("double").alias("y"))
    outlines = star.table(spark, sf_dir, "nation").select(F.col("n_name").alias("polygon"), F.array(*[corner(x, y) for x, y in OUTLINE]).alias("ring"))
    points = star.table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 4000).cast("double") / 10).alias("lng"), ((F.col("c_custkey") * 91 % 3000).cast("double") / 10).alias("lat"))
    return places.points_in(points, outlines, 8.0).select("c_custkey", "polygon")


@query(window_sql("1998-06-17 00:00:00", "1998-06-17 23:59:59.999"))
def event_filter_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """today, its past hours included."""
    return shown(read_side.filter_events(star.listings(spark, sf_dir), star.venues(spark, sf_dir), read_side.FilterSpec(date="today"), NOW))


@query(window_sql("1998-06-26 00:00:00", "1998-06-28 23:59:59.999"))
def event_filter_nextweekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the weekend after the coming one."""
    return shown(read_side.filter_events(star.listings(spark, sf_dir), star.venues(spark, sf_dir), read_side.FilterSpec(date="nextweekend"), NOW))


@query("""SELECT id AS venue_id, id IN (SELECT 'v' || s_suppkey FROM supplier) AS known FROM (SELECT 'v' || s_suppkey AS id FROM supplier UNION ALL SELECT 'v' || CAST(c_custkey + 1000000 AS VARCHAR) FROM customer)
        WHERE CAST(substr(id, 2) AS BIGINT) % 3 = 1""")
def chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sources asked for, those that can run and those whose venue isn't known."""
    known = settings(spark, sf_dir).select("venue_id")
    others = star.table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), (F.col("c_custkey") + 1000000).cast("string")).alias("venue_id"))
    asked = known.unionByName(others).where(F.substr("venue_id", F.lit(2)).cast("long") % 3 == 1)
    run, unknown = chosen(asked, star.venues(spark, sf_dir))
    return run.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


LIVE = "u_last >= TIMESTAMP '1998-06-17 12:00:00' OR u_last IS NULL"


@query(f"""SELECT venue_id, kind, seq, row_number() OVER (PARTITION BY venue_id, kind ORDER BY s_wall NULLS LAST, seq) AS place FROM (
        SELECT *, CASE WHEN event_type = 'exhibition' THEN 'exhibition' ELSE 'event' END AS kind FROM placed p JOIN venue v ON p.venue_id = v.id WHERE {LIVE})""")
def venue_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each venue's page lists: its events and its exhibitions that aren't over, in their order."""
    # Rows are kept while they are numbered: only what is asked for.
    rows = star.listings(spark, sf_dir).select("seq", "venue_id", "event_type", "start", "end")
    return read_side.venue_listings(rows, star.venues(spark, sf_dir).select("id", "name"), NOW).select("venue_id", "kind", "seq", "place")


SEARCHES = ["red", "Gallery TALK", " hall of ", "nation_1", "v1", "talk re", "no such words"]


@query(f"""SELECT query, seq FROM placed p LEFT JOIN venue v ON p.venue_id = v.id, (SELECT unnest([{", ".join(map(quoted, SEARCHES))}]) AS query, unnest([{", ".join(quoted(q.strip().lower()) for q in SEARCHES)}]) AS q)
        WHERE contains(lower(title), q) OR contains(lower(coalesce(description, '')), q) OR contains(venue_id, q) OR contains(lower(coalesce(v.name, '')), q)
           OR contains(lower(coalesce(v.neighborhood, '')), q) OR contains(lower(coalesce(array_to_string(v.aliases, chr(10)), '')), q) OR (has_artist AND contains(lower(brand), q))""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several searches over one index of all listings and their venues."""
    path = fresh_path(spark, "search-index")
    rows = read_side.with_venues(star.listings(spark, sf_dir), star.venues(spark, sf_dir), "left")
    search.write_index(rows, "seq", search.event_texts(rows), path, buckets=16)
    return search.find_all(spark, path, SEARCHES, buckets=16).select("query", F.col("key").alias("seq"))


COST = """CASE WHEN lower(trim(own_price)) = 'free' OR (len(a) > 0 AND list_max(a) = 0) THEN {free} WHEN len(a) > 0 THEN {some} END"""


@query(f""", told AS (SELECT *, {landed.LINE} % 2 = 1 AS costed, {DESCRIBED} AS t, {kinds_sql()} AS kinds FROM listing),
        paid AS (SELECT key AS seq, CASE WHEN costed THEN {COST.format(free="true", some="NULL")} ELSE w.is_free END AS is_free, CASE WHEN costed THEN {COST.format(free="'Free'", some=range_sql("a"))} ELSE w.price_text END AS price_text
            FROM (SELECT seq AS key, costed, price_text AS own_price, {AMOUNTS.format(t="trim(price_text)")} AS a FROM told) JOIN (SELECT key AS k, is_free, price_text FROM ({word_price_sql(f"SELECT seq AS key, {DESCRIBED} AS t FROM listing")})) w(k, is_free, price_text) ON key = k)
        SELECT told.seq, CASE WHEN event_type = 'exhibition' THEN 'exhibition' ELSE array_to_string(list_concat([event_type], list_filter(string_split(kinds, ','), lambda x: x <> 'exhibition' AND x <> event_type AND x <> '')), ',') END AS event_types,
        CASE WHEN told.family THEN 'family' ELSE concat_ws(',', CASE WHEN regexp_matches(t, {pattern(vocab.FAMILY_WORDS)}, 'i') THEN 'family' END, CASE WHEN regexp_matches(t, {pattern(vocab.TEEN_WORDS)}, 'i') THEN 'teen' END) END AS audience,
        paid.is_free OR (paid.is_free IS NULL AND paid.price_text = 'Free') AS is_free, paid.price_text, coalesce(length(start) = 10, false) AS all_day FROM told JOIN paid ON told.seq = paid.seq""")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published form of raw rows, whose price is a cost text or must be read from their words."""
    rows = star.listings(spark, sf_dir)
    cost = F.when(landed.line_of() % 2 == 1, F.col("price_text"))
    none = {"is_free": F.lit(None).cast("boolean"), "price_text": F.lit(None).cast("string"), "all_day": F.lit(False), "event_types": F.array().cast("array<string>")}
    found = write_side.normalize(rows.withColumn("cost", cost).withColumns(none))
    return found.select("seq", F.array_join("event_types", ",").alias("event_types"), F.array_join("audience", ",").alias("audience"), "is_free", "price_text", "all_day")


@query(f"""SELECT seq, array_to_string(list_filter(list_distinct_in_order, lambda x: x IS NOT NULL), ',') AS labels FROM (SELECT seq, CASE WHEN event_type = 'other' THEN ['Other'] WHEN {landed.LINE} % 2 = 0 THEN [upper(event_type[1]) || event_type[2:], 'Other'] ELSE [upper(event_type[1]) || event_type[2:]] END AS list_distinct_in_order FROM listing)""")
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display labels, distinct and in order; fair and other are one, unknown types have none."""
    more = F.when(landed.line_of() % 2 == 0, F.array(F.lit("fair"), F.lit("no such type"), F.lit("other"))).otherwise(F.array(F.lit("no such type")))
    types = F.concat(F.array("event_type"), more)
    return star.listings(spark, sf_dir).select("seq", F.array_join(classify.display_labels(types), ",").alias("labels"))


OLD = "u_last < TIMESTAMP '1998-06-17 12:00:00'"


@query(f"""SELECT seq, row_number() OVER (ORDER BY s_wall DESC NULLS FIRST, seq DESC) AS place FROM placed p LEFT JOIN venue v ON p.venue_id = v.id WHERE {OLD} AND
        (contains(lower(title), 'blue') OR contains(lower(coalesce(description, '')), 'blue') OR contains(venue_id, 'blue') OR contains(lower(coalesce(v.name, '')), 'blue') OR contains(lower(coalesce(v.neighborhood, '')), 'blue')
         OR contains(lower(coalesce(array_to_string(v.aliases, chr(10)), '')), 'blue') OR (has_artist AND contains(lower(brand), 'blue')))""")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive with a query text."""
    return read_side.archive_view(star.listings(spark, sf_dir), star.venues(spark, sf_dir), NOW, "Blue").select("seq", "place")


@query(f"""SELECT seq FROM placed WHERE CAST(substr(seq, 17, 9) AS INT) % 5 = 0 AND (NOT coalesce({OLD}, false) OR (event_type = 'exhibition' AND NOT regexp_matches(title, {pattern(vocab.NON_EXHIBITION_TITLE)}, 'i')
        AND s_wall <= TIMESTAMP '1998-06-17' AND e_wall >= TIMESTAMP '1998-06-17' AND epoch(e_wall) - epoch(s_wall) <= {vocab.PERMANENT_DAYS} * 86400))""")
def saved_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user saved, among upcoming listings and exhibitions on view."""
    rows = star.listings(spark, sf_dir)
    ids = rows.where(F.substring("seq", 17, 9).cast("int") % 5 == 0).select("seq")
    return read_side.saved(rows, ids, NOW, "seq").select("seq")


@query("SELECT 'v' || l_suppkey AS venue_id, max(strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S+00:00')) AS scraped_at FROM lineitem GROUP BY ALL")
def last_scraped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's latest reading."""
    rows = star.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("venue_id"), F.date_format(F.col("l_shipdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("scraped_at"))
    return read_side.latest_scrape(rows)


@query("SELECT seq, row_number() OVER (ORDER BY coalesce(start, ''), title, seq) AS place FROM listing WHERE event_type <> 'exhibition'")
def published_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-off listings in the order in which they are published."""
    rows = write_side.one_off(star.listings(spark, sf_dir)).select("seq", "start", "title")
    return read_side.numbered(rows, read_side.by_start_text()).select("seq", "place")


@query("SELECT id, lng BETWEEN -118.56::DOUBLE AND -118.10::DOUBLE AND lat BETWEEN 33.73::DOUBLE AND 34.20::DOUBLE AS in_view FROM venue")
def default_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which venues the map's first view shows."""
    return read_side.default_view(star.venues(spark, sf_dir))
