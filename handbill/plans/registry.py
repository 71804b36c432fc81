"""All registered queries of the listings engine, with the SQL that each must agree with.

The queries run the operators over the star schema's listings as of a fixed
Wednesday; results hold plain columns, lists as joined text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handbill.functions import classify, dates, price, text, vocab
from handbill.operators import extract, feeds, read_side, write_side
from handbill.plans.sql import (  # noqa: F401
    AMOUNTS, DESCRIBED, LIVE, NOW, NOW_UTC, QUERIES, SHOWN, SQL, SUNDAY, TYPES, after, escaped_sql, id_sql, kind_sql, kinds_sql, money_sql, norm_sql, pattern, query, quoted, range_sql, shown, window_sql, word_price_sql,
)
from handbill.sources import star

# Filters, windows and searches


@query(window_sql("1998-06-17 12:00:00", "1998-06-24 23:59:59.999"))
def event_filter_next7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What overlaps the next seven days."""
    return shown(read_side.filter_events(star.listings(spark, sf_dir), star.venues(spark, sf_dir), read_side.FilterSpec(), NOW))


@query(window_sql("1998-06-19 00:00:00", "1998-06-21 23:59:59.999"))
def event_filter_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the coming weekend, from its Friday on."""
    return shown(read_side.filter_events(star.listings(spark, sf_dir), star.venues(spark, sf_dir), read_side.FilterSpec(date="weekend"), NOW))


@query(window_sql("1998-06-21 10:00:00", "1998-06-21 23:59:59.999", "1998-06-21 10:00:00"))
def event_filter_sunday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 on a Sunday: its Friday is past, so the weekend starts now."""
    return shown(read_side.filter_events(star.listings(spark, sf_dir), star.venues(spark, sf_dir), read_side.FilterSpec(date="weekend"), SUNDAY))


@query(window_sql("1998-07-01 00:00:00", "1998-07-04 23:59:59.999", more="AND is_free IS NOT DISTINCT FROM true AND family AND v.type IN ('museum', 'academic') AND v.region IN ('ASIA', 'EUROPE') AND event_type IN ('workshop', 'lecture')"))
def event_filter_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets with a window of the user's own."""
    spec = read_side.FilterSpec(venue_types=("museum", "academic"), regions=("ASIA", "EUROPE"), chips=("workshop", "lecture"), date="custom", start="1998-07-01", end="1998-07-04", free=True, family=True)
    return shown(read_side.filter_events(star.listings(spark, sf_dir), star.venues(spark, sf_dir), spec, NOW))


@query(f"""SELECT v.id, v.name, v.type, v.region FROM venue v WHERE type IN ('museum', 'community') AND region IN ('ASIA', 'AFRICA', 'EUROPE')
        AND id IN (SELECT venue_id FROM placed WHERE event_type <> 'exhibition' AND {LIVE})""")
def venue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues by type and region that have something on."""
    some = read_side.eventful(star.listings(spark, sf_dir), NOW)
    return read_side.filter_venues(star.venues(spark, sf_dir), ("museum", "community"), ("ASIA", "AFRICA", "EUROPE"), some).select("id", "name", "type", "region")


@query(f"SELECT DISTINCT venue_id FROM placed WHERE event_type <> 'exhibition' AND {LIVE}")
def eventful_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J07, A14."""
    return read_side.eventful(star.listings(spark, sf_dir), NOW)


@query(f"""SELECT {SHOWN} FROM placed LEFT JOIN venue v ON venue_id = v.id
        WHERE contains(lower(title), 'red') OR contains(lower(coalesce(description, '')), 'red') OR contains(venue_id, 'red') OR contains(lower(coalesce(v.name, '')), 'red')
           OR contains(lower(coalesce(v.neighborhood, '')), 'red') OR len(list_filter(v.aliases, lambda x: contains(lower(x), 'red'))) > 0 OR (has_artist AND contains(lower(brand), 'red'))""")
def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, J03."""
    return shown(read_side.search_events(star.listings(spark, sf_dir), star.venues(spark, sf_dir), " Red "))


@query("SELECT id, name FROM venue WHERE len(list_filter(aliases, lambda x: contains(lower(x), 'hall of'))) > 0")
def search_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only a venue's other names hold."""
    return read_side.search_venues(star.venues(spark, sf_dir), "hall OF").select("id", "name")


@query("SELECT id, name FROM venue WHERE contains(lower(name), 'nation_1') OR contains(lower(neighborhood), 'nation_1') OR contains(lower(address), 'nation_1') OR contains(id, 'nation_1') OR len(list_filter(aliases, lambda x: contains(lower(x), 'nation_1'))) > 0")
def search_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    return read_side.search_venues(star.venues(spark, sf_dir), "NATION_1").select("id", "name")


# Scalars


@query(f"SELECT seq, {id_sql('venue_id', 'start', 'title')} AS id, {id_sql('venue_id', 'start', chr(40) + 'title || ' + quoted('::exh') + chr(41))} AS salted_id FROM listing")
def event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C01, C03."""
    rows = text.with_event_id(star.listings(spark, sf_dir), salt="::exh", name="salted_id")
    return rows.select("seq", "id", "salted_id")


TITLES = ["Opening Reception for X!", "Opening: X", "  Closing reception for  The   Blue—Door ", "", "Lecture: A & B", "exhibition: Über 12"]


@query(f"SELECT t AS title, {norm_sql('t')} AS norm FROM (SELECT title AS t FROM listing UNION ALL SELECT unnest([{', '.join(map(quoted, TITLES))}]))")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C02."""
    more = spark.createDataFrame([(t,) for t in TITLES], "title string")
    return star.listings(spark, sf_dir).select("title").unionByName(more).select("title", text.normalize_title(F.col("title")).alias("norm"))


@query(f"SELECT seq, {kind_sql()} AS kind, {kind_sql('event_type')} AS kind_or_own FROM listing")
def infer_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    words = classify.words_text(F.col("title"), F.col("description"))
    rows = star.listings(spark, sf_dir).select("seq", "event_type", classify.worded_type(words).alias("found"))
    return rows.select("seq", classify.type_or(F.col("found"), "other").alias("kind"), classify.type_or(F.col("found"), F.col("event_type")).alias("kind_or_own"))


@query(f"""SELECT seq, kinds, CASE WHEN event_type = 'exhibition' THEN 'exhibition' ELSE array_to_string(list_concat([event_type], list_filter(string_split(kinds, ','), lambda x: x <> 'exhibition' AND x <> event_type AND x <> '')), ',') END AS final
        FROM (SELECT seq, event_type, {kinds_sql()} AS kinds FROM listing)""")
def infer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, F20b."""
    rows = star.listings(spark, sf_dir)
    rows = rows.select("seq", "event_type", "event_types", classify.words_text(F.col("title"), F.col("description")).alias("words"))
    rows = rows.select("seq", "event_type", "event_types", classify.infer_all(F.lit(None), F.lit(None), F.col("words")).alias("kinds"))
    final = classify.final_types(F.col("event_type"), F.col("event_types"), F.col("kinds"))
    return rows.select("seq", F.array_join("kinds", ",").alias("kinds"), F.array_join(final, ",").alias("final"))


NOTES = ["the artist's family", "Family Workshop", "kids' families day", "Teen night for youth", "all-ages", "high school", "artists' family", ""]


@query(f"""SELECT t AS note, concat_ws(',', CASE WHEN regexp_matches(regexp_replace(t, '(''s |s'' )(family|families)', '', 'gi'), {pattern(vocab.FAMILY_WORDS)}, 'i') THEN 'family' END,
        CASE WHEN regexp_matches(t, {pattern(vocab.TEEN_WORDS)}, 'i') THEN 'teen' END) AS audience
        FROM (SELECT {DESCRIBED} AS t FROM listing UNION ALL SELECT x || ' ' || chr(10) || ' ' FROM (SELECT unnest([{', '.join(map(quoted, NOTES))}]) AS x))""")
def audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21."""
    more = spark.createDataFrame([(t, None) for t in NOTES], "title string, description string")
    rows = star.listings(spark, sf_dir).select("title", "description").unionByName(more)
    return rows.select(text.described(F.col("title"), F.col("description")).alias("note"), F.array_join(classify.infer_audience(F.col("title"), F.col("description")), ",").alias("audience"))


@query(word_price_sql(f"SELECT seq AS key, {DESCRIBED} AS t FROM listing"))
def price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, F18, A13."""
    found = price.infer_price(F.col("title"), F.col("description"))
    return star.listings(spark, sf_dir).select(F.col("seq").alias("key"), found["is_free"].alias("is_free"), found["price_text"].alias("price_text"))


COSTS = ["Free", "free ", "$10", "$10 – $25", "$0", "0.00", "10", "", "$7.50 / $12", "from $ 5", "$0 - $0"]


@query(f"""SELECT c AS cost, CASE WHEN lower(trim(c)) IN ('0', 'free', '$0', '0.00', '$0.00') OR (len(a) > 0 AND list_max(a) = 0) THEN true END AS is_free,
        CASE WHEN lower(trim(c)) IN ('0', 'free', '$0', '0.00', '$0.00') OR (len(a) > 0 AND list_max(a) = 0) THEN 'Free' WHEN len(a) > 0 THEN {range_sql('a')} END AS price_text
        FROM (SELECT c, {AMOUNTS.format(t='trim(c)')} AS a FROM (SELECT unnest([{', '.join(map(quoted, COSTS))}]) AS c UNION ALL SELECT price_text FROM listing))""")
def parse_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15."""
    rows = spark.createDataFrame([(c,) for c in COSTS], "cost string").unionByName(star.listings(spark, sf_dir).select(F.col("price_text").alias("cost")))
    found = price.parse_cost(F.col("cost"))
    return rows.select("cost", found["is_free"].alias("is_free"), found["price_text"].alias("price_text"))


@query("""SELECT seq, CASE WHEN l IN (1, 2) AND p = 0 THEN true WHEN l = 1 AND p = 1 THEN false WHEN l = 3 THEN true WHEN l = 5 AND q <= 10 THEN false END AS is_free,
        CASE WHEN l IN (1, 2) AND p = 0 THEN 'Free' WHEN l = 1 AND p = 1 THEN '$0–$20' WHEN l = 3 THEN '$5' WHEN l IN (1, 2) THEN '$' || (p * 10)
             WHEN l = 5 AND q <= 10 THEN '$0–$' || (1000 + q) WHEN l = 5 THEN '$' || q || '.50–$' || (1000 + q) END AS price_text
        FROM (SELECT seq, CAST(substr(seq, 14, 2) AS INT) AS l, CAST(substr(seq, 17, 9) AS INT) % 3 AS p, CAST(substr(seq, 35, 3) AS INT) AS q FROM listing)""")
def parse_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of all listings, offers as an object, as a list with a free tier, with a flag, as a range, unreadable, empty and null."""
    line, p, quantity = F.substring("seq", 14, 2).cast("int"), F.substring("seq", 17, 9).cast("int") % 3, F.substring("seq", 35, 3).cast("int")
    amount = (p * 10).cast("string")
    tiers = F.when(p == 1, F.lit('[{"price":0},{"price":"$20"}]')).otherwise(F.concat(F.lit('[{"lowPrice":"'), amount, F.lit('"}]')))
    offers = F.when(line == 1, tiers).when(line == 2, F.concat(F.lit('{"price":"'), amount, F.lit('"}'))).when(line == 3, F.lit('{"price":"5","isAccessibleForFree":true}'))
    low = F.when(quantity <= 10, F.lit("0")).otherwise(F.concat(quantity.cast("string"), F.lit(".5")))
    ranged = F.concat(F.lit('{"lowPrice":'), low, F.lit(',"highPrice":"$1,'), F.lpad(quantity.cast("string"), 3, "0"), F.lit('"}'))
    offers = offers.when(line == 5, ranged).when(line == 4, F.lit('{"price":')).when(line == 6, F.lit("[]"))
    found = price.parse_offers(offers)
    return star.listings(spark, sf_dir).select("seq", found["is_free"].alias("is_free"), found["price_text"].alias("price_text"))


def entities_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'gs')"
    for k, v in [*(x for x in vocab.ENTITIES.items() if x[0] != "&amp;"), ("&amp;", "&")]:
        out = f"replace({out}, {quoted(k)}, {quoted(v)})"
    return f"trim(regexp_replace({out}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


@query(f"SELECT page_id, md5({entities_sql('html')}) AS digest, length({entities_sql('html')}) AS n_chars FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tags, references and white space of whole pages (none of them holds a numeric reference; `numeric_references` does)."""
    bare = text.strip_html(F.col("html"))
    return star.table(spark, sf_dir, "pages").select("page_id", F.md5(bare).alias("digest"), F.length(bare).cast("long").alias("n_chars"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS host, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
        regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages""")
def page_title_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27, E11."""
    url = F.col("url")
    title = F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1)
    return star.table(spark, sf_dir, "pages").select("page_id", text.host(url).alias("host"), text.origin(url).alias("origin"), title.alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"))


@query("""SELECT doc_id, length(replace(replace(replace(t, chr(92), chr(92) || chr(92)), ';', chr(92) || ';'), ',', chr(92) || ',')) AS n_chars,
        md5(replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), ';', chr(92) || ';'), ',', chr(92) || ','), chr(10), chr(92) || 'n')) AS digest
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def ics_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F23."""
    escaped = text.ics_escape(F.col("text"))
    n = F.length(escaped) - F.length(F.coalesce("text", F.lit(""))) + F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    lines = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")))
    return star.table(spark, sf_dir, "documents").select("doc_id", (n - lines).cast("long").alias("n_chars"), F.md5(escaped).alias("digest"))


# The write side


@query("""SELECT seq, CASE WHEN long THEN 'exhibition' ELSE event_type END AS event_type, CASE WHEN long THEN salted ELSE id END AS id FROM (
        SELECT seq, event_type, {id} AS id, {salted} AS salted, coalesce(span > 36 * 3600, false) AND event_type NOT IN ('exhibition', {specific}) AS long, coalesce(span > 550 * 86400, false) AS endless, named
        FROM (SELECT *, substr(seq, 14, 2) = '06' AS named, CASE WHEN substr(seq, 14, 2) = '06' THEN 'Semi-Permanent Works: ' ELSE '' END || title AS told, CASE WHEN (length(start) = 10) <> (length("end") = 10) THEN epoch(e_wall) - epoch(s_wall) ELSE epoch(e_utc) - epoch(s_utc) END AS span FROM placed))
        WHERE NOT (endless AND (long OR event_type = 'exhibition')) AND NOT (named AND event_type = 'exhibition')""".format(id=id_sql("venue_id", "start", "title"), salted=id_sql("venue_id", "start", "(told || '::exh')"), specific=", ".join(map(quoted, vocab.SPECIFIC_TYPES))))
def reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P02, F05, C03; the sixth line of an order has a title that says it is permanent."""
    rows = star.listings(spark, sf_dir)
    told = F.when(F.substring("seq", 14, 2) == "06", F.concat(F.lit("Semi-Permanent Works: "), F.col("title"))).otherwise(F.col("title"))
    return write_side.reshape(rows.withColumn("title", told)).select("seq", "event_type", "id")


SCORE = """(CAST(title <> '' AS INT) + CAST(description IS NOT NULL AS INT) + CAST(start IS NOT NULL AS INT) + CAST("end" IS NOT NULL AS INT) + CAST(url IS NOT NULL AS INT)
        + 2 * CAST(image IS NOT NULL AS INT) + CAST(coalesce(length(description) > 200, false) AS INT) + CAST(has_artist AS INT))"""


@query(f"SELECT seq, {SCORE} AS score FROM listing")
def richness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02."""
    rows = star.listings(spark, sf_dir)
    return rows.select("seq", write_side.richness(rows).alias("score"))


@query(f"""SELECT id, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) AS r FROM
        (SELECT {id_sql('venue_id', 'NULL', 'title')} AS id, seq, {SCORE} AS score FROM listing)) WHERE r = 1""")
def dedupe_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a venue and title."""
    rows = text.with_event_id(star.listings(spark, sf_dir).withColumn("start_text", F.col("start")).withColumn("start", F.lit(None).cast("string")))
    rows = rows.withColumn("start", F.col("start_text")).drop("start_text")
    return write_side.dedupe_richest(rows, points="score").select("id", "seq", "score")


@query("""SELECT id, seq FROM (SELECT id, seq, row_number() OVER (PARTITION BY id ORDER BY n DESC, seq) AS r FROM
        (SELECT n_name AS id, s_suppkey AS seq, 3 + CAST(s_acctbal > 0 AS INT) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)) WHERE r = 1""")
def venue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the suppliers of a nation, the one with most fields."""
    rows = star.table(spark, sf_dir, "supplier").join(star.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("id"), F.col("s_suppkey").alias("seq"), "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("paid"))
    return write_side.dedupe_venues(rows).select("id", "seq")


@query("""SELECT id, seq FROM (SELECT n_name AS id, s_suppkey AS seq, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey DESC) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE r = 1""")
def venue_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the venues with one id, the last."""
    rows = star.table(spark, sf_dir, "supplier").join(star.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("id"), F.col("s_suppkey").alias("place"), F.col("s_suppkey").alias("seq"), "s_name")
    return read_side.last_by_id(rows, "id", "place").select("id", "seq")


RECURRING = f"""worded AS (SELECT *, regexp_matches(title, {pattern(vocab.RECURRING_WORDS)}, 'i') OR regexp_matches(coalesce(description, ''), {pattern(vocab.RECURRING_WORDS)}, 'i') AS words FROM listing),
        marked AS (SELECT *, CASE WHEN words THEN 'keyword' WHEN count(*) FILTER (NOT words) OVER (PARTITION BY venue_id, lower(trim(title))) >= 5 THEN 'frequency' END AS reason FROM worded)"""


@query(after(RECURRING, "SELECT seq, reason FROM marked WHERE reason IS NOT NULL"))
def recurring_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes, and why."""
    return write_side.recurring(star.listings(spark, sf_dir))[1].select("seq", "reason")


@query(after(RECURRING, "SELECT seq FROM marked WHERE reason IS NULL"))
def recurring_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays."""
    return write_side.recurring(star.listings(spark, sf_dir))[0].select("seq")


@query("""SELECT seq, coalesce(CASE WHEN length(u) = 10 THEN timezone('America/Los_Angeles', u_wall + INTERVAL 1439 MINUTES) AT TIME ZONE 'UTC' ELSE u_wall + INTERVAL 7 HOURS END
        < TIMESTAMP '1998-06-17 19:00:00', false) AS is_past FROM placed""")
def archive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P05, F06."""
    return write_side.split_archive(star.listings(spark, sf_dir), NOW_UTC).select("seq", "is_past")


GATE = """gated AS (SELECT *, CASE WHEN event_type <> 'exhibition' AND s_utc IS NULL THEN 'no start date'
        WHEN event_type <> 'exhibition' AND epoch(e_utc) - epoch(s_utc) > 4 * 86400 THEN 'multi-week range, not a one-off event'
        WHEN event_type = 'exhibition' AND s_utc IS NULL AND e_utc IS NULL THEN 'undated exhibition'
        WHEN coalesce(e_utc, s_utc) < TIMESTAMP '1998-06-16 19:00:00' THEN 'already over' END AS reason FROM placed)"""


@query(after(GATE, "SELECT seq, reason FROM gated"))
def hygiene_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P06, F07, X04."""
    return write_side.hygiene(star.listings(spark, sf_dir), NOW_UTC).select("seq", "reason")


@query(after(GATE, "SELECT venue_id, title, reason, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY ALL ORDER BY n DESC, venue_id, title, reason LIMIT 10"))
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest rejects."""
    return write_side.reject_reasons(write_side.hygiene(star.listings(spark, sf_dir), NOW_UTC).where("reason IS NOT NULL"))


@query(after(GATE, """SELECT label, n, (SELECT greatest(0, count(DISTINCT '[' || venue_id || '] ' || title) - 10) FROM gated WHERE reason IS NOT NULL) AS others
        FROM (SELECT '[' || venue_id || '] ' || title AS label, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY 1) ORDER BY n DESC, label LIMIT 10"""))
def reject_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest labels of dropped rows and how many more there are."""
    return write_side.reject_labels(write_side.hygiene(star.listings(spark, sf_dir), NOW_UTC).where("reason IS NOT NULL"))


@query(after(GATE, "SELECT venue_id, title, 'dropped (' || reason || ')' AS reason, '1998-06-17T19:00:00+00:00' AS at FROM gated WHERE reason IS NOT NULL"))
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warning table."""
    return write_side.warnings_of(write_side.hygiene(star.listings(spark, sf_dir), NOW_UTC), "1998-06-17T19:00:00+00:00")


@query("SELECT seq, start FROM placed WHERE event_type = 'lecture' AND s_wall IS NOT NULL ORDER BY s_wall, seq LIMIT 40")
def soonest_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty lectures that start first."""
    rows = star.listings(spark, sf_dir).where("event_type = 'lecture'").where(dates.wall(F.col("start")).isNotNull())
    return write_side.soonest(rows, 40).select("seq", "start")


@query("SELECT venue_id, description FROM (SELECT venue_id, description, row_number() OVER (PARTITION BY venue_id ORDER BY seq) AS r FROM listing WHERE description IS NOT NULL) WHERE r = 1")
def first_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first description that a venue's listings have."""
    return write_side.first_match(star.listings(spark, sf_dir), "venue_id", "description", "seq")


@query("""SELECT seq, venue_id, part FROM (SELECT seq, venue_id, CASE WHEN CAST(substr(seq, 1, 12) AS BIGINT) % 97 = 0 THEN 1 ELSE 0 END AS part FROM listing)
        WHERE part = 1 OR venue_id NOT IN (SELECT venue_id FROM listing WHERE CAST(substr(seq, 1, 12) AS BIGINT) % 97 = 0)""")
def carryover_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace those of their venues."""
    fresh = F.substring("seq", 1, 12).cast("long") % 97 == 0
    merged = write_side.carried(star.listings(spark, sf_dir).withColumn("new", fresh), "new")
    return merged.select(F.col("seq.at").alias("seq"), "venue_id", F.col("seq.from").alias("part"))


RUNS = "runs AS (SELECT 'u' || user_id AS venue_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, bool_or(event_type <> 'error') AS success FROM events GROUP BY ALL)"


@query(after(RUNS, """SELECT venue_id, day, CAST(sum(CAST(NOT success AS INT)) OVER (PARTITION BY venue_id, island ORDER BY day) AS BIGINT) AS zero_streak
        FROM (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY venue_id ORDER BY day) AS island FROM runs)"""))
def health_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row at each run."""
    return write_side.zero_streaks(star.runs(spark, sf_dir)).select("venue_id", "day", "zero_streak")


@query(after(RUNS, """SELECT coalesce(p.venue_id, r.venue_id) AS venue_id, CASE WHEN r.n > 0 THEN 0 WHEN r.n IS NOT NULL THEN coalesce(p.z, 0) + 1 ELSE p.z END AS zero_streak,
        CASE WHEN r.n > 0 THEN '2024-01-30' ELSE p.last_success END AS last_success,
        r.n IS NOT NULL AND CASE WHEN r.n > 0 THEN 0 ELSE coalesce(p.z, 0) + 1 END >= 3 AND CASE WHEN r.n > 0 THEN '2024-01-30' ELSE p.last_success END IS NOT NULL AS alert
        FROM (SELECT venue_id, CAST(sum(CAST(NOT success AS INT)) AS INT) AS z, max(day) FILTER (success) AS last_success FROM runs WHERE day < '2024-01-30' GROUP BY venue_id) p
        FULL JOIN (SELECT venue_id, sum(CAST(success AS INT)) AS n FROM runs WHERE day = '2024-01-30' GROUP BY venue_id) r ON p.venue_id = r.venue_id"""))
def health_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after one more day of runs."""
    rows = star.runs(spark, sf_dir)
    before = rows.where("day < '2024-01-30'").groupBy("venue_id").agg(F.sum((~F.col("success")).cast("int")).cast("int").alias("zero_streak"), F.max(F.when(F.col("success"), F.col("day"))).alias("last_success"))
    ran = rows.where("day = '2024-01-30'").groupBy("venue_id").agg(F.sum(F.col("success").cast("int")).alias("rows"))
    return write_side.update_health(before, ran, "2024-01-30")


# The read side


@query(f"""SELECT id FROM venue WHERE id NOT IN (SELECT venue_id FROM placed WHERE {LIVE} AND event_type = 'other' AND is_free IS NOT DISTINCT FROM true)""")
def untracked_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues without a source of free events of no special kind that are still to come."""
    live = read_side.is_upcoming(F.col("start"), F.col("end"), NOW)
    some = star.listings(spark, sf_dir).where(live & (F.col("event_type") == "other") & F.col("is_free").eqNullSafe(F.lit(True)))
    return star.venues(spark, sf_dir).join(some.select("venue_id"), F.col("id") == F.col("venue_id"), "left_anti").select("id")


@query(f"SELECT {SHOWN} FROM listing WHERE venue_id IN ('v1', 'v3') OR url = 'https://www.example.org/7'")
def saved_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved ids are of venues and of events alike."""
    rows = star.listings(spark, sf_dir)
    saved = spark.createDataFrame([("v1",), ("v3",)], "saved string").unionByName(rows.where("url = 'https://www.example.org/7'").select(F.col("seq").alias("saved")))
    return shown(read_side.of_saved(rows, saved, "saved", ("venue_id", "seq")))


ON_VIEW = f"""e AS (SELECT * FROM placed WHERE event_type = 'exhibition' AND NOT regexp_matches(title, {pattern(vocab.NON_EXHIBITION_TITLE)}, 'i')
        AND s_wall <= TIMESTAMP '1998-06-17' AND e_wall >= TIMESTAMP '1998-06-17' AND epoch(e_wall) - epoch(s_wall) <= 550 * 86400)"""


@query(after(ON_VIEW, f"SELECT {SHOWN} FROM e"))
def live_exhibitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14."""
    return shown(read_side.live_exhibitions(star.listings(spark, sf_dir), NOW))


@query(after(ON_VIEW, "SELECT seq, row_number() OVER (ORDER BY u_wall NULLS LAST, seq) AS place FROM e"))
def ending_soonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhibitions on view, the soonest to close first."""
    rows = read_side.live_exhibitions(star.listings(spark, sf_dir), NOW)
    return read_side.numbered(rows.select("seq", "start", "end"), read_side.by_end()).select("seq", "place")


@query(after(ON_VIEW, """SELECT venue_id, n, row_number() OVER (ORDER BY first) AS place FROM (SELECT venue_id, count(*) AS n, min(r) AS first FROM
        (SELECT venue_id, row_number() OVER (ORDER BY u_wall NULLS LAST, seq) AS r FROM e) GROUP BY venue_id)"""))
def exhibitions_by_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues in the order in which their first exhibition closes."""
    rows = read_side.live_exhibitions(star.listings(spark, sf_dir), NOW)
    first = F.min(F.struct(dates.wall(dates.last_text(F.col("start"), F.col("end"))), F.col("seq")))
    grouped = rows.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    return read_side.numbered(grouped, [F.col("first")]).select("venue_id", "n", "place")


def shown_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_side.filter_events(star.listings(spark, sf_dir), star.venues(spark, sf_dir), read_side.FilterSpec(), NOW)


NEXT7 = """next7 AS (SELECT p.* FROM placed p JOIN venue v ON p.venue_id = v.id WHERE u_last >= TIMESTAMP '1998-06-17 12:00:00' AND s_wall IS NOT NULL AND s_wall <= TIMESTAMP '1998-06-24 23:59:59.999'),
        days AS (SELECT *, CASE WHEN CAST(s_wall AS DATE) < DATE '1998-06-17' AND CAST(u_wall AS DATE) >= DATE '1998-06-17' THEN DATE '1998-06-17' ELSE CAST(s_wall AS DATE) END AS day FROM next7)"""


@query(after(NEXT7, """SELECT seq, CAST(day AS VARCHAR) AS day, row_number() OVER (PARTITION BY day ORDER BY first NULLS LAST, venue_id, s_wall NULLS LAST, seq) AS place
        FROM (SELECT *, min(s_wall) OVER (PARTITION BY day, venue_id) AS first FROM days)"""))
def day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, and blocks of venues within them."""
    return read_side.day_groups(shown_days(spark, sf_dir), NOW).select("seq", F.col("day").cast("string").alias("day"), "place")


@query(after(NEXT7, "SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, count(DISTINCT venue_id) AS n_venues FROM days GROUP BY day"))
def day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    days = shown_days(spark, sf_dir).withColumn("day", read_side.day_of(NOW).cast("string"))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("venue_id").alias("n_venues"))


@query(after(NEXT7, "SELECT venue_id, CAST(min(s_wall) AS VARCHAR) AS first_start, count(*) AS n, row_number() OVER (ORDER BY min(s_wall) NULLS LAST, venue_id) AS place FROM next7 GROUP BY venue_id"))
def stack_by_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A17, T06."""
    return read_side.stack_by_venue(shown_days(spark, sf_dir)).withColumn("first_start", F.col("first_start").cast("string"))


@query(after(NEXT7, """SELECT venue_id, seq, place, greatest(0, n - 3) AS more FROM (SELECT venue_id, seq, row_number() OVER (PARTITION BY venue_id ORDER BY s_wall NULLS LAST, seq) AS place,
        count(*) OVER (PARTITION BY venue_id) AS n FROM next7) WHERE place <= 3"""))
def next3_per_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T04."""
    return read_side.next_per_venue(shown_days(spark, sf_dir)).select("venue_id", "seq", "place", "more")


@query(after(NEXT7, """SELECT v.id, CASE WHEN free THEN 'free' WHEN fam THEN 'family' WHEN x.venue_id IS NOT NULL THEN 'events' ELSE 'none' END AS kind FROM venue v
        LEFT JOIN (SELECT venue_id, bool_or(is_free IS NOT DISTINCT FROM true) AS free, bool_or(family) AS fam FROM next7 GROUP BY venue_id) x ON v.id = x.venue_id"""))
def marker_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, P16."""
    return read_side.marker_kinds(star.venues(spark, sf_dir), shown_days(spark, sf_dir))


@query("""SELECT seq, CASE WHEN s_wall IS NULL THEN NULL WHEN event_type <> 'exhibition' AND "end" IS NOT NULL AND s_wall <= TIMESTAMP '1998-06-17 12:00:00' AND e_wall >= TIMESTAMP '1998-06-17 12:00:00' THEN 'Now'
        WHEN d < 0 THEN NULL WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Tomorrow' WHEN d <= 7 AND dayofweek(s_wall) IN (0, 5, 6) THEN 'This weekend' WHEN d <= 7 THEN 'This week' END AS label
        FROM (SELECT *, date_diff('day', DATE '1998-06-17', CAST(s_wall AS DATE)) AS d FROM placed)""")
def relative_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    label = dates.relative_label(F.col("start"), F.col("end"), F.col("event_type") == "exhibition", NOW)
    return star.listings(spark, sf_dir).select("seq", label.alias("label"))


@query(after(ON_VIEW, "SELECT seq, d AS days FROM (SELECT seq, CAST(floor((epoch(u_wall) - epoch(TIMESTAMP '1998-06-17')) / 86400 + 0.5) AS BIGINT) AS d FROM e) WHERE d BETWEEN 0 AND 14"))
def closing_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13."""
    rows = read_side.live_exhibitions(star.listings(spark, sf_dir), NOW)
    return rows.select("seq", dates.days_until_close(F.col("start"), F.col("end"), NOW).alias("days")).where(F.col("days").between(0, vocab.CLOSING_BADGE_DAYS))


@query("""SELECT seq, row_number() OVER (ORDER BY s_wall DESC NULLS FIRST, seq DESC) AS place FROM placed WHERE u_last < TIMESTAMP '1998-06-17 12:00:00'""")
def archive_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole archive, latest first."""
    old = ~read_side.is_upcoming(F.col("start"), F.col("end"), NOW)
    return read_side.numbered(star.listings(spark, sf_dir).where(old).select("seq", "start"), read_side.archive_order()).select("seq", "place")


@query("SELECT seq FROM listing WHERE event_type <> 'exhibition' AND is_free IS NOT DISTINCT FROM true")
def feed_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11."""
    return write_side.feed(star.listings(spark, sf_dir), "free").select("seq")


@query("SELECT seq FROM listing WHERE event_type <> 'exhibition' AND family")
def feed_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11."""
    return write_side.feed(star.listings(spark, sf_dir), "family").select("seq")


def upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings that aren't over, those of unknown venues too."""
    rows = read_side.with_venues(star.listings(spark, sf_dir), star.venues(spark, sf_dir), "left")
    return rows.where(read_side.is_upcoming(F.col("start"), F.col("end"), NOW))


def folded_sql(c: str, octets: int = 74) -> str:
    """A line folded at octets, character by character."""
    step = f"CASE WHEN a.n + x.n > {octets} THEN {{'n': 1 + x.n, 'out': a.out || chr(13) || chr(10) || ' ' || x.out}} ELSE {{'n': a.n + x.n, 'out': a.out || x.out}} END"
    return f"CASE WHEN octet_length(encode({c})) <= {octets} THEN {c} ELSE list_reduce(list_transform(string_split({c}, ''), lambda x: {{'n': CAST(octet_length(encode(x)) AS BIGINT), 'out': x}}), lambda a, x: {step}).out END"


HEAD = "concat_ws(' · ', v.name, price_text, url)"


@query(f""", told AS (SELECT seq, list_filter(['all', CASE WHEN is_free IS NOT DISTINCT FROM true THEN 'free' END, CASE WHEN family THEN 'family' END], lambda x: x IS NOT NULL) AS feeds,
        list_filter(['BEGIN:VEVENT', 'UID:' || {id_sql('p.venue_id', 'start', 'title')} || '@listings', 'DTSTAMP:19980617T190000Z',
            CASE WHEN contains(start, 'T') THEN 'DTSTART:' || strftime(s_utc, '%Y%m%dT%H%M%SZ') ELSE 'DTSTART;VALUE=DATE:' || strftime(s_wall, '%Y%m%d') END,
            CASE WHEN contains(start, 'T') THEN CASE WHEN contains("end", 'T') THEN 'DTEND:' || strftime(e_utc, '%Y%m%dT%H%M%SZ') END ELSE 'DTEND;VALUE=DATE:' || strftime(e_wall, '%Y%m%d') END,
            'SUMMARY:' || {escaped_sql('title')}, 'LOCATION:' || {escaped_sql('coalesce(v.address, v.name)')}, 'URL:' || url,
            'DESCRIPTION:' || nullif({escaped_sql(f"concat_ws(chr(10) || chr(10), nullif({HEAD}, ''), nullif(substr(trim(coalesce(description, '')), 1, {feeds.BLURB}), ''))")}, ''), 'END:VEVENT'], lambda x: x IS NOT NULL) AS lines
        FROM placed p LEFT JOIN venue v ON p.venue_id = v.id WHERE {LIVE} AND event_type <> 'exhibition' AND s_wall IS NOT NULL),
    each AS (SELECT seq, feeds, unnest(lines) AS line, CAST(unnest(range(len(lines))) AS INT) AS pos FROM told), cut AS (SELECT seq, feeds, pos, {folded_sql('line')} AS line FROM each)
    SELECT unnest(feeds) AS feed, seq, pos, line FROM cut""")
def ics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded lines of all upcoming one-off events, for each feed that has them."""
    # The lines of a listing are made once, whatever feeds it is in.
    rows = write_side.one_off(upcoming(spark, sf_dir)).select("seq", write_side.feeds_of().alias("feeds"), feeds.event_lines(NOW_UTC).alias("lines"))
    return rows.select("seq", "feeds", F.posexplode("lines").alias("pos", "line")).select(F.explode("feeds").alias("feed"), "seq", "pos", "line")


def url_encoded_sql(c: str) -> str:
    return f"replace(url_encode({c}), '%20', '+')"


@query(f"""SELECT seq, 'https://calendar.google.com/calendar/render?action=TEMPLATE&text=' || {url_encoded_sql('title')} || '&dates=' ||
        CASE WHEN contains(start, 'T') THEN strftime(s_wall, '%Y%m%dT%H%M%S') || '/' || strftime(coalesce(e_wall, s_wall + INTERVAL 2 HOURS), '%Y%m%dT%H%M%S')
             ELSE strftime(s_wall, '%Y%m%d') || '/' || strftime(coalesce(e_wall, s_wall) + INTERVAL 1 DAY, '%Y%m%d') END ||
        '&details=' || {url_encoded_sql("concat_ws(chr(10) || chr(10), nullif(description, ''), nullif(url, ''))")} || '&ctz=America%2FLos_Angeles' AS link FROM placed WHERE {LIVE}""")
def calendar_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all upcoming listings; null without a readable start."""
    return upcoming(spark, sf_dir).select("seq", feeds.calendar_link().alias("link"))


@query(f"""SELECT seq, CASE WHEN s_wall IS NOT NULL THEN array_to_string(list_filter(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//listings//EN', 'CALSCALE:GREGORIAN', 'BEGIN:VEVENT',
        'UID:' || {id_sql('p.venue_id', 'start', 'title')} || '@listings', 'DTSTAMP:19980617T190000Z',
        CASE WHEN contains(start, 'T') THEN 'DTSTART:' || strftime(s_utc, '%Y%m%dT%H%M%SZ') ELSE 'DTSTART;VALUE=DATE:' || strftime(s_wall, '%Y%m%d') END,
        CASE WHEN contains(start, 'T') THEN 'DTEND:' || strftime(coalesce(e_utc, s_utc + INTERVAL 2 HOURS), '%Y%m%dT%H%M%SZ') ELSE 'DTEND;VALUE=DATE:' || strftime(coalesce(e_utc, s_wall + INTERVAL 1 DAY), '%Y%m%d') END,
        'SUMMARY:' || {escaped_sql('title')}, 'DESCRIPTION:' || {escaped_sql('description')}, 'LOCATION:' || {escaped_sql("coalesce(v.address, v.name, '')")}, 'URL:' || {escaped_sql('url')},
        'END:VEVENT', 'END:VCALENDAR'], lambda x: x IS NOT NULL), chr(13) || chr(10)) END AS calendar FROM placed p LEFT JOIN venue v ON p.venue_id = v.id WHERE {LIVE}""")
def single_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of each upcoming listing by itself."""
    return upcoming(spark, sf_dir).select("seq", feeds.single_event(NOW_UTC).alias("calendar"))


BOXES = "CASE " + " ".join(f"WHEN lng >= {w} AND lng < {e} AND lat >= {s} AND lat < {n} THEN '{name}'" for name, w, s, e, n in reversed(vocab.REGION_BOXES)) + " END"


@query(f"SELECT id, {BOXES} AS region FROM venue")
def region_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X08."""
    return read_side.regions_of(star.venues(spark, sf_dir).drop("region")).select("id", "region")


@query(f"""SELECT (SELECT count(*) FROM placed WHERE {LIVE}) AS upcoming, (SELECT count(*) FROM placed WHERE event_type = 'exhibition' AND {LIVE}) AS exhibitions,
        (SELECT count(*) FROM venue) AS venues, (SELECT max(seq) FROM listing) AS last_seen""")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06 to A08."""
    rows, live = star.listings(spark, sf_dir), read_side.is_upcoming(F.col("start"), F.col("end"), NOW)
    counts = rows.agg(F.count_if(live).alias("upcoming"), F.count_if(live & (F.col("event_type") == "exhibition")).alias("exhibitions"), F.max("seq").alias("last_seen"))
    return counts.join(star.venues(spark, sf_dir).agg(F.count(F.lit(1)).alias("venues"))).select("upcoming", "exhibitions", "venues", "last_seen")


@query("""SELECT seq, CAST(CAST(n AS DATE) AS VARCHAR) AS night FROM (SELECT seq, unnest(CASE WHEN date_diff('day', CAST(s_wall AS DATE), CAST(e_wall AS DATE)) BETWEEN 0 AND 7
        THEN generate_series(CAST(s_wall AS DATE), CAST(e_wall AS DATE), INTERVAL 1 DAY) ELSE [CAST(CAST(s_wall AS DATE) AS TIMESTAMP)] END) AS n FROM placed WHERE event_type = 'screening' AND s_wall IS NOT NULL)""")
def nightly_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of nights as one row each."""
    rows = star.listings(spark, sf_dir).where("event_type = 'screening'").select("seq", dates.wall(F.col("start")).cast("date").alias("a"), dates.wall(F.col("end")).cast("date").alias("b"))
    return extract.nights(rows.where("a IS NOT NULL"), "a", "b").select("seq", F.col("night").cast("string").alias("night"))


@query("""SELECT doc_id, pos, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM (
        SELECT doc_id, pos, CASE WHEN length(line) < 60 AND length(line) > 0 THEN line END AS head FROM (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, CAST(unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS INT) AS pos FROM documents))""")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the last short line before it."""
    lines = star.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    size = F.length("line")
    rows = lines.select("doc_id", "pos", F.when((size < 60) & (size > 0), F.col("line")).alias("section"))
    return extract.carry_forward(rows, "doc_id", "pos", "section")


# They register themselves.
from handbill.plans import extraction, state  # noqa: E402, F401
