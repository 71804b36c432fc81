"""The read side: filters, searches, orders and groups over published listings."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbill.functions import classify, dates, text, vocab
from handbill.sources import storage


@dataclass(frozen=True)
class FilterSpec:
    """What a user has chosen; empty lists restrict nothing. The defaults are those of the landing page."""

    tab: str = "events"
    venue_types: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    chips: tuple[str, ...] = ()
    date: str = "next7"
    start: str | None = None
    end: str | None = None
    free: bool = False
    family: bool = False
    query: str = ""
    venue: str | None = None
    map: bool = False
    strict: bool = field(default=False, compare=False)

    _LISTS = {"types": "venue_types", "regions": "regions", "etypes": "chips"}
    _TEXTS = {"tab": "tab", "date": "date", "from": "start", "to": "end", "q": "query", "venue": "venue"}
    _FLAGS = ("free", "family", "map")

    @classmethod
    def from_query(cls, query: str) -> FilterSpec:
        found = dict(parse_qsl(query.lstrip("?")))
        kept = {to: found[k] for k, to in cls._TEXTS.items() if k in found}
        kept |= {to: tuple(filter(None, found[k].split(","))) for k, to in cls._LISTS.items() if k in found}
        return cls(**kept, **{k: True for k in cls._FLAGS if found.get(k) == "1"})

    def to_query(self) -> str:
        """Only what differs from the defaults, in a fixed order; "all" dates are written too."""
        plain, out = FilterSpec(), []
        for k, to in {**self._TEXTS, **self._LISTS}.items():
            value = getattr(self, to)
            if value != getattr(plain, to):
                out.append((k, ",".join(value) if isinstance(value, tuple) else value))
        return urlencode(out + [(k, "1") for k in self._FLAGS if getattr(self, k)])

    def window(self, now: datetime) -> tuple[datetime | None, datetime | None]:
        if self.date == "custom":
            day = lambda s, end: None if not s else datetime.fromisoformat(s + ("T23:59:59.999" if end else ""))
            return day(self.start, False), day(self.end, True)
        return dates.window_of(self.date, now)

    def active(self) -> int:
        """How many filters are set."""
        return len(self.venue_types) + len(self.regions) + len(self.chips) + self.free + self.family + (self.date != "all")


def last_by_id(venues: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row an id: the last by ``order`` (a column, dropped here), or else the greatest by all its columns, so that reruns agree."""
    place = f"venue_{order}" if order and f"venue_{order}" in venues.columns else order
    rest = [c for c in venues.columns if c != key]
    by = F.struct(F.col(place) if place and place in venues.columns else F.lit(0), F.to_json(F.struct(*rest)))
    last = F.max_by(F.struct(*rest), by).alias("_last")
    return venues.groupBy(key).agg(last).select(key, *[F.col("_last")[c].alias(c) for c in rest if c != place])


def with_venues(listings: DataFrame, venues: DataFrame, how: str = "inner", order: str = "seq") -> DataFrame:
    """Listings joined to their venue, whose columns get the prefix venue_. Of venues with one id the last by ``order`` counts.

    The join is left to Spark: the curated table is broadcast while its size is
    below the session's threshold, and is shuffled beyond it.
    """
    named = venues.select(*[F.col(c).alias("venue_id" if c == "id" else f"venue_{c}") for c in venues.columns])
    return listings.join(last_by_id(named, "venue_id", order), "venue_id", how)


def is_upcoming(start: Column, end: Column, now: datetime, strict: bool = False) -> Column:
    """Not over yet; without a readable end, upcoming. A date lasts to the end of its day, unless ``strict``: then to its start."""
    last = dates.last_text(start, end)
    over = (dates.wall(last) if strict else dates.end_of_day_wall(last)) < dates.ntz(now)
    return ~F.coalesce(over, F.lit(False))


def filter_events(listings: DataFrame, venues: DataFrame, spec: FilterSpec, now: datetime) -> DataFrame:
    """The listings of known venues that the filters leave and that aren't over.

    With a window, a listing without start goes, and the others must overlap it.
    """
    rows = with_venues(listings, venues)
    start, end = F.col("start"), F.col("end")
    keep = is_upcoming(start, end, now)
    if spec.venue_types:
        keep &= F.col("venue_type").isin(*spec.venue_types)
    if spec.regions:
        keep &= F.col("venue_region").isin(*spec.regions)
    if types := classify.chip_types(list(spec.chips)):
        keep &= F.arrays_overlap(classify.types_of(F.col("event_types"), F.col("event_type")), F.array(*map(F.lit, types)))
    if spec.free:
        keep &= F.col("is_free").eqNullSafe(F.lit(True))
    if spec.family:
        keep &= F.array_contains("audience", "family")
    first, last = spec.window(now)
    if first or last:
        begins = dates.wall(start)
        until = dates.last_text(start, end)
        ends = dates.wall(until) if spec.strict else dates.end_of_day_wall(until)
        keep &= begins.isNotNull()
        if first:
            keep &= ends >= dates.ntz(first)
        if last:
            keep &= begins <= dates.ntz(last)
    return rows.where(keep)


def eventful(listings: DataFrame, now: datetime) -> DataFrame:
    """(venue_id) of venues with an upcoming listing that isn't just an exhibition."""
    types = classify.types_of(F.col("event_types"), F.col("event_type"))
    some = F.arrays_overlap(types, F.array(*map(F.lit, vocab.EVENTFUL_TYPES)))
    return listings.where(some & is_upcoming(F.col("start"), F.col("end"), now)).select("venue_id").distinct()


def filter_venues(venues: DataFrame, types: tuple[str, ...] = (), regions: tuple[str, ...] = (), eventful_ids: DataFrame | None = None) -> DataFrame:
    out = venues
    if types:
        out = out.where(F.col("type").isin(*types))
    if regions:
        out = out.where(F.col("region").isin(*regions))
    return out if eventful_ids is None else out.join(eventful_ids, F.col("id") == F.col("venue_id"), "left_semi")


def holds(columns: list[Column], query: str) -> Column:
    """Whether any of the texts holds the query, in either case; a blank query is held by all."""
    wanted = query.strip().lower()
    found = F.lit(not wanted)
    for c in columns:
        found |= F.coalesce(F.lower(c).contains(wanted), F.lit(False))
    return found


def search_events(listings: DataFrame, venues: DataFrame, query: str) -> DataFrame:
    """Listings with the query in their own texts, artists or venue; those of unknown venues take part."""
    rows = with_venues(listings, venues, "left")
    texts = [F.col(c) for c in ("title", "description", "location_override", "venue_id", "venue_name", "venue_neighborhood") if c in rows.columns]
    lists = [F.array_join(c, "\n") for c in ("artists", "venue_aliases") if c in rows.columns]
    return rows.where(holds([*texts, *lists], query))


def search_venues(venues: DataFrame, query: str) -> DataFrame:
    lists = [F.array_join(c, "\n") for c in ("aliases",) if c in venues.columns]
    return venues.where(holds([*[F.col(c) for c in ("name", "description", "neighborhood", "address", "id") if c in venues.columns], *lists], query))


def live_exhibitions(listings: DataFrame, now: datetime) -> DataFrame:
    """Temporary exhibitions on view today."""
    types = classify.types_of(F.col("event_types"), F.col("event_type"))
    start, end = dates.wall(F.col("start")), dates.wall(F.col("end"))
    today = dates.ntz(now.replace(hour=0, minute=0, second=0, microsecond=0))
    short = dates.seconds(end) - dates.seconds(start) <= vocab.PERMANENT_DAYS * 86400
    programme = text.matches(F.col("title"), vocab.NON_EXHIBITION_TITLE)
    return listings.where(F.array_contains(types, "exhibition") & ~programme & (start <= today) & (end >= today) & short)


def by_start(order: tuple[str, ...] = ("seq",)) -> list[Column]:
    return [dates.wall(F.col("start")).asc_nulls_last(), *map(F.col, order)]


def by_end(order: tuple[str, ...] = ("seq",)) -> list[Column]:
    return [dates.wall(dates.last_text(F.col("start"), F.col("end"))).asc_nulls_last(), *map(F.col, order)]


def archive_order(order: tuple[str, ...] = ("seq",)) -> list[Column]:
    return [dates.wall(F.col("start")).desc_nulls_first(), *[F.col(c).desc() for c in order]]


def numbered(rows: DataFrame, order: list[Column], name: str = "place", within: str | None = None) -> DataFrame:
    """``rows`` with their place in the order, from 1 on, without one task for all rows.

    With ``within`` (a column) places are counted in each of its values, also
    without one task for a value that very many rows have. Rows are dealt by ranges
    of ``within`` and ``order``, which must tell all rows apart. A place is that
    among the rows of the same value in its own range, and how many of them earlier ranges have.
    """
    keys = [within] if within else []
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    # Ranges are sampled anew whenever they are computed, so they are kept.
    kept = storage.kept(ranged)
    counts = kept.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    # A row a range and value; only the value that a range begins with can have rows in earlier ones: a row a range at most.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_{k}") for k in keys], F.sum("_n").over(earlier).alias("_before")).where("_before > 0")
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = kept.withColumn(name, place).join(F.broadcast(before), same, "left")
    return placed.withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_r", "_before", *[f"_{k}" for k in keys])


def day_of(now: datetime) -> Column:
    """The day that a listing is shown under: today while it runs, null without a start."""
    today = F.lit(now.date())
    at, until = dates.wall(F.col("start")).cast("date"), dates.wall(dates.last_text(F.col("start"), F.col("end"))).cast("date")
    return F.when((at < today) & (until >= today), today).otherwise(at)


def day_groups(listings: DataFrame, now: datetime, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``listings`` with day and ``place`` in it: blocks of venues by earliest start, then by start.

    Today holds all that is running, so a day may be many ranges of rows; ``order`` must tell a venue's rows apart.
    """
    placed = listings.withColumns({"day": day_of(now), "_at": dates.wall(F.col("start"))})
    firsts = placed.groupBy(F.col("day").alias("_d"), F.col("venue_id").alias("_v")).agg(F.min("_at").alias("_first"))
    known = placed.join(firsts, F.col("day").eqNullSafe(F.col("_d")) & F.col("venue_id").eqNullSafe(F.col("_v"))).drop("_d", "_v")
    within = [F.col("_first").asc_nulls_last(), F.col("venue_id").asc(), F.col("_at").asc_nulls_last(), *map(F.col, order)]
    return numbered(known, within, within="day").drop("_at", "_first")


def next_per_venue(listings: DataFrame, k: int = 3, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first ``k`` listings of each venue by start, with ``more``: how many others it has."""
    own = Window.partitionBy("venue_id")
    ranked = listings.withColumn("place", F.row_number().over(own.orderBy(*by_start(order))))
    counts = listings.groupBy("venue_id").agg(F.count(F.lit(1)).alias("_n"))
    top = ranked.where(F.col("place") <= k)
    return top.join(counts, "venue_id").withColumn("more", F.greatest(F.lit(0), F.col("_n") - k).cast("long")).drop("_n")


def stack_by_venue(listings: DataFrame) -> DataFrame:
    """(venue_id, first_start, n, place): venues by earliest start, then id."""
    grouped = listings.groupBy("venue_id").agg(F.min(dates.wall(F.col("start"))).alias("first_start"), F.count(F.lit(1)).alias("n"))
    return numbered(grouped, [F.col("first_start").asc_nulls_last(), F.col("venue_id")])


def marker_kinds(venues: DataFrame, listings: DataFrame) -> DataFrame:
    """(id, kind): what a venue's marker on the map shows: free, family, events or none. A venue without a place has no marker."""
    some = listings.groupBy("venue_id").agg(
        F.bool_or(F.col("is_free").eqNullSafe(F.lit(True))).alias("free"), F.bool_or(F.array_contains("audience", "family")).alias("family")
    )
    kind = F.when(F.col("free"), "free").when(F.col("family"), "family").when(F.col("venue_id").isNotNull(), "events").otherwise("none")
    placed = venues.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return placed.join(some, F.col("id") == F.col("venue_id"), "left").select("id", kind.alias("kind"))


def region_boxes(spark) -> DataFrame:
    return spark.createDataFrame(vocab.REGION_BOXES, "box string, w double, s double, e double, n double")


def regions_of(points: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """``points`` with the region whose half-open box holds them, null for none; eleven boxes as one expression, no join."""
    region = F.lit(None).cast("string")
    for name, w, s, e, n in vocab.REGION_BOXES:
        inside = (F.col(lng) >= w) & (F.col(lng) < e) & (F.col(lat) >= s) & (F.col(lat) < n)
        region = F.when(inside, name).otherwise(region)
    return points.withColumn("region", region)


def venue_listings(listings: DataFrame, venues: DataFrame, now: datetime, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Known venues' listings that aren't over, with ``kind`` (event or exhibition) and ``place`` among those of the venue and kind, by start.

    A venue may have very many; places are counted by ranges of the whole order.
    """
    rows = with_venues(listings, venues).where(is_upcoming(F.col("start"), F.col("end"), now))
    kinds = rows.withColumn("kind", F.when(F.col("event_type") == "exhibition", "exhibition").otherwise("event"))
    return numbered(kinds.withColumn("_list", F.struct("venue_id", "kind")), by_start(order), within="_list").drop("_list")


def archive_view(listings: DataFrame, venues: DataFrame, now: datetime, query: str = "", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """What is over, latest first, with ``place``; of all filters only the query counts here."""
    old = search_events(listings.where(~is_upcoming(F.col("start"), F.col("end"), now)), venues, query)
    return numbered(old, archive_order(order))


def of_saved(listings: DataFrame, ids: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The listings one of whose ``columns`` is among ``ids``, which may be of several kinds; each once.

    The ids are written first: their size is known then, and while it is below the
    session's threshold no listing is shuffled for them. Listings are read once, whatever the number of columns.
    """
    spark, path = listings.sparkSession, storage.fresh_path(listings.sparkSession, "saved-ids")
    chosen = ids.select(F.col(key).alias("_id")).where("_id IS NOT NULL").distinct()
    chosen.write.parquet(path)
    known = spark.read.schema(chosen.schema).parquet(path)
    marked, some = listings, F.lit(False)
    for i, c in enumerate(columns):
        marked = marked.join(known.withColumnRenamed("_id", f"_id{i}"), F.col(c) == F.col(f"_id{i}"), "left")
        some |= F.col(f"_id{i}").isNotNull()
    return marked.where(some).drop(*[f"_id{i}" for i in range(len(columns))])


def saved(listings: DataFrame, ids: DataFrame, now: datetime, key: str = "id") -> DataFrame:
    """The saved listings (``ids``: key) among what is shown: what isn't over, and then the exhibitions on view that aren't among it."""
    chosen = listings.join(ids.select(F.col(key).alias("_saved")).distinct(), F.col(key) == F.col("_saved"), "left_semi")
    ahead = is_upcoming(F.col("start"), F.col("end"), now)
    return chosen.where(ahead).unionByName(live_exhibitions(chosen.where(~ahead), now))


def latest_scrape(listings: DataFrame, source: str = "venue_id") -> DataFrame:
    """(source, scraped_at): when each source was read last; times are texts of one form, and compare as such."""
    return listings.groupBy(source).agg(F.max("scraped_at").alias("scraped_at"))


def by_start_text(order: tuple[str, ...] = ("seq",)) -> list[Column]:
    """The order of published tables and calendars: the start as it is written, then the title."""
    return [text.text_or_empty(F.col("start")).asc(), text.text_or_empty(F.col("title")).asc(), *map(F.col, order)]


def default_view(venues: DataFrame) -> DataFrame:
    """(id, in_view): the venues that have a place on the map, and whether its first view, the region's core, shows them."""
    placed = venues.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    west, south, east, north = vocab.MAP_CORE
    return placed.select("id", (F.col("lng").between(west, east) & F.col("lat").between(south, north)).alias("in_view"))
