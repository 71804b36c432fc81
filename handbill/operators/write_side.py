"""The write side: from extracted listings to the published table.

Every step takes and returns DataFrames of listings. ``seq`` is the order of
arrival, explicit because Spark's rows have none: first come, first kept.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbill.functions import classify, dates, price, text, vocab


def normalize(raw: DataFrame) -> DataFrame:
    """Output form of extracted rows: types and prices from the raw words, then clean text, local dates and all_day.

    ``raw`` may carry ``offers`` and ``cost``; they are dropped. Audience is inferred only where it is empty.
    """
    given = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    title, description = F.col("title"), F.col("description")
    paid = price.resolve_price(title, description, F.col("is_free"), F.col("price_text"), given("offers"), given("cost"))
    out = raw.withColumn("_words", classify.words_text(title, description))
    out = out.withColumn("_inferred", classify.infer_all(title, description, F.col("_words"))).drop("_words").withColumns(
        {
            "event_types": classify.final_types(F.col("event_type"), F.col("event_types"), F.col("_inferred")),
            "audience": F.when(F.size("audience") > 0, F.col("audience")).otherwise(classify.infer_audience(title, description)),
            "_price": paid,
        }
    )
    local = {c: dates.to_local_iso(F.col(c)) for c in ("start", "end")}
    clean = {c: text.strip_html(F.col(c)) for c in ("title", "description")}
    out = out.withColumns({**local, **clean, "is_free": F.col("_price")["is_free"], "price_text": F.col("_price")["price_text"]})
    timed = F.coalesce(F.col("start").contains("T"), F.lit(True))
    return out.withColumn("all_day", F.col("all_day") | ~timed).drop("_inferred", "_price", "offers", "cost")


def reshape(listings: DataFrame) -> DataFrame:
    """Long one-off events become exhibitions, with a new id; permanent ones go. Specific types stay as they are.

    Rows of a source that bypasses this (a column ``reshape`` that is false) stay as they are.
    """
    # Instants and wall fields are columns first: each is named more than once.
    read = {f"_{c}_{k}": f(F.col(c)) for c in ("start", "end") for k, f in (("at", dates.gate_instant), ("wall", dates.wall))}
    mixed = dates.is_date(F.col("start")) != dates.is_date(F.col("end"))
    between = lambda k: dates.seconds(F.col(f"_end_{k}")) - dates.seconds(F.col(f"_start_{k}"))
    known = ~text.missing(F.col("start")) & ~text.missing(F.col("end"))
    timed = listings.withColumns(read).withColumn("_spent", F.when(known, F.when(mixed, between("wall")).otherwise(between("at")))).drop(*read)
    spent = F.col("_spent")
    exhibition = F.col("event_type") == "exhibition"
    endless = F.coalesce(spent > vocab.PERMANENT_DAYS * 86400, F.lit(False))
    permanent = text.matches(F.col("title"), vocab.PERMANENT_TITLE, F.lower("title"))
    long = F.coalesce(spent > vocab.EXHIBITION_HOURS * 3600, F.lit(False)) & ~exhibition & ~F.col("event_type").isin(vocab.SPECIFIC_TYPES)
    gone = (exhibition & (endless | permanent)) | (long & endless)
    open_to = F.coalesce(F.col("reshape"), F.lit(True)) if "reshape" in listings.columns else F.lit(True)
    # A row that goes has no list to open: as a condition, all that this is made of would be computed once more below.
    kept = timed.select("*", F.explode(F.when(~(gone & open_to), F.array(long & open_to))).alias("_long"))
    # Only rows that change their type need another id.
    kept = kept.withColumn("_norm", F.when(F.col("_long"), text.normalize_title(F.concat(F.col("title"), F.lit("::exh")))))
    salted = text.event_id(F.col("venue_id"), F.col("start"), F.col("title"), F.col("_norm"))
    return kept.withColumns(
        {"event_type": F.when(F.col("_long"), "exhibition").otherwise(F.col("event_type")), "id": F.when(F.col("_long"), salted).otherwise(F.col("id"))}
    ).drop("_long", "_spent", "_norm")


def richness(listing: DataFrame) -> Column:
    """0 to 9 points for what a record tells."""
    has = lambda c: (~text.missing(F.col(c))).cast("int")
    fields = sum((has(c) for c in ("title", "description", "start", "end", "url", "image")), F.lit(0))
    full = (F.length(text.text_or_empty(F.col("description"))) > 200).cast("int")
    return fields + full + has("image") + (F.coalesce(F.size("artists"), F.lit(0)) > 0).cast("int")


def dedupe_richest(listings: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",), points: str | None = None) -> DataFrame:
    """One row a key: the richest, the first among equals. Rows without a key go.

    Spark keeps the first row of each key in every task before the shuffle, so a
    key that very many rows share sends one row a task. With ``points``, a new
    column, the richness is kept: who asks for that and few columns more has only those sorted and shuffled.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy("_poor", *order))
    ranked = listings.withColumn("_poor", -richness(listings)).withColumn("_first", first).where("_first <= 1")
    # Of the first row alone: as a condition on all rows, the making of the key would be repeated in the joins below.
    kept = ranked.where(F.when(F.col("_first") <= 1, ~text.missing(F.col(key))))
    return (kept.withColumn(points, -F.col("_poor")) if points else kept).drop("_first", "_poor")


def dedupe_venues(venues: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row a venue id: that with most fields present, the first among equals."""
    present = sum((F.col(c).isNotNull().cast("int") for c in venues.columns if c not in order), F.lit(0))
    first = F.min_by(F.struct("*"), F.struct(-present, *order))
    return venues.where(~text.missing(F.col("id"))).groupBy(F.col("id").alias("_key")).agg(first.alias("_row")).select("_row.*")


def recurring(listings: DataFrame, repeats: int = vocab.REPEATS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): standing programmes by their words, then all rows of a title that a venue repeats.

    The counts are of rows that the words left; they are aggregated and joined
    back, so a title that many rows share is no window partition.
    """
    worded = listings.withColumn("_words", classify.is_recurring(F.col("title"), F.col("description")))
    worded = worded.withColumn("_title", F.lower(F.trim(text.text_or_empty(F.col("title")))))
    often = worded.where("NOT _words").groupBy("venue_id", "_title").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= repeats)
    often = often.select(F.col("venue_id").alias("_venue"), F.col("_title").alias("_often"))
    marked = worded.join(often, F.col("venue_id").eqNullSafe(F.col("_venue")) & (F.col("_title") == F.col("_often")), "left")
    again = F.when(F.col("_words"), "keyword").when(F.col("_often").isNotNull(), "frequency")
    marked = marked.withColumn("reason", again).drop("_words", "_title", "_venue", "_often")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


SKIPS = {"skip_titles": "array<string>", "skip_pattern": "string", "skip_types": "array<string>", "drop_past": "boolean", "require_time": "boolean"}


def publishable(listings: DataFrame, sources: DataFrame, today: date) -> DataFrame:
    """``listings`` with ``skip``: why their source doesn't publish them, or null.

    ``sources`` is the source table, one row a source; Spark broadcasts it while it is
    small. The first reason counts: title, pattern, type, no time, past. A row is
    past if its start's day lies before ``today``. Null settings skip nothing, nor
    does an unknown source; a pattern is searched in either case.
    """
    own = sources.select(F.col("venue_id").alias("_source"), F.struct(*[F.col(c).cast(t).alias(c) for c, t in SKIPS.items()]).alias("_skips"))
    rows = listings.join(own, F.col("venue_id") == F.col("_source"), "left")
    title, start = F.coalesce("title", F.lit("")), F.col("start")
    setting = lambda c: F.col("_skips").getField(c)
    titles = F.transform(setting("skip_titles"), lambda t: F.lower(F.trim(t)))
    reasons = {
        "title": F.array_contains(titles, F.lower(F.trim(title))),
        "pattern": (setting("skip_pattern") != "") & F.regexp_like(title, F.concat(F.lit(text.ANY_CASE), setting("skip_pattern"))),
        "type": F.array_contains(setting("skip_types"), F.col("event_type")),
        "no time": setting("require_time") & ~F.coalesce(start.contains("T"), F.lit(False)),
        "past": setting("drop_past") & (F.substring(start, 1, 10).try_cast("date") < F.lit(today)),
    }
    first = F.coalesce(*[F.when(c, F.lit(why)) for why, c in reasons.items()])
    return rows.withColumn("skip", first).drop("_source", "_skips")


def skip_warnings(judged: DataFrame) -> DataFrame:
    """Of publishable()'s rows those that someone should look at: a date was there but no time, so the source's form may have changed."""
    undated = judged.where((F.col("skip") == "no time") & F.col("start").isNotNull())
    return undated.select("venue_id", "title", F.lit("dropped (no time)").alias("reason"))


def split_archive(listings: DataFrame, now: datetime) -> DataFrame:
    """``listings`` with ``is_past``: over before ``now`` (a time in UTC); what has no readable end is upcoming."""
    over = dates.end_of_event(F.col("start"), F.col("end")) < dates.ntz(now)
    return listings.withColumn("is_past", F.coalesce(over, F.lit(False)))


def hygiene(listings: DataFrame, now: datetime) -> DataFrame:
    """``listings`` with ``reason``: null for a row to keep, else why it is dropped; ``now`` is a time in UTC."""
    read = listings.withColumns({f"_{c}": dates.gate_instant(F.col(c)) for c in ("start", "end")})
    start, end = F.col("_start"), F.col("_end")
    one_off = F.col("event_type") != "exhibition"
    late = dates.ntz(now - timedelta(days=vocab.GRACE_DAYS))
    reason = (
        F.when(one_off & start.isNull(), "no start date")
        .when(one_off & (dates.seconds(end) - dates.seconds(start) > vocab.ONE_OFF_DAYS * 86400), "multi-week range, not a one-off event")
        .when(~one_off & start.isNull() & end.isNull(), "undated exhibition")
        .when(F.coalesce(end, start) < late, "already over")
    )
    return read.withColumn("reason", reason).drop("_start", "_end")


def reject_reasons(dropped: DataFrame, most: int = 10) -> DataFrame:
    """The commonest (venue_id, title, reason) of dropped rows with their counts."""
    counted = dropped.groupBy("venue_id", "title", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "venue_id", "title", "reason").limit(most)


def reject_labels(dropped: DataFrame, most: int = 10) -> DataFrame:
    """(label, n, others): the commonest "[venue] title" of dropped rows, and how many labels more there are."""
    label = F.concat(F.lit("["), F.col("venue_id"), F.lit("] "), text.text_or_empty(F.col("title")))
    counted = dropped.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    others = counted.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("others"))
    # One row by at most ``most`` rows.
    return counted.orderBy(F.desc("n"), "label").limit(most).crossJoin(others)


def soonest(listings: DataFrame, most: int, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The ``most`` listings that start first: which detail pages are worth reading. Those without a start come last."""
    return listings.orderBy(dates.wall(F.col("start")).asc_nulls_last(), *order).limit(most)


def first_match(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """(key, value): of the rows of a key, the value that comes first by ``place``; null values don't count."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, place).alias(value))


def warnings_of(gated: DataFrame, at: str) -> DataFrame:
    """The warning table's rows (venue_id, title, reason, at) of what hygiene() drops, in their published wording."""
    told = F.concat(F.lit("dropped ("), F.col("reason"), F.lit(")"))
    # As a list that is opened, a reason is made once; as a condition it would be made again below.
    return gated.select("venue_id", "title", F.explode(F.array_compact(F.array(told))).alias("reason"), F.lit(at).alias("at"))


def carry_over(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows, and the existing ones of venues that gave none this time; those come first."""
    marked = lambda rows, this: rows.select(*new.columns, F.lit(this).alias("_new"))
    return carried(marked(existing, False).unionByName(marked(new, True)), "_new")


def carried(listings: DataFrame, new: str) -> DataFrame:
    """carry_over() of one table, whose column ``new`` is true for this time's rows; the column goes.

    The venues that gave rows are joined to the table, so it is made once, new and existing rows in the same
    tasks. As a union of two parts, each would join its tables for itself, the few new rows in one task.
    """
    this = F.coalesce(F.col(new), F.lit(False))
    produced = listings.where(F.col(new)).select(F.col("venue_id").alias("_produced")).distinct()
    marked = listings.join(produced, F.col("venue_id") == F.col("_produced"), "left")
    kept = marked.where(this | F.col("_produced").isNull())
    return kept.withColumn("seq", F.struct(this.cast("int").alias("from"), F.col("seq").alias("at"))).drop(new, "_produced")


def update_health(previous: DataFrame, runs: DataFrame, today: str, known_zero_runs: int = vocab.ZERO_RUNS) -> DataFrame:
    """(venue_id, zero_streak, last_success, alert) after a run.

    ``runs`` has (venue_id, rows) of the venues that ran; others keep their state
    and raise no alert. An alert needs a known last success.
    """
    joined = previous.join(runs, "venue_id", "full_outer")
    ran, good = F.col("rows").isNotNull(), F.coalesce(F.col("rows") > 0, F.lit(False))
    streak = F.when(good, 0).when(ran, F.coalesce("zero_streak", F.lit(0)) + 1).otherwise(F.col("zero_streak"))
    last = F.when(good, F.lit(today)).otherwise(F.col("last_success"))
    updated = joined.select("venue_id", streak.cast("int").alias("zero_streak"), last.alias("last_success"), ran.alias("_ran"))
    alert = F.col("_ran") & (F.col("zero_streak") >= known_zero_runs) & F.col("last_success").isNotNull()
    return updated.withColumn("alert", alert).drop("_ran")


def zero_streaks(runs: DataFrame) -> DataFrame:
    """From (venue_id, day, success) the zero streak at each run: failures since the last success."""
    order = Window.partitionBy("venue_id").orderBy("day")
    island = F.sum(F.col("success").cast("int")).over(order)
    groups = runs.withColumn("_island", island)
    within = Window.partitionBy("venue_id", "_island").orderBy("day")
    return groups.withColumn("zero_streak", F.sum((~F.col("success")).cast("int")).over(within).cast("long")).drop("_island")


def one_off(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("event_type") != "exhibition")


def feeds_of() -> Column:
    """The names of the feeds that a one-off listing belongs to: all, and free and family where it is that."""
    free, family = F.col("is_free").eqNullSafe(F.lit(True)), F.array_contains("audience", "family")
    return F.array_compact(F.array(F.lit("all"), F.when(free, F.lit("free")), F.when(family, F.lit("family"))))


def feed(listings: DataFrame, name: str) -> DataFrame:
    """The one-off listings of the feed all, free or family."""
    rows = one_off(listings)
    return {"all": rows, "free": rows.where(F.col("is_free").eqNullSafe(F.lit(True))), "family": rows.where(F.array_contains("audience", "family"))}[name]
