"""Mixing sources to target weights by systematic sampling.

The expected copies of a document are its source's target over its source's
size. Their prefix sums within a source, shifted by one random offset, cross an
integer once for each copy that is emitted. Documents stand in the order of size
class, hash and id: neighbours are of like size, so what is taken comes near the
target, and a bucket (size class and leading hash digits) is a run of that order.
The prefix sums are those of whole size classes and buckets plus a running sum
within a bucket, so a source that holds a third of all rows is many small
groups. The hash is of id and text, so that rows of one id, or none, spread too.

All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbill.llm.common import cut, words_of

WEIGHTS = (5, 2, 1)
MAX_RATIO = 3
SEED = 17
#: A bucket is to hold about so many documents at most.
BUCKET_DOCS = 1_000_000


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_ratio: int = MAX_RATIO) -> DataFrame:
    """From (source, source_size), one row each, the same with ``target``.

    Sources in code point order, null last, take the weights in turn. The
    targets share the sum of all sizes by weight, up to ``max_ratio`` times a
    source's size; the excess goes to the others by weight. So a target is
    min(max_ratio * size, level * weight); the level follows from prefix sums in
    the order in which sources reach their limit. One row a source goes through
    one task here, never the documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    weighed = per_source.select("source", "source_size", weight.cast("long").alias("weight"), F.row_number().over(order).alias("rank"))
    everything = Window.partitionBy()
    limit = (max_ratio * F.col("source_size")) / F.col("weight")
    before = Window.orderBy(limit, "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = weighed.select(
        "source", "source_size", "weight", "rank", limit.alias("limit"),
        (F.sum("source_size").over(everything) - max_ratio * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("among"),
    )
    level = F.col("left") / F.col("among")
    reached = F.when(level <= F.col("limit"), F.struct("limit", "rank", level.alias("level")))
    capped = (max_ratio * F.col("source_size")).cast("double")
    found = levels.select("source", "source_size", "weight", F.min(reached).over(everything)["level"].alias("level"))
    return found.select("source", "source_size", F.least(capped, F.col("level") * F.col("weight")).alias("target"))


def offset(group: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): from the seed and its name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), group))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What places a row in the order: _group, _class, _hash (of id and text) and _size.

    ``_group`` stands for the source: never null, and in code point order with null last.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.size(words_of(text)).cast("long")
    group = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    decimal = F.col("_size").cast("string")
    size_class = F.concat(F.lpad(F.length(decimal).cast("string"), 2, "0"), F.rpad(F.substring(decimal, 1, 2), 2, "0"))
    return {"_group": group, "_hash": digest, "_size": size, "_class": size_class}


def sampled(distinct: DataFrame, weights: tuple[int, ...], max_ratio: int, seed: int, bucket_docs: int) -> DataFrame:
    """``distinct`` with _source_size, _target, rate, shift and _before.

    Its rows are (_group, _class, _hash, _size, ...) with ``_n``, how many documents
    are alike in that; ``_before`` is the number of documents before them in the
    order of their source. It is the sum of whole size classes, of whole buckets
    within the class, and a running sum within the bucket.
    """
    digits, n = 1, distinct.agg(F.sum("_n")).first()[0] or 0
    while bucket_docs * 16**digits < n:
        digits += 1
    bucket = F.substring("_hash", 1, digits)
    own = [c for c in distinct.columns if c not in ("_n", "_group", "_class")]
    in_bucket = distinct.groupBy("_group", "_class", bucket.alias("_bucket")).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_size")).alias("words"))
    in_class = in_bucket.groupBy("_group", "_class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    per_source = targets(in_class.groupBy(F.col("_group").alias("source")).agg(F.sum("words").alias("source_size")), weights, max_ratio)
    per_source = per_source.withColumnsRenamed({"source": "_group", "source_size": "_source_size", "target": "_target"})

    def ahead(keys: list[str], place: str) -> Column:
        over = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(over), F.lit(0))

    classes = in_class.select("_group", "_class", ahead(["_group"], "_class").alias("_of_classes")).join(per_source, "_group")
    starts = in_bucket.select("_group", "_class", "_bucket", ahead(["_group", "_class"], "_bucket").alias("_of_buckets")).join(classes, ["_group", "_class"])
    joined = distinct.withColumn("_bucket", bucket).join(starts, ["_group", "_class", "_bucket"])
    order = [c for c in own if c != "_size"]
    within = Window.partitionBy("_group", "_class", "_bucket").orderBy(order[0], "_size", *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    before = F.col("_of_classes") + F.col("_of_buckets") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    return joined.select("_group", *own, "_n", "_source_size", "_target", rate.alias("_rate"), offset(F.col("_group"), seed).alias("_shift"), before.alias("_before"))


def crossed(first: Column, last: Column) -> Column:
    """Integer boundaries that the prefix sum crosses between two places.

    Every document of a source has the same expected copies, so the prefix sum is exact: place times rate.
    """
    at = lambda place: F.floor(place * F.col("_rate") + F.col("_shift"))
    return at(last) - at(first)


def each(rows: DataFrame, n: str, place: str, run: int = 100_000) -> DataFrame:
    """``rows`` once for each of ``n`` (long), counted from 1 on in ``place``; in runs, so that no list is long."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(run).cast("long"))).alias("_start")
    runs = rows.where(F.col(n) > 0).select("*", start)
    ends = F.least(F.col(n), F.col("_start") + run)
    return runs.select("*", F.explode(F.sequence(F.col("_start") + 1, ends)).alias(place)).drop("_start")


def copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_ratio: int = MAX_RATIO,
    seed: int = SEED,
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, copies.

    Size is the number of words of the text, 0 for a null or empty text; a
    source of size 0 has target 0. A null source is a source. Rows with one id, or
    none, are separate documents. Repeats of a row are counted as one row with its
    number before anything is shuffled and are spread out again at the end;
    which of them gets a copy more is open, and the rows show no difference. An
    empty table gives an empty result. Neither ``bucket_docs`` nor the
    partitions change the result.
    """
    marks = sized(docs, id_col, text_col, source_col)
    rows = docs.select(F.col(id_col).alias("_id"), *[marks[c].alias(c) for c in ("_group", "_hash", "_size")]).withColumn("_class", marks["_class"])
    distinct = cut(rows.groupBy("_group", "_class", "_hash", "_size", "_id").agg(F.count(F.lit(1)).alias("_n")))
    placed = each(sampled(distinct, weights, max_ratio, seed, bucket_docs), "_n", "_j").withColumn("_place", F.col("_before") + F.col("_j"))
    taken = F.least(crossed(F.col("_place") - 1, F.col("_place")), F.lit(max_ratio)).cast("long")
    return placed.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("copies"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_ratio: int = MAX_RATIO,
    seed: int = SEED,
    bucket_docs: int = BUCKET_DOCS,
) -> DataFrame:
    """The mixture: each row of ``docs`` as often as copies() says, with its columns and no others.

    Texts are split into words once, for the sizes; then each distinct row
    travels once, by two hashes of all its columns. A map column is compared by its entries in order.
    """
    marks = sized(docs, id_col, text_col, source_col)
    plain = [F.map_entries(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in docs.schema]
    whole = {"_k1": F.xxhash64(F.lit(1), *plain), "_k2": F.xxhash64(F.lit(2), *plain)}
    # Nulls don't enter a hash, so which columns are null does.
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in plain])
    whole = {k: F.xxhash64(v, nulls) for k, v in whole.items()}
    rows = docs.select(*[marks[c].alias(c) for c in ("_group", "_hash", "_size")], *[v.alias(k) for k, v in whole.items()]).withColumn("_class", marks["_class"])
    distinct = cut(rows.groupBy("_group", "_class", "_hash", "_size", "_k1", "_k2").agg(F.count(F.lit(1)).alias("_n")))
    placed = sampled(distinct, weights, max_ratio, seed, bucket_docs)
    taken = F.least(crossed(F.col("_before"), F.col("_before") + F.col("_n")), max_ratio * F.col("_n")).cast("long")
    taken = placed.select("_k1", "_k2", taken.alias("_copies")).where("_copies > 0")
    each_row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in whole.items()])
    each_row = each_row.groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    return each(each_row.join(taken, ["_k1", "_k2"]), "_copies", "_j").select("_row.*")
