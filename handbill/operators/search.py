"""Search without a scan: posting lists of three-letter runs over distinct texts, by hashed bucket.

An index has three tables: the distinct texts in lower case, the texts of each key
(a row a key), and a row for each run of a text. A query reads the buckets of its
own runs, keeps the texts that have all of them, and verifies those alone. Texts that many
rows share are indexed once, so a common word costs as many rows as it has texts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Tables without a row hold no file that tells their columns.
TEXTS, RUNS = "text_id string, text string, bucket int", "text_id string, gram string, bucket int"


def bucket_of(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text; none of a shorter one."""
    places = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def write_index(rows: DataFrame, key: str, texts: list[Column], path: str, buckets: int = 64) -> None:
    """An index at ``path`` of some texts of ``rows``, which a unique ``key`` names. Null and empty texts hold nothing.

    ``buckets`` is how many parts the runs and the texts have; a query reads those of its own.
    """
    every = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.lower(c), F.lit("")) for c in texts])))
    # Two hashes name a text: with one, two of very many texts might share it.
    named = lambda t: F.concat_ws("-", F.hex(F.xxhash64(t)), F.hex(F.hash(F.lit(7), t)))
    # What is asked for is made once: the file holds a key's texts beside their names, and a search reads these alone.
    held = rows.select(F.col(key).alias("key"), every.alias("texts")).withColumn("text_ids", F.transform("texts", named)).where(F.size("texts") > 0)
    held.write.mode("overwrite").parquet(f"{path}/keys")
    each = rows.sparkSession.read.schema(held.schema).parquet(f"{path}/keys").select(F.explode("texts").alias("text"))
    once = each.distinct().withColumn("text_id", named(F.col("text"))).select("text_id", "text")
    parted = lambda df, by: df.withColumn("bucket", bucket_of(F.col(by), buckets)).repartition("bucket", by)
    parted(once, "text_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/texts")
    known = rows.sparkSession.read.schema(TEXTS).parquet(f"{path}/texts")
    runs = known.select("text_id", F.explode(grams(F.col("text"))).alias("gram"))
    # A run that very many texts have is spread over tasks, and sorted, so that others in its bucket are skipped.
    spread = runs.withColumn("bucket", bucket_of(F.col("gram"), buckets)).repartition("bucket", F.pmod(F.hash("text_id"), F.lit(8)))
    spread.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/runs")


def candidates(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame | None:
    """(text_id) of the texts that have all runs of a query; None if it is too short to have any."""
    wanted = sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
    if not wanted:
        return None
    parts = [r.b for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(bucket_of(F.col("w"), buckets).alias("b")).distinct().collect()]
    found = spark.read.schema(RUNS).parquet(f"{path}/runs").where(F.col("bucket").isin(*parts) & F.col("gram").isin(*wanted))
    return found.groupBy("text_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("text_id")


def find(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """(key) of the rows one of whose texts holds the query, in either case. A blank query is held by every row that has a text.

    A query of one or two characters has no runs: there the distinct texts are read.
    """
    return keys_of(spark, path, hits(spark, path, query, buckets).withColumn("query", F.lit(query))).select("key")


def keys_of(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """(query, key) of the rows that have one of the texts (text_id) found for a query, each once; all keys are read once, whatever the number of queries.

    The texts are written first: while they are few, their size tells Spark to send them to the keys, and no key is shuffled before it is found.
    """
    few = f"{path}/found-{uuid.uuid4().hex}"
    found.groupBy("text_id").agg(F.collect_set("query").alias("queries")).write.parquet(few)
    named = spark.read.schema("text_id string, queries array<string>").parquet(few)
    keys = spark.read.parquet(f"{path}/keys").select("key", F.explode("text_ids").alias("text_id"))
    return keys.join(named, "text_id").select(F.explode("queries").alias("query"), "key").distinct()


def hits(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """(text_id) of the distinct texts that hold a query."""
    wanted = query.strip().lower()
    texts = spark.read.schema(TEXTS).parquet(f"{path}/texts")
    some = candidates(spark, path, wanted, buckets)
    if some is not None:
        # Few texts are left: their buckets are known to the join before it reads.
        named = some.withColumn("b", bucket_of(F.col("text_id"), buckets)).withColumnRenamed("text_id", "id")
        texts = texts.join(named, (F.col("bucket") == F.col("b")) & (F.col("text_id") == F.col("id")), "left_semi")
    return texts.where(F.contains("text", F.lit(wanted))).select("text_id")


def event_texts(rows: DataFrame) -> list[Column]:
    """The texts of listings with their venue's columns that a search looks at."""
    plain = [F.col(c) for c in ("title", "description", "location_override", "venue_id", "venue_name", "venue_neighborhood") if c in rows.columns]
    return plain + [F.array_join(c, "\n") for c in ("artists", "venue_aliases") if c in rows.columns]


def find_all(spark: SparkSession, path: str, queries: list[str], buckets: int = 64) -> DataFrame:
    """(query, key) for several queries."""
    found = reduce(DataFrame.unionByName, [hits(spark, path, q, buckets).withColumn("query", F.lit(q)) for q in queries])
    return keys_of(spark, path, found).select("query", "key")
