"""Structured Streaming forms: deduplicated listings, upserts, and the health of sources as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from handbill.operators.write_side import dedupe_richest
from handbill.sources.buckets import BucketedTable
from handbill.sources.tables import RAW_DOCUMENT


def raw_stream(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents as they land in a folder."""
    return spark.readStream.schema(RAW_DOCUMENT).json(path)


def first_seen(stream: DataFrame, key: str = "id", time: str = "at", delay: str = "2 days") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def hourly_counts(stream: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows and failures a source and hour, with late rows up to ``delay``."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("hour"), "venue_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures")
    )


def sliding_counts(rows: DataFrame, key: str, time: str = "ts", width: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """(start, end, key, n): rows in each window of ``width`` that begins every ``slide``; a table, or a stream with late rows up to ``delay``."""
    windows = rows.withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("_w"), key).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), key, "n")


def sessions(rows: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour", **measures: Column) -> DataFrame:
    """(key, start, last, n, *measures): runs of a key's rows that are never more than ``gap`` apart.

    A table, or a stream: there a late row within ``delay`` may join two sessions
    into one, and a session is given once no row can reach it any more. Rows
    without a time belong to none.
    """
    grouped = rows.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("_w"), key)
    found = grouped.agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("last"), *[c.alias(k) for k, c in measures.items()])
    return found.select(key, F.col("_w.start").alias("start"), "last", "n", *measures)


def merge_batches(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64, keep: int = 2) -> StreamingQuery:
    """Keeps at ``path`` the richest record of each id over all batches, as a BucketedTable.

    A batch rewrites the buckets that it touches; the newest ``keep`` versions stay. A batch that comes again changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = BucketedTable(batch.sparkSession, path, "id", buckets)
        table.merge(batch, dedupe_richest, batch_id)
        table.expire(keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health_stream(runs: DataFrame) -> DataFrame:
    """(venue_id, zero_streak, last_success) after each batch of runs (venue_id, day, success), as keyed state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, last, newest = state.get if state.exists else (0, None, "")
        for frame in frames:
            for day, success in sorted(zip(frame["day"], frame["success"])):
                if day <= newest:
                    continue  # a run that was counted before
                newest = day
                streak, last = (0, day) if success else (streak + 1, last)
        state.update((streak, last, newest))
        yield pd.DataFrame({"venue_id": [key[0]], "zero_streak": [streak], "last_success": [last]})

    return runs.groupBy("venue_id").applyInPandasWithState(
        update, "venue_id string, zero_streak int, last_success string", "zero_streak int, last_success string, newest string", "update", GroupStateTimeout.NoTimeout
    )
