"""Merged tables by bucket, streams with late rows, polygons, places in a hot day."""

import json
import os
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from handbill.operators import places, read_side, write_side
from handbill.plans.state import RECORD
from handbill.sources import star, storage
from handbill.sources.buckets import BucketedTable
from handbill.streaming import stream


def record(i, seq, **more):
    plain = {"id": str(i), "seq": seq, "title": "t", "description": None, "start": None, "end": None, "url": None, "image": None, "artists": []}
    return tuple((plain | more).values())


def files_of(path):
    return {p: p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


def test_a_merge_rewrites_what_it_touches(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, RECORD)
    assert table.read(RECORD).count() == 0 and table.merge(frame([]), write_side.dedupe_richest, 0) == set()
    first = [record(i, i) for i in range(400)]
    assert len(table.merge(frame(first), write_side.dedupe_richest, 1)) == 16
    before = files_of(table.path)
    late = [record(7, 1000, url="u"), record(7, 1001), record(8, -1)]
    touched = table.merge(frame(late), write_side.dedupe_richest, 2)
    assert 1 <= len(touched) <= 2
    after = files_of(table.path)
    assert before.items() <= after.items()
    fresh = {p.parent.name for p in after.keys() - before.keys()}
    assert fresh == {f"_bucket={b}" for b in touched}
    found = {r.id: r.seq for r in table.read(RECORD).collect()}
    assert len(found) == 400 and found["7"] == 1000 and found["8"] == -1 and found["9"] == 9
    assert {r.id: r.seq for r in table.read(RECORD, version=1).collect()}["7"] == 7
    # A batch that comes again changes nothing; a new one makes the oldest version's files superfluous.
    assert table.merge(frame([record(9, -5)]), write_side.dedupe_richest, 2) == set()
    table.merge(frame([record(9, -5)]), write_side.dedupe_richest, 3)
    gone = table.expire(keep=1)
    assert gone and all(not Path(p).exists() for p in gone) and table.versions() == [3]
    found = {r.id: r.seq for r in table.read(RECORD).collect()}
    assert len(found) == 400 and found["7"] == 1000 and found["9"] == -5
    # A run that died before its manifest was written left files that no reader sees.
    Path(table.path, "data/version=4/_bucket=0").mkdir(parents=True)
    assert len(table.read(RECORD).collect()) == 400 and table.versions() == [3]


def test_merged_stream_equals_all_at_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [record(rng.randrange(60), i, **({"url": "u"} if rng.random() < 0.3 else {}), **({"image": "i"} if rng.random() < 0.2 else {})) for i in range(500)]
    names = RECORD.replace(" array<string>", "").split(", ")
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(5):
        lines = [json.dumps(dict(zip([n.split()[0] for n in names], r))) for r in rows[k * 100 : k * 100 + 100]]
        (folder / f"{k}.json").write_text("\n".join(lines))
    source = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).json(str(folder))
    stream.merge_batches(source, str(tmp_path / "t"), str(tmp_path / "c"), buckets=8).awaitTermination()
    table = BucketedTable(spark, str(tmp_path / "t"), buckets=8)
    want = write_side.dedupe_richest(spark.createDataFrame(rows, RECORD))
    assert sorted(map(tuple, table.read(RECORD).select("id", "seq").collect())) == sorted(map(tuple, want.select("id", "seq").collect()))
    assert len(table.versions()) == 2


def test_sessions_of_a_stream_with_late_rows(spark, tmp_path):
    """A late row joins two sessions while the watermark allows it, and is dropped after that."""
    at = lambda minutes: (datetime(2026, 1, 1) + timedelta(minutes=minutes)).isoformat()
    batches = [
        [("a", 0), ("a", 50), ("b", 5)],
        [("a", 25), ("b", 300)],  # between the two: one session of three
        [("c", 600)],
        [("b", 6), ("c", 610)],  # too late by now
        [("d", 2000)],
        [("d", 2001)],
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    for k, batch in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"user": u, "ts": at(m)}) for u, m in batch))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by their age
    source = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(folder))
    found = stream.sessions(source, "user", gap="30 minutes", delay="1 hour")
    name = "sessions_of_a_test"
    running = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = {(r.user, r.n, r.last.isoformat()) for r in spark.table(name).collect()}
    assert got == {("a", 3, at(50)), ("b", 1, at(5)), ("b", 1, at(300)), ("c", 2, at(610))}
    # The same function over a table sees every row.
    rows = spark.createDataFrame([(u, m) for b in batches for u, m in b], "user string, m int").select("user", (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("m"))).alias("ts"))
    whole = {(r.user, r.n) for r in stream.sessions(rows, "user", gap="30 minutes").collect()}
    assert whole == {("a", 3), ("b", 2), ("b", 1), ("c", 2), ("d", 2)}


def plainly_inside(ring, x, y):
    crossings = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            crossings += 1
    return crossings % 2 == 1


def test_polygons_against_ray_casting(spark):
    rng = random.Random(3)
    rings = [[(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(rng.randint(3, 12))] for _ in range(15)] + [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(0.0, 0.0)], [(-8, -8), (8, -8), (8, 8), (-8, 8)]]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(1500)] + [(2000, 0.0, 0.0), (2001, 10.0, 10.0), (2002, 5.0, 10.0), (2003, 8.0, 8.0), (2004, None, 1.0), (2005, -8.0, -8.0)]
    rings = [[(float(x), float(y)) for x, y in ring] for ring in rings]
    polygons = spark.createDataFrame(list(enumerate(rings)), f"polygon int, ring {places.RING}")
    df = spark.createDataFrame(points, "n int, lng double, lat double")
    want = {(n, k) for n, x, y in points if x is not None for k, ring in enumerate(rings) if len(ring) > 2 and plainly_inside(ring, x, y)}
    for size in (3.0, 8.0, 200.0):
        got = [(r.n, r.polygon) for r in places.points_in(df, polygons, size).select("n", "polygon").collect()]
        assert len(got) == len(want) and set(got) == want
    inner = places.cells(polygons, 1.0).where("whole").groupBy("polygon").count()
    assert {r.polygon: r["count"] for r in inner.collect()}[17] == 14 * 14  # all but the outermost cells, which an edge touches on either side


@pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")
def test_regions_as_polygons_are_the_boxes(spark):
    venues = star.venues(spark, str(DATA)).unionByName(star.venues(spark, str(DATA)).withColumns({"id": F.lit("edge"), "lng": F.lit(-118.37), "lat": F.lit(34.02)})).drop("region")
    by_box = {(r.id, r.lng, r.region) for r in read_side.regions_of(venues).collect() if r.region}
    by_ring = {(r.id, r.lng, r.polygon) for r in places.points_in(venues, places.region_rings(spark), 0.05).collect()}
    assert by_box == by_ring and ("edge", -118.37, "central") in by_ring


def test_a_hot_day_is_many_tasks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.lit("today")).otherwise(F.concat(F.lit("day "), (F.col("id") % 70).cast("string"))).alias("day"), F.hash("id").alias("at"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = read_side.numbered(rows, [F.col("at").asc(), F.col("seq").asc()], within="day").withColumn("task", F.spark_partition_id())
        assert got.where("day = 'today'").select("task").distinct().count() > 2
        found = {r.seq: r.place for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    days = {}
    for r in rows.collect():
        days.setdefault(r.day, []).append((r.at, r.seq))
    assert found == {s: k for day in days.values() for k, (_, s) in enumerate(sorted(day), 1)}
    assert read_side.numbered(rows.where("false"), [F.col("seq").asc()], within="day").count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "day string, seq int")
    assert {r.seq: r.place for r in read_side.numbered(nulls, [F.col("seq").asc()], within="day").collect()} == {1: 1, 2: 2, 3: 1}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
