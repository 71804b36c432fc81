"""Places in a whole order, numbered range by range."""

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from handbill.operators import read_side
from handbill.plans import registry


def test_numbered_gives_each_row_its_place(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 13).alias("k"), F.col("id").alias("seq"))
    got = read_side.numbered(rows, [F.col("k").desc_nulls_first(), F.col("seq").desc()])
    found = {r.seq: r.place for r in got.collect()}
    want = sorted(range(5000), key=lambda i: (i % 7 > 0, -(i % 13) if i % 7 else 0, -i))
    assert found == {i: n for n, i in enumerate(want, 1)}
    assert read_side.numbered(rows.where("false"), [F.col("seq").asc()]).count() == 0


@pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["archive_order", "ending_soonest", "exhibitions_by_venue", "stack_by_venue"])
def test_order_is_not_made_by_one_task(spark, name):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = registry.QUERIES[name](spark, str(DATA))
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
