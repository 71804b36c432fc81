"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the sets of its words, word beginnings, word pairs and pairs
with one word between, hashed into 2**BUCKET_BITS buckets. They are computed on
all executors; training reads those of a bounded sample of labelled documents in
one task. Per-coordinate rates and L1 leave few weights other than 0, which are
broadcast to score every document. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import cut, ship

BUCKET_BITS = 22
#: Labelled documents that are trained on, at most; all others of the labelled are left out by a hash of the id.
TRAIN_DOCS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.2, 1.0, 3.0, 0.5
THRESHOLD = 0.3
STEMS = (4, 5)
WORD = re.compile(r"\w+")
#: Odd multipliers that tell the places of a pair, and kinds of features, apart.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
MEMO_WORDS = 300_000


class Features:
    """Hashed features of texts; remembers the hashes of words that it met."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}
        self.hashes: list[tuple[int, ...]] = []

    def place(self, word: str) -> int:
        at = self.memo.get(word)
        if at is None:
            digest = xxhash.xxh64_intdigest
            # A word of the stem's length is its own stem; a shorter one has none.
            stems = [digest(word[:n], n) if len(word) >= n else 0 for n in STEMS]
            at = self.memo[word] = len(self.hashes)
            self.hashes.append((digest(word), *stems))
        return at

    def of(self, text: str | None) -> np.ndarray:
        """Bucket numbers, repeats included."""
        words = WORD.findall((text or "").lower())
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.hashes = {}, []
        at = [self.place(w) for w in words]
        table = np.array([self.hashes[i] for i in at], np.uint64).reshape(-1, 1 + len(STEMS))
        h = table[:, 0]
        with np.errstate(over="ignore"):
            mix = [np.uint64(m) for m in MIX]
            pairs = h[:-1] * mix[1] + h[1:] * mix[2]
            skips = h[:-2] * mix[3] + h[2:] * mix[4]
            stems = [s[s > 0] for s in table[:, 1:].T]
            return (np.concatenate([h, *stems, pairs, skips]) * mix[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def training_set(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(order, label, buckets) of the labelled documents that are trained on, ``most`` at most.

    A document with several labels takes the largest; null labels are none. An
    id with several texts is trained on the one with the least hash, so the rows
    are as bounded as the ids, and no two share their place in the order.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.withColumn("order", F.md5(F.col("_id").cast("string"))).orderBy("order", "_id").limit(most)
    # ``most`` ids at most, so the broadcast is bounded.
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_id")
    joined = joined.groupBy("order", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [np.unique(features.of(x.as_py())).astype(np.int32) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], ["order", "label", "buckets"])

    return joined.select("order", "label", "text").mapInArrow(run, "order string, label int, buckets array<int>")


def ftrl(rows: list[tuple[int, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, buckets and weights other than 0, by FTRL-proximal passes over the rows in their order."""
    z, n = np.zeros((1 << BUCKET_BITS) + 1), np.zeros((1 << BUCKET_BITS) + 1)
    bias = 1 << BUCKET_BITS  # its own coordinate, without L1

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        limit = np.where(at == bias, 0.0, L1)
        w = -(own - np.sign(own) * limit) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(own) > limit, w, 0.0)

    for _ in range(EPOCHS):
        for label, buckets in rows:
            at = np.append(buckets, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
    used = np.flatnonzero(np.abs(z[:-1]) > L1)
    return float(weights(np.array([bias]))[0]), used, weights(used)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS) -> tuple[float, np.ndarray, np.ndarray]:
    """The model as (bias, buckets, weights). Without labelled documents it is (0, none, none)."""
    ship(docs.sparkSession)
    rows = cut(training_set(docs, labels, id_col, text_col, label_col, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for order, label, buckets in zip(*batch.columns):
                held.append((order.as_py(), label.as_py(), buckets.values.to_numpy(zero_copy_only=False)))
        held.sort(key=lambda r: r[0])  # a digest of the id, unlike for each row
        bias, buckets, weights = ftrl([(label, b) for _, label, b in held])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(buckets, -1)), pa.array(np.append(weights, bias))], ["bucket", "weight"])

    # One task: the sample is bounded, and FTRL takes its rows in turn.
    found = rows.coalesce(1).mapInArrow(run, "bucket long, weight double").toArrow()
    buckets, weights = found["bucket"].to_numpy(), found["weight"].to_numpy()
    bias = float(weights[buckets < 0][0]) if len(weights) else 0.0
    return bias, buckets[buckets >= 0], weights[buckets >= 0]


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of ``docs``, from the text alone; a null text scores as an empty one does."""
    spark = docs.sparkSession
    ship(spark)
    bias, buckets, weights = model
    sent = spark.sparkContext.broadcast((bias, buckets.astype(np.int32), weights.astype(np.float64)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, at, w = sent.value
        dense = np.zeros(1 << BUCKET_BITS)
        dense[at] = w
        features = Features()
        for batch in batches:
            sums = []
            for x in batch.column(1):
                found = features.of(x.as_py())
                found = np.unique(found[dense[found] != 0])
                sums.append(start + dense[found].sum())
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, with a model trained on ``labels``.

    A null id is not held out, and is never trained on. Rows that share an id
    keep a row each, scored by their own text. A null text scores as an empty one;
    of a very long text all words count. An empty table gives an empty result.
    """
    scored = score(docs, train(docs, labels, id_col, text_col, label_col, most), id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
