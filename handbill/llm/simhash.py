"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``max_bits`` or fewer differing bits. Equal ones
are one class from the start, so a group of copies is one row in all that
follows. The 64 bits are split into partitions, correlated bits together. If
partition i gets a threshold T_i and the thresholds sum to max_bits - parts + 1,
then linked fingerprints differ in at most T_i bits in some partition i; -1
leaves a partition out. Each fingerprint gets the thresholds of least cost, by
dynamic programming over estimated candidate counts, so it avoids partitions in
which its value is common. It then probes all values within T_i of its own,
and candidates are verified within the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import cut, ship, spread_join

BITS = 64
MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: A probe costs as much as so many candidates.
PROBE_COST = 2.0
#: Bits of a partition that the candidate counts tell apart: at most 2**16 counts a partition.
COUNTED_BITS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, unsigned; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # so that a very long text needs no more memory
        some = np.array(hashes[at : at + 65536], np.uint64).byteswap().view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row a row of ``docs``; fp is the fingerprint as a signed long. A null text is empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def bit_groups(distinct: DataFrame, parts: int) -> list[list[int]]:
    """The bits of each partition: from each seed on, the bit that correlates most with those taken.

    What comes to the driver is one sum for each pair of bits, 4096 in all.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = unpacked(batch.column(0).to_numpy(zero_copy_only=False))
            total, n = total + bits.T @ bits, n + len(bits)
        flat = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["k", "v"])

    rows = distinct.select("fp").mapInArrow(products, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(BITS * BITS + 1)
    for k, v in rows:
        sums[k] = v
    n = max(1.0, sums[-1])
    both = sums[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    like = np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    left, groups = set(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        pool = sorted(left)
        group = [max(pool, key=lambda b: (like[b, pool].sum(), -b))]
        while len(group) < size:
            pool = sorted(left - set(group))
            group.append(max(pool, key=lambda b: (like[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def unpacked(fps: np.ndarray) -> np.ndarray:
    """A row of 64 floats a fingerprint, the lowest bit first."""
    return ((fps.view(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)


def projected(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of one partition, packed."""
    out = np.zeros(len(fps), np.uint64)
    for to, bit in enumerate(group):
        out |= ((fps.view(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out.astype(np.int64)


def ball_sizes(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """Estimated number of fingerprints within 0..most bits of each counted value of a partition.

    Exact for a partition of COUNTED_BITS or fewer; the bits beyond are taken as evenly spread.
    """
    counted = min(width, COUNTED_BITS)
    exact = [counts.astype(np.float64)] + [np.zeros(len(counts)) for _ in range(most)]
    at = np.arange(len(counts))
    for b in range(counted):
        flipped = [x[at ^ (1 << b)] for x in exact]
        for t in range(most, 0, -1):
            exact[t] = exact[t] + flipped[t - 1]
    rest = width - counted
    spread = [sum(exact[j] * math.comb(rest, t - j) for j in range(t + 1)) / 2.0**rest for t in range(most + 1)]
    return np.cumsum(np.stack(spread), axis=0)


def allocate(costs: list[np.ndarray], total: int, most: int) -> np.ndarray:
    """Thresholds (-1..most) a partition and row that sum to ``total`` at least cost.

    ``costs[i]`` has a row for each threshold from 0 on; -1 costs nothing.
    """
    n = costs[0].shape[1]
    low, high = -len(costs), max(total + len(costs), 1)
    best = {0: np.zeros(n)}
    picks: list[dict[int, np.ndarray]] = []
    for cost in costs:
        step: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for s, so_far in best.items():
            for t in range(-1, most + 1):
                if not low <= s + t <= high:
                    continue
                now = so_far + (cost[t] if t >= 0 else 0.0)
                if s + t in step:
                    better = now < step[s + t]
                    step[s + t] = np.where(better, now, step[s + t])
                    pick[s + t] = np.where(better, t, pick[s + t])
                else:
                    step[s + t], pick[s + t] = now, np.full(n, t)
        best = step
        picks.append(pick)
    out, state = np.empty((len(costs), n), np.int64), np.full(n, total)
    for i in range(len(costs) - 1, -1, -1):
        for s, pick in picks[i].items():
            here = state == s
            out[i, here] = pick[here]
        state = state - out[i]
    return out


def masks(width: int, most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for t in range(most + 1) for c in combinations(range(width), t)], np.int64)


def parts_for(n: int) -> int:
    """Partitions for n distinct fingerprints: few enough that a partition's values tell them apart."""
    return 4 if n < 1 << 23 else 3 if n < 1 << 29 else 2


def links(distinct: DataFrame, max_bits: int = MAX_BITS, parts: int | None = None) -> DataFrame:
    """(a, b): all pairs of ``distinct`` (fp, no repeats) at ``max_bits`` or fewer bits, some in both orders.

    All pairs are found whatever ``parts`` is. The counts that the thresholds
    follow from are at most parts * 2**16 numbers, gathered from all rows.
    """
    parts = parts or parts_for(distinct.count())
    groups, total = bit_groups(distinct, parts), max_bits - parts + 1
    kinds = [min(len(g), COUNTED_BITS) for g in groups]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << k, np.int64) for k in kinds]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for s, g, k in zip(seen, groups, kinds):
                s += np.bincount(projected(fps, g) & ((1 << k) - 1), minlength=1 << k)
        for i, s in enumerate(seen):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) * parts + i), pa.array(s[at])], ["k", "v"])

    tally = distinct.select("fp").mapInArrow(cells, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    k, v = tally["k"].to_numpy(), tally["v"].to_numpy()
    counts = [np.zeros(1 << w, np.int64) for w in kinds]
    for i in range(parts):
        counts[i][k[k % parts == i] // parts] = v[k % parts == i]
    balls = [ball_sizes(c, len(g), max_bits) for c, g in zip(counts, groups)]
    sent = distinct.sparkSession.sparkContext.broadcast(balls)
    wanted = [[masks(len(g), t) for t in range(max_bits + 1)] for g in groups]

    def rows_of(parts_of: list[np.ndarray], fps_of: list[np.ndarray], name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts_of)), pa.array(np.concatenate(fps_of))], [f"{name}_cell", name])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            yield rows_of([projected(fps, g) * parts + i for i, g in enumerate(groups)], [fps] * parts, "b")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys = [projected(fps, g) for g in groups]
            costs = [
                ball[:, key & ((1 << w) - 1)] + PROBE_COST * np.array([[len(m)] for m in own])
                for ball, key, w, own in zip(sent.value, keys, kinds, wanted)
            ]
            chosen = allocate(costs, total, max_bits)
            for i in range(parts):
                for t in range(max_bits + 1):
                    at = np.flatnonzero(chosen[i] == t)
                    for some in np.array_split(at, len(at) * len(wanted[i][t]) // 500_000 + 1):
                        if len(some):
                            near = (keys[i][some, None] ^ wanted[i][t][None, :]) * parts + i
                            yield rows_of([near.ravel()], [np.repeat(fps[some], near.shape[1])], "a")

    probes = distinct.select("fp").mapInArrow(probe, "a_cell long, a long")
    indexed = distinct.select("fp").mapInArrow(index, "b_cell long, b long")
    close = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return probes.join(indexed, (F.col("a_cell") == F.col("b_cell")) & close).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the smallest node that it reaches.

    Alternating large and small stars until only stars are left; each round is
    checkpointed, and only a truth value comes to the driver.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs: (u, v), v a neighbour of u. Least neighbour of each u, or u itself.
        least = pairs.groupBy(F.col("u").alias("hub")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = spread_join(pairs, least, {"u": "hub"})
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            own = least.select(F.col("hub").alias("u"), F.col("m").alias("v"))
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
        return down(out)

    def down(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def only_stars(pairs: DataFrame) -> bool:
        # Each u has one v and is no v itself: every group is a star around its least node.
        nodes = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        nodes = nodes.unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        per_node = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return per_node.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

    pairs = cut(down(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    while not only_stars(pairs):
        # A large star reads all neighbours of u; a small star only those below u.
        pairs = cut(star(star(both(pairs), True), False))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = MAX_BITS,
    shingle: int = SHINGLE,
    parts: int | None = None,
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id among the documents a row is linked to.

    A null text is empty; texts without words have fingerprint 0 and link like
    all others. Rows that share an id keep a row each. A null id is never the
    smallest unless a whole component has no other, and is null then. An empty
    table gives an empty result.
    """
    return grouped(cut(fingerprints(docs, id_col, text_col, shingle)), max_bits, parts)


def grouped(marked: DataFrame, max_bits: int = MAX_BITS, parts: int | None = None) -> DataFrame:
    """near_duplicates() of rows (doc_id, fp) whose fingerprints are known; ``marked`` is read more than once."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components(links(distinct, max_bits, parts))
    rooted = distinct.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    smallest = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    classes = spread_join(rooted, smallest, {"root": "r"}).select(F.col("fp").alias("class"), "component_id")
    return spread_join(marked, classes, {"fp": "class"}).select("doc_id", "fp", "component_id")
