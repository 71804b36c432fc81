"""Near copies by the Jaccard similarity of their word shingles: SimHash and MinHash bands give candidates, whole shingle sets decide.

Equal texts are one class from the start. Texts that SimHash links, at 3 or fewer of
64 bits and over any number of links, are a cell of their own. As few bits can't tell
all pairs of that similarity, each distinct text has BANDS more cells, a hash of ROWS minima each; two texts of similarity s share a cell with
probability 1 - (1 - s**ROWS)**BANDS, 0.998 at 0.8. A pair links if its own
shingle sets are similar enough. Its texts are fetched for that only if enough
of its minima agree, told by one byte each; of similar pairs fewer than one in
100,000 falls short of that. What shares a SimHash cell passes the same check as what shares a band.

The first round takes two hubs of each cell, the text that meets most others over
all of its cells, which is the middle of a group, and the one with the least key,
and holds them against all others there: most groups are joined by that. Cells whose
texts aren't all joined then are settled inside tasks: a cell, or two blocks of a
large one, is one task's group, where sketches tell which unjoined texts may be
similar, shingle sets decide, and only links that join something leave the task. A
pair is looked at in the first band that its texts share. So each pair of a cell
is either verified or already joined, and no pairs are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import cut, ship, spread_join
from handbill.llm.simhash import SEED, components, fingerprint, grouped

SHINGLE = 5
#: Similarity from which two texts are near copies, in hundredths.
PERCENT = 80
BANDS = 20
ROWS = 6
#: Texts of a block of a large cell; a task's group holds two at most.
BLOCK = 256
#: Odd factors and summands of the permutations.
FACTORS, SUMMANDS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a text's shingles under each permutation; all texts without words share theirs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):  # so that a very long text needs no more memory
        least = np.minimum(least, (found[None, at : at + 1024] * FACTORS[:, None] + SUMMANDS[:, None]).min(axis=1))
    return least


def cells(least: np.ndarray) -> list[int]:
    """The cells of a text from its minima."""
    return [xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))]


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two shingle sets have that similarity; two empty ones do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def key_of(text_col: str = "text") -> Column:
    """A long that stands for a text; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def must_agree(percent: int) -> int:
    """How many minima agree at least in a pair of that similarity: five standard deviations below their mean."""
    n, p = BANDS * ROWS, percent / 100
    return max(0, math.floor(n * p - 5 * math.sqrt(n * p * (1 - p))))


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(key, cells, sign, fp): once for each text of ``docs`` (key, text); ``sign`` is the last byte of each of its minima, ``fp`` its SimHash."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [minima(shingles(x.as_py(), shingle)) for x in batch.column(1)]
            found = np.array([cells(x) for x in least], np.uint64).reshape(-1, BANDS).view(np.int64)
            at = pa.array(np.arange(0, BANDS * (len(found) + 1), BANDS, dtype=np.int32))
            signs = pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary())
            fps = pa.array(np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(found.ravel())), signs, fps], ["key", "cells", "sign", "fp"])

    return cut(docs.mapInArrow(sketch, "key long, cells array<long>, sign binary, fp long").dropDuplicates(["key"]))


def with_simhash(sketched: DataFrame) -> DataFrame:
    """``sketched`` (key, cells, sign, fp) with a cell more, the last: that of all texts that SimHash links with its own."""
    found = grouped(sketched.select(F.col("key").alias("doc_id"), "fp")).select(F.col("doc_id").alias("k"), F.xxhash64(F.lit("simhash"), "component_id").alias("linked"))
    return cut(sketched.join(found, F.col("key") == F.col("k")).select("key", F.concat("cells", F.array("linked")).alias("cells"), "sign"))


def cell_rows(sketched: DataFrame) -> DataFrame:
    """(key, cell, n): a row for each cell that a text of ``sketched`` (key, cells) shares with n - 1 others."""
    rows = sketched.select("key", F.explode("cells").alias("cell"))
    shared = rows.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(spread_join(rows, shared, {"cell": "c"}).select("key", "cell", "n"))


def agreeing(signs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b: keys) of which as many minima agree as similar texts must have, by ``signs`` (key, sign)."""
    least = must_agree(percent)
    named = lambda k, s: signs.select(F.col("key").alias(k), F.col("sign").alias(s))
    both = spread_join(spread_join(pairs, named("k", "sign_a"), {"a": "k"}).drop("k"), named("k", "sign_b"), {"b": "k"})

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for x in batch.columns[2:])
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(keep)

    return cut(both.select("a", "b", "sign_a", "sign_b").mapInArrow(agree, "a long, b long"))


def linked(docs: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b: keys) whose texts in ``docs`` (key, text) are similar."""
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    texts = cut(spread_join(docs, wanted, {"key": "w"}, "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    named = lambda k, t: texts.select(F.col("key").alias(k), F.col("text").alias(t))
    both = spread_join(spread_join(pairs, named("k", "text_a"), {"a": "k"}).drop("k"), named("k", "text_b"), {"b": "k"})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)  # a hub's rows follow one another
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, held = b, shingles(text_b.as_py(), shingle)
                keep.append(similar(shingles(text_a.as_py(), shingle), held, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"))


def pairs_of(met: DataFrame) -> DataFrame:
    """(a, b): the distinct pairs of ``met`` (key, hub)."""
    return cut(met.select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct())


def settled(cell: int, keys: np.ndarray, roots: np.ndarray, signs: np.ndarray, cells_of: np.ndarray, texts: list[str], first: np.ndarray, shingle: int, percent: int) -> list[tuple[int, int]]:
    """Links (a, b: keys) that join what similar pairs of a cell's texts join; ``roots`` tells what is joined already.

    ``first`` marks the texts of the first of two blocks: only pairs across count then. If all are marked, all pairs do.
    """
    band = int(np.argmax(cells_of[0] == cell))
    least, sets, out = must_agree(percent), {}, []
    roots = roots.copy()

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(texts[i], shingle)
        return sets[i]

    whole = bool(first.all())
    for i in range(len(keys)):
        if not first[i]:
            continue
        others = np.arange(i + 1, len(keys)) if whole else np.flatnonzero(~first)
        others = others[roots[others] != roots[i]]
        if not len(others):
            continue
        agree = (signs[others] == signs[i]).sum(axis=1)
        # Pairs that share an earlier band are looked at there.
        mine = (agree >= least) & ~(cells_of[others, :band] == cells_of[i, :band]).any(axis=1)
        for j in others[mine][np.argsort(-agree[mine], kind="stable")].tolist():
            if roots[i] != roots[j] and similar(set_of(i), set_of(j), percent):
                out.append((int(keys[i]), int(keys[j])))
                roots[roots == roots[j]] = roots[i]
    return out


def settle(left: DataFrame, sketched: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): the links among the texts of cells, ``left`` (key, cell, root, n: texts of the cell), that aren't joined yet."""
    wanted = left.select(F.col("key").alias("w")).distinct()
    texts = spread_join(docs, wanted, {"key": "w"}, "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    known = cut(sketched.join(texts.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select(F.col("key").alias("k"), "cells", "sign", "text"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key", "cell"), blocks).cast("int")
    # A text goes to one group for each block of its cell, its own included.
    placed = left.select("key", "cell", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    rows = spread_join(placed, known, {"key": "k"}).select("cell", "lo", "hi", "key", "root", "own", "cells", "sign", "text")

    def run(table: pa.Table) -> pa.Table:
        group = table.combine_chunks()
        keys, at = np.unique(group.column("key").to_numpy(), return_index=True)
        group = group.take(pa.array(at))
        signs = np.frombuffer(b"".join(group.column("sign").to_pylist()), np.uint8).reshape(len(keys), -1)
        cells_of = np.array(group.column("cells").to_pylist(), np.int64)
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        first = group.column("own").to_numpy() == lo
        links = settled(group.column("cell")[0].as_py(), keys, group.column("root").to_numpy(), signs, cells_of, group.column("text").to_pylist(), first, shingle, percent) if lo == hi or not first.all() else []
        return pa.table({"a": pa.array([max(x) for x in links], pa.int64()), "b": pa.array([min(x) for x in links], pa.int64())})

    return cut(rows.groupBy("cell", "lo", "hi").applyInArrow(run, "a long, b long"))


def groups(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, root): for the key of each text with a near copy, the least key that it reaches; other texts have no row."""
    ship(docs.sparkSession)
    docs = docs.select(key_of(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sketched = with_simhash(sketches(docs, shingle))
    rows = cell_rows(sketched)
    signs = cut(sketched.select("key", "sign").join(rows.select(F.col("key").alias("k")).distinct(), F.col("key") == F.col("k"), "left_semi"))

    def links(met: DataFrame) -> DataFrame:
        return linked(docs, agreeing(signs, pairs_of(met), percent), shingle, percent)

    met = rows.groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("met"))
    central = F.max(F.struct("met", F.negate("key").alias("less"), "key"))["key"]
    hubs = cut(rows.join(met, F.col("key") == F.col("k")).groupBy(F.col("cell").alias("c")).agg(F.array(central, F.min("key")).alias("hubs")))
    at_hubs = spread_join(rows, hubs, {"cell": "c"})
    roots = components(links(at_hubs.select("key", F.explode("hubs").alias("hub")).where("key <> hub")))
    # Of two texts, one is a hub and has met the other.
    named = rows.join(roots, F.col("key") == F.col("node"), "left").select("key", "cell", F.coalesce("root", "key").alias("root"))
    spread = named.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    left = cut(spread_join(named, spread.where("lo <> hi AND n > 2").select("c", "n"), {"cell": "c"}).select("key", "cell", "root", "n"))
    more = settle(left, sketched, docs, shingle, percent)
    if not more.isEmpty():
        roots = components(more.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return roots.select(F.col("node").alias("key"), "root")
