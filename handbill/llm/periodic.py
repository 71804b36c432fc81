"""Periodic runs of words by divide and conquer.

Words are numbered; a document is halved again and again. A run that crosses the
middle of a node reaches two periods far into its left or its right half, so its
period is a distance between equal words there. For the nodes that have such a
distance, Z-functions from the middle tell how far each period holds to both
sides. All documents of a batch go down a level at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import ship

#: Words of the shortest run, and periods that it holds at least.
MIN_LENGTH = 6
EXPONENT = 4
#: Words that a task works on at once; a longer document is worked on alone.
AT_ONCE = 500_000
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def z_function(s: list[int]) -> np.ndarray:
    """For each place how many values from there on are those that ``s`` begins with; 0 for the first."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return np.array(z, np.int64)


def crossing(w: np.ndarray, lo: int, mid: int, hi: int, periods: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches around ``mid`` that hold each of the periods, within lo and hi.

    ``right``: a period is the distance from the middle to a place after it, else to one before it.
    """
    whole, a, b = w[lo:hi].tolist(), w[lo:mid].tolist(), w[mid:hi].tolist()
    if right:
        after = z_function(b)[periods]
        before = z_function(a[::-1] + [-1] + whole[::-1])[len(a) + 1 + hi - mid - periods]
        return mid - before, mid + periods + after
    after = z_function(b + [-1] + whole)[len(b) + 1 + mid - lo - periods]
    before = z_function(a[::-1])[periods]
    return mid - periods - before, mid + after


def distances(w: np.ndarray, mid: np.ndarray, most: np.ndarray, known: np.ndarray, follows: np.ndarray, keys: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, period): the distances up to ``most`` at which the word beside ``mid`` comes again and two periods look equal.

    ``side``: 1 looks from mid on, -1 from the word before it backwards. ``follows``: the distance to the next equal word on that side.
    ``known``: the period of a run that holds the whole node, or 0; its multiples tell nothing new.
    """
    at = mid if side > 0 else mid - 1
    near = np.flatnonzero(follows[at] <= most)
    base = w[at[near]] * len(w) + at[near]
    first, last = (base + 1, base + most[near]) if side > 0 else (base - most[near], base - 1)
    begin, end = np.searchsorted(keys, first), np.searchsorted(keys, last, "right")
    counts = end - begin
    node = np.repeat(near, counts)
    index = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    period = np.abs(keys[index] - np.repeat(base, counts))
    looks_equal = (known[node] == 0) | (period % np.maximum(known[node], 1) != 0)
    for offset in (period - 1, period // 2):
        start = at[node] + side * offset
        looks_equal &= w[start] == w[start + side * period]
    node, period = node[looks_equal], period[looks_equal]
    return node, period


def find_runs(w: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """(start, end, period) of all runs in the documents w[bounds[i]:bounds[i + 1]], sorted; ``exponent`` is 4 or more.

    Words are numbers from 0 on. Places are those in ``w``.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 or more: only then a run reaches two periods into a half")
    n = len(w)
    w = w.astype(np.int64)
    keys = np.sort(w * n + np.arange(n)) if n else w
    places = keys % max(n, 1)
    step = np.where(np.diff(w[places]) == 0, np.diff(places), n + 1)
    after, before = np.full(n, n + 1), np.full(n, n + 1)
    after[places[:-1]], before[places[1:]] = step, step
    # The document that each place belongs to, by its bounds, for runs that a node cuts off.
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    doc_lo, doc_hi, known = lo, hi, np.zeros(len(lo), np.int64)
    found = [np.zeros((0, 3), np.int64)]
    while True:
        large = hi - lo >= min_length
        lo, hi, doc_lo, doc_hi, known = lo[large], hi[large], doc_lo[large], doc_hi[large], known[large]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        known_below = [known.copy(), known.copy()]
        for side, follows, half in ((1, after, hi - mid), (-1, before, mid - lo)):
            node, period = distances(w, mid, np.minimum(half // 2, (hi - lo) // exponent), known, follows, keys, side)
            order = np.argsort(node, kind="stable")
            node, period = node[order], period[order]
            cuts = np.flatnonzero(np.diff(node)) + 1
            for own, periods in zip(node[np.append(0, cuts)] if len(node) else (), np.split(period, cuts)):
                start, end = crossing(w, lo[own], mid[own], hi[own], periods, side > 0)
                keep = (end - start >= min_length) & (end - start >= exponent * periods)
                start, end, periods = start[keep], end[keep], periods[keep]
                for below, holds in zip(known_below, (start <= lo[own], end >= hi[own])):
                    if holds.any():
                        below[own] = periods[holds].min()
                # What goes on beyond its node crosses the middle of one above, which has found it whole.
                ahead = (start > doc_lo[own]) & (w[start - 1] == w[np.minimum(start - 1 + periods, n - 1)])
                behind = (end < doc_hi[own]) & (w[np.minimum(end, n - 1)] == w[end - periods])
                keep = ~ahead & ~behind
                found.append(np.stack([start[keep], end[keep], periods[keep]], 1))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        doc_lo, doc_hi, known = np.tile(doc_lo, 2), np.tile(doc_hi, 2), np.concatenate(known_below)
    runs = np.unique(np.concatenate(found), axis=0)
    # Multiples of a period hold in the same stretch: the smallest is kept.
    first = np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(axis=1))[: len(runs)]
    return runs[first]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, *carry, n_words, runs, collapsed) of every row of ``docs``.

    ``runs`` are (start, length, period) in word numbers, by start and period: the
    stretches of at least ``min_length`` words and ``exponent`` periods that no
    neighbour prolongs, each with its smallest period. ``collapsed`` is the text's
    words, joined by a space, without what a run holds after its first period.
    A null or empty text has no words. Rows with one id, or none, keep a row each.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kept = rows.drop("_text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            start, held, size = 0, [], 0
            for i in range(len(column)):
                # White space that divides words is ASCII; a text in bytes is split at just that.
                held.append(column[i].as_py().encode("utf-8", "surrogatepass").split())
                size += len(held[-1])
                if size >= AT_ONCE or i + 1 == len(column):
                    others = [batch.column(k).slice(start, len(held)) for k in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*others, *told(held, min_length, exponent)], [*kept.names, "n_words", "runs", "collapsed"])
                    start, held, size = i + 1, [], 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, n_words bigint, runs {RUN}, collapsed string")


def told(documents: list[list[bytes]], min_length: int, exponent: int) -> list[pa.Array]:
    """The columns n_words, runs and collapsed of some documents."""
    sizes = np.array([len(x) for x in documents], np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in chain.from_iterable(documents)), np.int64, int(bounds[-1]))
    runs = find_runs(w, bounds, min_length, exponent)
    owner = np.searchsorted(bounds, runs[:, 0], "right") - 1
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    has = np.bincount(owner, minlength=len(documents))
    collapsed = [b" ".join(compress(x, stays[a:b].tolist()) if k else x).decode("utf-8", "surrogatepass") for x, a, b, k in zip(documents, bounds, bounds[1:], has)]
    parts = [runs[:, 0] - bounds[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in parts], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has)).astype(np.int32)), each)
    return [pa.array(sizes), listed, pa.array(collapsed, pa.string())]
