"""Byte-level BPE by recursive DuckDB queries in every partition.

Texts are split into pieces in the JVM. A task numbers its distinct pieces; those
that are no token themselves become rows of token positions in DuckDB, which a
recursive query joins with the merge table: each step contracts the leftmost pair
of least rank of each piece, until no piece has a pair left. Decoding joins ids
with the tokens' bytes and aggregates them in order. The rank file is a parameter.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import ship

#: Pieces that a worker remembers, and pieces or tokens that it works on at once.
MEMO_PIECES = 400_000
AT_ONCE = 1_000_000
#: Bytes of new pieces in one recursive query; a longer piece has one of its own.
QUERY_BYTES = 1 << 20
#: Bytes up to which the pieces of a query take a pair a step; longer ones take all pairs a step that can't meet.
SHORT_PIECE = 64

#: One row a piece, its tokens as a list. Places are those of pairs, from 1 on.
SHORT = """
WITH RECURSIVE pieces(w, tokens, done) AS (
    SELECT w, list(t ORDER BY p), false FROM start GROUP BY w
    UNION ALL (
        WITH pairs AS (
            SELECT w, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b, unnest(range(1, len(tokens))) AS place FROM pieces WHERE NOT done
        ), best AS (
            SELECT w, min(made::BIGINT << 20 | place) AS pair FROM pairs JOIN merge ON pair = a::BIGINT << 32 | b GROUP BY w
        )
        SELECT pieces.w,
               CASE WHEN pair IS NULL THEN tokens ELSE tokens[:(pair & 1048575) - 1] || [(pair >> 20)::INTEGER] || tokens[(pair & 1048575) + 2:] END,
               pair IS NULL
        FROM pieces LEFT JOIN best ON pieces.w = best.w WHERE NOT done
    )
)
SELECT w, tokens FROM pieces WHERE done
"""

#: One row a token, its place the key ``g``: piece << 40 | position. A pair is a candidate if its rank is the least within {reach}
#: tokens, the length of the longest: no merge from further off can reach it. Candidates that near each other form a chain of one
#: rank. A chain waits if an equal pair before it isn't a candidate yet. Of candidates that follow one another every other one is
#: contracted, and none behind one whose new neighbours might come before the rest of the chain ("early").
LONG = """
WITH RECURSIVE rows_of(g, t, done) AS (
    SELECT w::BIGINT << 40 | p, t, false FROM start
    UNION ALL (
        WITH placed AS (
            SELECT g, t, g >> 40 AS w, row_number() OVER o AS i, lag(t) OVER o AS l, lead(t) OVER o AS r, lead(t, 2) OVER o AS r2, lead(g) OVER o AS h
            FROM rows_of WHERE NOT done WINDOW o AS (PARTITION BY g >> 40 ORDER BY g)
        ), paired AS (
            SELECT placed.*, made FROM placed LEFT JOIN merge ON pair = t::BIGINT << 32 | r
        ), near AS (
            SELECT *, min(made) OVER (PARTITION BY w ORDER BY i ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least,
                   lag(i) OVER (PARTITION BY w, made ORDER BY i) AS tie, max(made) OVER (PARTITION BY w) IS NULL AS done
            FROM paired
        ), found AS (
            SELECT g, h, w, i, made, tie, i - row_number() OVER o AS run, coalesce(lag(i) OVER o < i - {reach}, true) AS first,
                   EXISTS (FROM merge m WHERE m.made < near.made AND m.pair IN (l::BIGINT << 32 | near.made, near.made::BIGINT << 32 | r2, near.made::BIGINT << 32 | near.made)) AS early
            FROM near WHERE made = least WINDOW o AS (PARTITION BY w ORDER BY i)
        ), chained AS (
            SELECT *, sum(first::INTEGER) OVER (PARTITION BY w ORDER BY i) AS chain, (i - min(i) OVER (PARTITION BY w, run)) % 2 AS odd FROM found
        ), chosen AS (
            SELECT g, h, made FROM (
                SELECT *, bool_or(first AND coalesce(tie >= i - {reach}, false)) OVER (PARTITION BY w, chain) AS waits,
                       coalesce(bool_or(early) OVER (PARTITION BY w, chain ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS behind
                FROM chained
            ) WHERE NOT waits AND NOT behind AND odd = 0
        )
        SELECT g, made, false FROM chosen
        UNION ALL
        SELECT g, t, done FROM near WHERE g NOT IN (SELECT unnest([g, h]) FROM chosen)
    )
)
SELECT g >> 40 AS w, list(t ORDER BY g) AS tokens FROM rows_of WHERE done GROUP BY 1
"""

DECODE = "SELECT d, unhex(string_agg(hex, '' ORDER BY p)) AS bytes FROM ids JOIN token ON token.id = ids.id GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The tables of a rank file in a DuckDB of this process."""

    def __init__(self, ranks: dict[bytes, int], short: int = SHORT_PIECE) -> None:
        self.ranks, self.short = ranks, short
        parts = [(a << 32 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        pairs = np.array(parts, np.int64).reshape(-1, 2)
        self.bytes = np.full(256, -1, np.int32)
        for t, r in ranks.items():
            if len(t) == 1:
                self.bytes[t[0]] = r
        self.long = LONG.format(reach=max(map(len, ranks), default=1))
        self.con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self.add("merge", pair=pa.array(pairs[:, 0]), made=pa.array(pairs[:, 1], pa.int32()))
        self.add("token", id=pa.array(list(ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in ranks]))

    def add(self, name: str, **columns: pa.Array) -> None:
        self.con.register("given", pa.table(columns))
        self.con.sql(f"CREATE TABLE {name} AS FROM given")
        self.con.unregister("given")

    def ask(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.con.register(name, table)
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has. A piece that is a token is its own id."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        sizes, parts, owners = np.where(whole >= 0, 1, 0), [whole[whole >= 0]], [np.flatnonzero(whole >= 0)]
        for sql, chosen in self.queries(pieces, np.flatnonzero(whole < 0).tolist()):
            joined = np.frombuffer(b"".join(pieces[i] for i in chosen), np.uint8)
            lengths = np.array([len(pieces[i]) for i in chosen], np.int64)
            own = np.repeat(np.arange(len(chosen), dtype=np.int32), lengths)
            places = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if (self.bytes[joined] < 0).any():
                raise ValueError("the ranks lack a byte of a text")
            found = self.ask(sql, "start", pa.table({"w": own, "p": places.astype(np.int32), "t": self.bytes[joined]}))
            lists = found.column("tokens").combine_chunks()
            at = np.array(chosen)[found.column("w").to_numpy()]
            sizes[at] = np.diff(lists.offsets.to_numpy())
            parts.append(lists.flatten().to_numpy())
            owners.append(np.repeat(at, sizes[at]))
        return np.concatenate(parts)[np.argsort(np.concatenate(owners), kind="stable")], sizes

    def queries(self, pieces: list[bytes], places: list[int]) -> Iterator[tuple[str, list[int]]]:
        """The places of the pieces of each recursive query, about QUERY_BYTES in all."""
        held: dict[str, list[int]] = {SHORT: [], self.long: []}
        size = dict.fromkeys(held, 0)
        for i in places:
            sql = SHORT if len(pieces[i]) <= self.short else self.long
            if held[sql] and size[sql] + len(pieces[i]) > QUERY_BYTES:
                yield sql, held[sql]
                held[sql], size[sql] = [], 0
            held[sql].append(i)
            size[sql] += len(pieces[i])
        yield from ((sql, found) for sql, found in held.items() if found)


class Pieces(Merges):
    """Merges that remember the pieces they have met."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__(ranks)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts, self.lengths, self.pool = array("q"), array("q"), array("i")

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an array of pieces one after another, and how many each has."""
        if len(self.slots) > MEMO_PIECES:
            self.forget()
        coded = values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        fresh = [p for p in names if p not in self.slots]
        if fresh:
            ids, sizes = self.merge([p.encode("utf-8", "surrogatepass") for p in fresh])
            self.starts.frombytes((len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
            self.lengths.frombytes(sizes.astype(np.int64).tobytes())
            self.pool.frombytes(ids.astype(np.int32).tobytes())
            for p in fresh:
                self.slots[p] = len(self.slots)
        at = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        starts, sizes = (np.frombuffer(x, np.int64)[at] if len(x) else np.zeros(0, np.int64) for x in (self.starts, self.lengths))
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
        return np.frombuffer(self.pool, np.int32)[where] if total else np.zeros(0, np.int32), sizes


#: By path: what this worker process has read; it serves one task after another.
_held: dict[str, Pieces] = {}


def held(path: str) -> Pieces:
    if path not in _held:
        _held[path] = Pieces(read_ranks(path))
    return _held[path]


def pieces_of(text: Column, pattern: str) -> Column:
    """All matches of the pattern in a text, in order; null where the text has a character that this JVM doesn't know yet."""
    java = pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
    return F.when(~text.rlike(r"\p{Cn}"), F.regexp_extract_all(text, F.lit(java), F.lit(0)))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most or i + 1 == len(sizes):
            yield start, i + 1
            start, total = i + 1, 0


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, ids): the token ids of every row of ``docs``, each match of ``pattern`` encoded for itself.

    A null or empty text has no ids. Rows with one id, or none, keep a row each.
    A text is split whole, in memory a few times as large as itself. ``path`` must
    name the rank file on the driver and the executors alike.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.select(F.col(id_col).alias("doc_id"), *carry).schema
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, pieces_of(text, pattern).alias("_pieces"), text.alias("_text"))
    rows = rows.withColumn("_text", F.when(F.col("_pieces").isNull(), F.col("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = held(path), regex.compile(pattern)
        for batch in batches:
            lists = batch.column(len(kept))
            if lists.null_count:
                unknown = {i: pa.array(split.findall(batch.column(len(kept) + 1)[i].as_py()), pa.string()) for i in np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False)).tolist()}
                parts = [unknown[i] if i in unknown else lists.slice(i, 1).flatten().cast(pa.string()) for i in range(len(lists))]
                bounds, values = np.cumsum([0, *map(len, parts)]), pa.concat_arrays(parts)
            else:
                bounds, values = lists.offsets.to_numpy().astype(np.int64), lists.values
            for a, b in slices(np.diff(bounds), AT_ONCE):
                ids, sizes = own.encode(values.slice(bounds[a], bounds[b] - bounds[a]))
                ends = np.append(0, np.cumsum(sizes))[bounds[a : b + 1] - bounds[a]]
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                others = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*others, listed], [*kept.names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in ``to``. No ids give no bytes, null ids give null, ids without a token are skipped."""
    ship(encoded.sparkSession)
    names = [c for c in encoded.columns if c != to]
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(path)
        for batch in batches:
            lists = batch.column(place)
            bounds, values = lists.offsets.to_numpy().astype(np.int64), lists.values.cast(pa.int32())
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            for a, b in slices(np.diff(bounds), AT_ONCE):
                sizes = np.diff(bounds[a : b + 1])
                rows = pa.table({"d": np.repeat(np.arange(b - a, dtype=np.int32), sizes), "p": np.arange(sizes.sum(), dtype=np.int32), "id": values.slice(bounds[a], sizes.sum())})
                told = own.ask(DECODE, "ids", rows)
                order = np.full(b - a, len(told), np.int64)
                order[told.column("d").to_numpy()] = np.arange(len(told))
                found = pa.concat_arrays([*told.column("bytes").cast(pa.binary()).chunks, pa.array([b"", None], pa.binary())])
                order[~known[a:b]] = len(told) + 1
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, found.take(pa.array(order))], [*names, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema)
    return encoded.select(*names).mapInArrow(run, f"{schema}, `{to}` binary")
