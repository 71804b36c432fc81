"""Media columns: ISO media containers written, walked and read by byte range.

A payload becomes the frames of an uncompressed 8 x 8 grey video, one byte a
sample, in a container of nested boxes. The reader walks the boxes, decodes the
sample tables and returns codec, duration and the byte ranges of frames and
keyframes; it never decodes, or even looks at, a frame. The walker takes other
files too: 64-bit box sizes, boxes to the end of the file, 64-bit chunk offsets,
constant or listed sample sizes, and movie fragments. Whatever a file claims, what is
made from it is bounded by its length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import ship

FRAME = 64
SIDE = 8
TIMESCALE = 25
FRAMES_PER_CHUNK = 128
KEYFRAME_EVERY = 32
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Media bytes in one batch that a task returns, unless one file is larger.
BATCH_BYTES = 8 << 20


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """The payload and bytes 0 up to a positive multiple of 64."""
    return payload.ljust(max(1, -(-len(payload) // FRAME)) * FRAME, b"\0")


def write_media(payload: bytes) -> bytes:
    """The container of a payload that padded() made. Equal payloads give equal bytes: no times are stored."""
    frames = len(payload) // FRAME
    keys = np.arange(1, frames + 1, KEYFRAME_EVERY, dtype=">u4")
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    entry = struct.pack(">6xH16xHHII4xH", 1, SIDE, SIDE, 0x480000, 0x480000, 1) + bytes(32) + struct.pack(">Hh", 40, -1)
    wide = len(payload) >= 1 << 31

    def head(base: int) -> bytes:
        offsets = base + FRAME * FRAMES_PER_CHUNK * np.arange(chunks, dtype=np.int64)
        table = full_box(b"co64", 0, struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full_box(b"stco", 0, struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full_box(b"stsd", 0, struct.pack(">I", 1), box(b"raw ", entry)),
            full_box(b"stts", 0, struct.pack(">III", 1, frames, 1)),
            full_box(b"stss", 0, struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", 0, struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            table,
        )
        dinf = box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1)))
        minf = box(b"minf", full_box(b"vmhd", 1, bytes(8)), dinf, stbl)
        mdia = box(
            b"mdia",
            full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames & 0xFFFFFFFF, 0x55C4, 0)),
            full_box(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide"), b"\0"),
            minf,
        )
        tkhd = full_box(b"tkhd", 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, frames & 0xFFFFFFFF, 0, 0, 0, 0), UNITY, struct.pack(">II", SIDE << 16, SIDE << 16))
        mvhd = full_box(b"mvhd", 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, frames & 0xFFFFFFFF, 0x10000, 0x100), UNITY, bytes(24), struct.pack(">I", 2))
        data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
        return box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ") + box(b"moov", mvhd, box(b"trak", tkhd, mdia)) + data

    return head(len(head(0))) + payload


#: Boxes around the innermost one that walk() opens: sample entries, the deepest that are read, have six.
DEEPEST = 16


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of the body of each box, parents before children. A box that overruns its parent ends the walk there.

    No table that counts lies below DEEPEST boxes; what nests deeper is passed over as a whole.
    """
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            return
        yield (*path, kind), body, stop
        if kind in CONTAINERS and len(path) < DEEPEST:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


class Broken(ValueError):
    """A file whose boxes or tables contradict each other."""


def number(data: bytes, at: int, form: str = ">I") -> int:
    if at < 0 or at + struct.calcsize(form) > len(data):
        raise Broken("a box is cut short")
    return struct.unpack_from(form, data, at)[0]


def tracks(data: bytes) -> list[dict]:
    """Per track: codec, timescale, duration, and numpy arrays offset, size, time and key by sample.

    Samples of a track are those of its own tables, then those of its movie
    fragments. Raises Broken where tables contradict each other.
    """
    found: list[dict] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[dict] = []
    for path, a, b in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif found and path[:2] == (b"moov", b"trak"):
            found[-1][path[-1]] = (a, b)
        elif path == (b"moov", b"mvex", b"trex"):
            defaults[number(data, a + 4)] = (number(data, a + 12), number(data, a + 16), number(data, a + 20))
        elif path == (b"moof",):
            base = a - 8 if number(data, a - 8) != 1 or data[a - 4 : a] == b"moof" else a - 16
            fragments.append({"base": base, "runs": []})
        elif fragments and path == (b"moof", b"traf", b"tfhd"):
            fragments[-1]["runs"].append((a, []))
        elif fragments and fragments[-1]["runs"] and path == (b"moof", b"traf", b"trun"):
            fragments[-1]["runs"][-1][1].append((a, b))
    out = [track(data, t) for t in found if b"stsz" in t and (b"stco" in t or b"co64" in t) and b"stsc" in t]
    for t, boxes in zip(out, [t for t in found if b"stsz" in t and (b"stco" in t or b"co64" in t) and b"stsc" in t]):
        own = number(data, boxes[b"tkhd"][0] + (20 if data[boxes[b"tkhd"][0]] == 1 else 12)) if b"tkhd" in boxes else 0
        more = [s for f in fragments for head, runs in f["runs"] if number(data, head + 4) == own for s in [fragment(data, f["base"], head, runs, defaults.get(own, (0, 0, 0)))]]
        if more:
            start = int(t["time"][-1] + t["last"]) if len(t["time"]) else 0
            for s in more:
                times = start + np.cumsum(s["span"]) - s["span"]
                start += int(s["span"].sum())
                for k, v in (("offset", s["offset"]), ("size", s["size"]), ("time", times), ("key", s["key"])):
                    t[k] = np.concatenate([t[k], v])
            t["duration"] = max(t["duration"], start)
    for t in out:
        if len(t["size"]) and (t["size"].min() < 0 or t["offset"].min() < 0 or int((t["offset"] + t["size"]).max()) > len(data)):
            raise Broken("a sample lies outside the file")
    return out


def fragment(data: bytes, base: int, head: int, runs: list[tuple[int, int]], defaults: tuple[int, int, int]) -> dict:
    """Offset, size, span and key of the samples of one track's part of a movie fragment."""
    flags, at = number(data, head) & 0xFFFFFF, head + 8
    given = list(defaults)  # duration, size, flags
    if flags & 0x1:
        base, at = number(data, at, ">Q"), at + 8
    at += 4 * bool(flags & 0x2)
    for i, bit in enumerate((0x8, 0x10, 0x20)):
        if flags & bit:
            given[i], at = number(data, at), at + 4
    parts, place = [], base
    for a, b in runs:
        flags, count, at = number(data, a) & 0xFFFFFF, number(data, a + 4), a + 8
        if flags & 0x1:
            place, at = base + number(data, at, ">i"), at + 4
        first = None
        if flags & 0x4:
            first, at = number(data, at), at + 4
        listed = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        # A run that lists nothing still has a sample for each so many bytes of the file, or is broken.
        if count > (b - at) // (4 * len(listed)) if listed else count * max(given[1], 1) > len(data):
            raise Broken("a run has more samples than it lists")
        rows = np.frombuffer(data, ">u4", count * len(listed), at).astype(np.int64).reshape(count, len(listed)) if listed else np.zeros((count, 0), np.int64)
        column = lambda bit, other: rows[:, listed.index(bit)] if bit in listed else np.full(count, other, np.int64)
        span, size, marks = column(0x100, given[0]), column(0x200, given[1]), column(0x400, given[2])
        if first is not None and count and 0x400 not in listed:
            marks = marks.copy()
            marks[0] = first
        parts.append((place + np.cumsum(size) - size, size, span, (marks & 0x10000) == 0))
        place += int(size.sum())
    joined = [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [[]] * 4)]
    return dict(zip(("offset", "size", "span", "key"), joined))


def repeated(values: np.ndarray, times: np.ndarray, most: int) -> np.ndarray:
    """``values`` as often as ``times`` says, ``most`` in all at most; negative times are broken."""
    if len(times) and times.min() < 0:
        raise Broken("a negative count")
    ends = np.minimum(np.cumsum(np.minimum(times, most)), most)
    return np.repeat(values, np.diff(ends, prepend=0))


def track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    """A track from its sample tables; counts are held against the file's length before anything is made from them."""

    def table(kind: bytes, width: int, size: str = ">u4", skip: int = 0) -> np.ndarray:
        if kind not in boxes:
            return np.zeros((0, width), np.int64)
        at = boxes[kind][0] + 4 + skip
        n = min(number(data, at), max(0, boxes[kind][1] - at - 4) // (np.dtype(size).itemsize * width))
        return np.frombuffer(data, size, n * width, at + 4).astype(np.int64).reshape(n, width)

    fixed, count = number(data, boxes[b"stsz"][0] + 4), number(data, boxes[b"stsz"][0] + 8)
    if fixed and count * fixed > len(data):
        raise Broken("more samples than bytes")
    sizes = np.full(count, fixed, np.int64) if fixed else table(b"stsz", 1, skip=4)[:, 0]
    chunk_at = table(b"stco", 1)[:, 0] if b"stco" in boxes else table(b"co64", 1, ">u8")[:, 0]
    runs = table(b"stsc", 3)
    if len(runs) and (runs[0, 0] != 1 or np.diff(np.append(runs[:, 0], max(len(chunk_at) + 1, runs[-1, 0]))).min() < 0):
        raise Broken("chunks out of order")
    per_chunk = repeated(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1)), len(chunk_at))
    chunk_of = repeated(np.arange(len(per_chunk)), per_chunk, len(sizes))
    sizes = sizes[: len(chunk_of)]
    ahead = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk_of, np.arange(len(per_chunk)))
    within = ahead - ahead[np.minimum(first, max(len(ahead) - 1, 0))][chunk_of] if len(ahead) else ahead
    deltas = table(b"stts", 2)
    spans = repeated(deltas[:, 1], deltas[:, 0], len(sizes))
    spans = np.append(spans, np.zeros(len(sizes) - len(spans), np.int64))
    key = np.ones(len(sizes), bool)
    if b"stss" in boxes:
        key[:] = False
        at = table(b"stss", 1)[:, 0]
        if len(at) and (at.min() < 1 or at.max() > len(sizes)):
            raise Broken("a keyframe outside the samples")
        key[at - 1] = True
    head = boxes.get(b"mdhd")
    wide = head is not None and data[head[0]] == 1
    place = head[0] + (20 if wide else 12) if head else 0
    timescale, duration = (number(data, place), number(data, place + 4, ">Q" if wide else ">I")) if head else (1, 0)
    codec = data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16].decode("latin-1") if b"stsd" in boxes else ""
    return {"codec": codec, "timescale": timescale, "duration": duration, "offset": chunk_at[chunk_of] + within, "size": sizes, "time": np.cumsum(spans) - spans, "key": key, "last": int(spans[-1]) if len(spans) else 0}


def payload_of(data: bytes, samples: dict) -> bytes:
    """The stored bytes of all samples of a track, by their ranges; ranges that meet are read as one."""
    begins, ends = samples["offset"], samples["offset"] + samples["size"]
    new = np.append(True, begins[1:] != ends[:-1]) if len(begins) else np.zeros(0, bool)
    stops = np.append(new[1:], True) if len(begins) else new
    return b"".join(data[a:b] for a, b in zip(begins[new].tolist(), ends[stops].tolist()))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the container of every text in UTF-8. A null text is empty, and an empty one is 64 bytes 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, sizes, total = 0, [], [], 0
            for i in range(batch.num_rows + 1):
                if held and (i == batch.num_rows or total >= BATCH_BYTES):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(held)), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "n_bytes", "media"]
                    )
                    start, held, sizes, total = i, [], [], 0
                if i < batch.num_rows:
                    payload = batch.column(1)[i].as_py()
                    held.append(write_media(padded(payload)))
                    sizes.append(len(payload))
                    total += len(held[-1])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


INDEX = (
    "codec string, timescale long, duration long, n_samples long, keyframes array<struct<sample:long,time:long,offset:long,size:long>>, "
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
)


def describe(data: bytes) -> dict:
    """What index() returns for one file; a file without a readable track, or with tables that contradict each other, has nulls and no keyframes."""
    out = dict.fromkeys([c.split(" ")[0] for c in INDEX.split(", ")])
    out |= {"keyframes": [], "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    try:
        found = tracks(data)[:1]
    except Broken:
        found = []
    for t in found:
        stored = payload_of(data, t)
        at = np.flatnonzero(t["key"])
        keys = zip((at + 1).tolist(), t["time"][at].tolist(), t["offset"][at].tolist(), t["size"][at].tolist())
        out |= {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["size"])}
        out |= {"keyframes": [dict(zip(("sample", "time", "offset", "size"), k)) for k in keys], "payload_bytes": len(stored)}
        out |= {"payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-FRAME:])}
    return out


def index(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with its media column replaced by what its containers say: codec, duration, keyframe byte ranges, digests.

    A null or broken file keeps its row with nulls and no keyframes. Rows may be
    alike and share ids; one of the columns that the index makes replaces another of its name. A very long file is read whole.
    """
    ship(media.sparkSession)
    made_here = {c.split(" ")[0] for c in INDEX.split(", ")}
    rest = [c for c in media.columns if c != media_col and c not in made_here]
    rows = media.select(*rest, media_col)
    kept = rows.select(*rest).schema
    fields = rows.sparkSession.createDataFrame([], INDEX).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = [describe(x.as_py() or b"") for x in part.column(len(rest))]
                made = [pa.array([f[k.name] for f in found], k.type) for k in kinds]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *made], [*rest, *kinds.names])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(run, head + INDEX)
