"""Media containers: stored forms against the definition, fragments, broken files."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from handbill.llm import media, queries

PAYLOAD = bytes(range(256)) * 33


def test_registered_query_against_a_plain_computation(spark, tmp_path):
    texts = ["", None, "é" * 40, "x" * 64, "y" * 20_000, "line\nline", "y" * 20_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.write_media(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        frames = len(payload) // 64
        body = stored.index(payload)  # keyframes: every 32nd frame, one frame of 64 bytes each, in one piece after the header
        ranges = ",".join(f"{body + 64 * k}+64" for k in range(0, frames, 32))
        assert r.feature == ";".join(["raw ", f"{frames}/25", str(frames), str(-(-frames // 32)), hashlib.md5(ranges.encode()).hexdigest()])
    assert got[4][1:] == got[6][1:]


def fragmented(sizes, keys):
    """A file whose samples stand in one movie fragment; ``sizes`` and ``keys`` by sample."""
    whole = media.write_media(media.padded(b""))
    moov = whole[whole.index(b"moov") - 4 : whole.index(b"mdat") - 4]
    moov = moov.replace(media.full_box(b"stsz", 0, struct.pack(">II", 64, 1)), media.full_box(b"stsz", 0, struct.pack(">II", 0, 0)))
    moov = moov.replace(media.full_box(b"stss", 0, struct.pack(">II", 1, 1)), media.full_box(b"stss", 0, struct.pack(">II", 0, 0)))
    rows = b"".join(struct.pack(">III", 2, n, 0 if k else 0x10000) for n, k in zip(sizes, keys))
    def moof(at):
        trun = media.full_box(b"trun", 0x701, struct.pack(">Ii", len(sizes), at), rows)
        return media.box(b"moof", media.full_box(b"mfhd", 0, struct.pack(">I", 1)), media.box(b"traf", media.full_box(b"tfhd", 0x20000, struct.pack(">I", 1)), trun))
    return moov + moof(len(moof(0)) + 8) + media.box(b"mdat", bytes(i % 251 for i in range(sum(sizes))))


def test_samples_of_movie_fragments():
    sizes, keys = [5, 70, 1, 33], [True, False, True, False]
    found = media.describe(fragmented(sizes, keys))
    body = bytes(i % 251 for i in range(sum(sizes)))
    assert found["n_samples"] == 4 and found["payload_sha256"] == hashlib.sha256(body).hexdigest()
    data = fragmented(sizes, keys)
    assert [(k["sample"], k["time"], k["size"]) for k in found["keyframes"]] == [(1, 0, 5), (3, 4, 1)]
    assert [data[k["offset"] : k["offset"] + k["size"]] for k in found["keyframes"]] == [body[:5], body[75:76]]


@pytest.mark.parametrize("data", [media.write_media(PAYLOAD), fragmented([5, 70, 1, 33] * 20, [True, False] * 40)])
def test_no_broken_file_raises(data):
    rng = random.Random(5)
    head = len(data) - len(PAYLOAD) if len(data) > len(PAYLOAD) else len(data)
    for _ in range(4000):
        broken = bytearray(data)
        for _ in range(rng.choice((1, 1, 2, 5))):
            broken[rng.randrange(head)] = rng.choice((0, 1, 127, 128, 255, rng.randrange(256)))
        found = media.describe(bytes(broken))
        assert found["media_bytes"] == len(data) and len(found["keyframes"]) <= len(data)
    for n in range(0, len(data), 7):
        media.describe(data[:n])


def test_counts_are_bounded_by_the_file():
    data = media.write_media(media.padded(b"x"))
    at = data.index(b"stsz") + 12
    claimed = data[:at] + struct.pack(">I", 0xFFFFFFFF) + data[at + 4 :]
    assert media.describe(claimed)["n_samples"] is None
    assert len(media.repeated(np.arange(3), np.array([1 << 40, 1, 1]), 10)) == 10


def test_index_replaces_columns_of_its_names(spark):
    rows = spark.createDataFrame([(1, "a", "old"), (1, "a", "old"), (None, None, None)], "doc_id long, text string, more string")
    stored = media.store(rows).withColumn("codec", F.lit("old"))
    assert [r.codec for r in media.index(stored).collect()] == ["raw "] * 3
    assert media.index(stored.where("false")).count() == 0


def test_any_number_of_nested_boxes():
    """A file of boxes in boxes has no track, however deep it goes."""
    depth = 100_000
    data = b"".join(struct.pack(">I4s", 8 * (depth - i), b"moov") for i in range(depth))
    found = media.describe(data)
    assert found["codec"] is None and found["keyframes"] == [] and found["media_bytes"] == 8 * depth
    assert len(list(media.walk(data))) == media.DEEPEST + 1
