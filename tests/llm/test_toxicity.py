"""The registered toxicity query against a plain per-coordinate loop over plainly made features."""

import hashlib
import math
import re
import zlib

import pytest
import xxhash
from oracle import DATA

from handbill.llm import queries, toxicity

M = (1 << 64) - 1


def features_plainly(text):
    """Buckets of words, stems, pairs and pairs with a word between, one at a time."""
    words = re.findall(r"\w+", (text or "").lower())
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    found = list(hashes)
    for n in toxicity.STEMS:
        found += [xxhash.xxh64_intdigest(w[:n], n) for w in words if len(w) >= n]
    _, a, b, c, d = toxicity.MIX
    found += [(x * a + y * b) & M for x, y in zip(hashes, hashes[1:])]
    found += [(x * c + y * d) & M for x, y in zip(hashes, hashes[2:])]
    return sorted({((h * toxicity.MIX[0]) & M) >> (64 - toxicity.BUCKET_BITS) for h in found})


def trained_plainly(rows):
    z, n = {}, {}

    def weight(k):
        limit = 0.0 if k == "bias" else toxicity.L1
        own = z.get(k, 0.0)
        if abs(own) <= limit:
            return 0.0
        return -(own - math.copysign(limit, own)) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for label, buckets in rows:
            w = {k: weight(k) for k in [*buckets, "bias"]}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - label
            for k, own in w.items():
                rate = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA
                z[k] = z.get(k, 0.0) + g - rate * own
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


@pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")
def test_op7_against_a_plain_loop(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.toxic is not None}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in docs}
    texts = {i: t for i, t in docs}
    assert len(texts) == len(docs)
    known = sorted((i for i in marks if i in texts and not held[i]), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    weights = trained_plainly([(marks[i], features_plainly(texts[i])) for i in known])
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, str(DATA)).collect()}
    assert len(got) == len(docs) and any(w for k, w in weights.items() if k != "bias")
    for i, t in docs:
        total = weights["bias"] + sum(weights.get(k, 0.0) for k in features_plainly(t))
        score = 1 / (1 + math.exp(-max(-30, min(30, total))))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].held_out == held[i] and got[i].predicted == int(got[i].score >= 0.3)
