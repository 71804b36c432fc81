"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import random

import corpus_pipeline
import pytest

from handbill.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def with_replaced(rng, own, n):
    own = list(own)
    for at in rng.sample(range(len(own)), n):
        own[at] = words(rng, 1)[0]
    return own


def plain_sets(text):
    own = text.lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def jaccard(a, b):
    a, b = plain_sets(a), plain_sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_of(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}


def test_stage_drops_near_copies_of_similarity_0_8(spark):
    rng = random.Random(7)
    texts = []
    for n in (100, 300, 1000):
        for times in (n // 100, n // 50):
            for _ in range(60):
                base = words(rng, n)
                copy = with_replaced(rng, base, times)
                if jaccard(" ".join(base), " ".join(copy)) >= 0.8:
                    texts += [" ".join(base), " ".join(copy)]
    near = len(texts) // 2
    kept = kept_of(spark, texts)
    caught = near - sum({i, i + 1} <= kept for i in range(0, len(texts), 2))
    print(f"{caught} of {near} near copies")
    assert near > 250 and len(texts) - len(kept) == caught and caught / near > 0.99


def test_stage_keeps_what_is_less_similar(spark):
    rng = random.Random(8)
    base = words(rng, 300)
    texts = [" ".join(base), " ".join(with_replaced(rng, base, 30)), "One two", "one  TWO", "one two three", "", " \n"]
    assert jaccard(texts[0], texts[1]) < 0.7
    assert kept_of(spark, texts) == {0, 1, 2, 4, 5}


def test_one_hub_holds_a_large_group_together(spark):
    rng = random.Random(9)
    base = words(rng, 500)
    texts = [" ".join(base)] + [" ".join(with_replaced(rng, base, 9)) for _ in range(300)]
    assert all(jaccard(texts[0], t) >= 0.8 for t in texts[1:]) and jaccard(texts[1], texts[2]) < 0.8
    assert kept_of(spark, texts) == {0}


def test_similar_is_exact():
    a = "a b c d e f g h i j k l m"
    assert len(similar.shingles(a)) == 9
    assert similar.similar(similar.shingles(a), similar.shingles(a + " n"), 90) and not similar.similar(similar.shingles(a), similar.shingles(a + " n"), 91)


def test_stage_keeps_one_row_a_group_whatever_the_ids(spark):
    rng = random.Random(10)
    a, b, c, d, e = (" ".join(words(rng, 200)) for _ in range(5))
    near = b + " end"
    rows = [(5, a), (5, near), (2, b), (7, c), (7, d), (None, c), (None, e), (None, e), (None, near)]
    want = [(2, b), (5, a), (7, c), (7, d), (None, e)]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in some], SCHEMA)
        got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [8, 100_000])
def test_no_link_of_a_large_cell_is_lost(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    # One cell for all texts: many pairs of near copies, chains of them and texts that are alone.
    monkeypatch.setattr(similar, "cells", lambda found: [1] * similar.BANDS)
    rng = random.Random(11)
    texts = [" ".join(words(rng, 60)) for _ in range(15)]
    for _ in range(15):
        base = words(rng, 200)
        texts += [" ".join(base), " ".join(base + words(rng, 8))]
    for _ in range(3):
        chain = words(rng, 300)
        for _ in range(6):
            texts.append(" ".join(chain))
            chain = chain[30:] + words(rng, 30)
    rng.shuffle(texts)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    keys = {t: r[0] for t, r in zip(texts, docs.select(similar.key_of()).collect())}
    root = {k: k for k in keys.values()}
    for _ in texts:
        for a in texts:
            for b in texts:
                if root[keys[a]] != root[keys[b]] and jaccard(a, b) >= 0.8:
                    least = min(root[keys[a]], root[keys[b]])
                    root[keys[a]] = root[keys[b]] = least
        if all(root[keys[a]] == root[keys[b]] or jaccard(a, b) < 0.8 for a in texts for b in texts):
            break
    sizes = {k: list(root.values()).count(r) for k, r in root.items()}
    want = {(k, r) for k, r in root.items() if sizes[k] > 1}
    assert len(want) == 48
    assert {(r.key, r.root) for r in similar.groups(docs).collect()} == want


def test_minima_that_agree_tell_similar_texts():
    assert similar.must_agree(80) == 74 and similar.must_agree(100) == similar.BANDS * similar.ROWS
    rng = random.Random(12)
    base = words(rng, 400)
    signs = [similar.minima(similar.shingles(" ".join(x))) for x in (base, with_replaced(rng, base, 7), with_replaced(rng, base, 60))]
    near, far = ((signs[0] == s).sum() for s in signs[1:])
    assert near >= similar.must_agree(80) > far
