"""The pipeline's near-duplicate stage gets candidates by SimHash."""

import corpus_pipeline

from handbill.llm import similar, simhash

ONE = "dibmoi lmdbgp aadojn bimghe pedkoi nmcegj mpcmka ohmphm dfijli jmnkmp hkpdph pnfine apnnaj"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_of(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}


def test_stage_drops_what_simhash_alone_finds(spark):
    texts = [ONE, ONE.replace("apnnaj", "lindcc"), "quite another text that has nothing to do with them"]
    a, b = (similar.shingles(t) for t in texts[:2])
    assert similar.similar(a, b) and (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() <= simhash.MAX_BITS
    assert not set(similar.cells(similar.minima(a))) & set(similar.cells(similar.minima(b)))  # no band shows them
    assert kept_of(spark, texts) == {0, 2}


def test_stage_checks_what_simhash_links(spark, monkeypatch):
    monkeypatch.setattr(similar, "fingerprint", lambda text: 7)
    texts = ["one text about boats and harbours in the north", "another one on gardens and trees of the south", ONE]
    assert kept_of(spark, texts) == {0, 1, 2}
