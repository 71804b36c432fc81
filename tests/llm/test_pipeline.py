"""The whole pipeline against the five stages done plainly, one after another."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from handbill.llm import queries, sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    """Prose of two languages with exact and near copies, lines that many documents share, short and repetitive texts, odd rows."""
    rng = np.random.default_rng(11)
    words = {k: [f"{k}{int(n):x}" for n in rng.integers(0, 1 << 30, 400)] + v * 25 for k, v in (("en", ["the", "of", "and", "to"]), ("de", ["der", "die", "und", "in"]))}
    prose = lambda lang, n: " ".join(words[lang][int(k)] for k in rng.integers(0, len(words[lang]), n))
    shared = [f"this passage number {i} stands in very many documents" for i in range(3)]
    rows = []
    for i in range(150):
        lang = "en" if i % 3 else "de"
        text = "\n".join([prose(lang, 40), prose(lang, int(rng.integers(30, 120))), *([shared[i % 3]] if i % 4 == 0 else [])])
        rows.append((1000 + 7 * i % 1000, text, lang, ["web", "web", "news", None][i % 4]))
    own = list(rows)
    for i, (d, text, lang, source) in enumerate(own[:30]):
        rows.append((5000 + i, text, lang, source))
        changed = text.split(" ")
        changed[len(changed) // 2] = "changed"
        rows.append((6000 - i, " ".join(changed), lang, source))
    rows += [(1, "too short", "en", "web"), (2, prose("en", 3) * 60, "en", "web"), (3, None, "en", "web"), (None, own[40][1] + " and more of it", "en", "news"), (own[50][0], own[51][1] + " with an end", "en", "web"), own[60], own[60]]
    return [(*r, len(r[1] or "")) for r in rows]


def by_sql(con, text, rows):
    con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return con.execute(text).fetchdf().to_dict("records")


def drop_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda d: (d is not None, d or 0)
    held = {}
    for d, text, *_ in rows:
        for x in text.split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    gone = {k: max(v, key=rank) for k, v in held.items() if len(v) >= 3}
    return [(d, "\n".join(x for x in t.split("\n") if key(x) not in gone or gone[key(x)] == d), *more) for d, t, *more in rows]


def one_a_group(rows):
    texts = sorted({r[1] for r in rows})

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    first = {}
    for r in rows:
        k = group[r[1]]
        if k not in first or (r[0] is None, r[0] or 0) < (first[k][0] is None, first[k][0] or 0):
            first[k] = r
    return list(first.values())


def test_run_agrees_with_the_stages_done_plainly(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    with duckdb.connect() as con:
        verdicts = Counter((r["doc_id"], r["n_words"], r["word_chars"]) for r in by_sql(con, sql.OP10, rows) if r["kept"])
        size = lambda t: (len((t or "").split()), sum(map(len, (t or "").split())))
        stay = [r for r in rows if any((d == r[0] or (d != d and r[0] is None)) and (n, c) == size(r[1]) for d, n, c in verdicts)]
        assert len(stay) < len(rows) and 3 not in {r[0] for r in stay} and 1 not in {r[0] for r in stay}
        cleaned = [(d, t, lang, source, len(t)) for d, t, lang, source, _ in drop_lines(stay)]
        assert sum(map(len, (r[1] for r in cleaned))) < sum(map(len, (r[1] for r in stay)))
        alone = one_a_group(cleaned)
        assert len(alone) <= len(cleaned) - 30
        mixed = by_sql(con, sql.OP2.replace("SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM o", "SELECT doc_id, text, copies FROM o").replace("md5(coalesce(CAST(doc_id", "text, md5(coalesce(CAST(doc_id").replace("SELECT doc_id, size, source_size, target, CASE", "SELECT doc_id, text, size, source_size, target, CASE"), alone)
    want = Counter()
    for r in mixed:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[None if r["doc_id"] != r["doc_id"] else int(r["doc_id"]), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += r["copies"]
    assert got == Counter({k: n for k, n in want.items() if n})


def test_run_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
