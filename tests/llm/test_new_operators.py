"""Byte-level BPE against its library, spelling variants and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
from oracle import DATA

from handbill.llm import byte_bpe, periodic, queries, variants

PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, word string, runs int"
TEXTS = [None, "", " ", "it's  the   end\n\n of\tit, we'll 12 see!! 漢字仮名 \U0001fae8 x\x85y z \x1c", "x" * 300, "ab" * 200, "a b " * 40, "one one one two", " ".join(f"w{i % 7}" for i in range(100))]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", i) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})


def merged_plainly(ranks, piece):
    if piece in ranks:
        return [ranks[piece]]
    tokens = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[tokens[i] + tokens[i + 1]], i) for i in range(len(tokens) - 1) if tokens[i] + tokens[i + 1] in ranks]
        if not pairs:
            return [ranks[t] for t in tokens]
        i = min(pairs)[1]
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("short", [0, 64])
def test_merges_for_ranks_in_any_order(seed, short):
    """Ranks that no training gives: a longer token may come before its parts."""
    r = random.Random(seed)
    tokens = [b"a", b"b", b"c"]
    for _ in range(r.randint(1, 40)):
        tokens.append((r.choice(tokens) + r.choice(tokens))[:9])
    rest = list(dict.fromkeys(tokens))[3:]
    r.shuffle(rest)
    ranks = {t: i for i, t in enumerate([b"a", b"b", b"c", *rest])}
    pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 60))) for _ in range(20)] + [r.choice([b"ab", b"a", b"aab"]) * r.randint(1, 20) for _ in range(10)]
    ids, sizes = byte_bpe.Merges(ranks, short).merge(pieces)
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [merged_plainly(ranks, p) for p in pieces]


def test_long_pieces_take_few_steps(library):
    own = byte_bpe.Merges(byte_bpe.read_ranks(queries.RANKS))
    r = random.Random(3)
    for piece in (b"a" * 50_000, b" " * 30_000, b"ab" * 5_000, bytes(r.choice(b"etaoin") for _ in range(3_000))):
        assert own.merge([piece])[0].tolist() == library._encode_single_piece(piece)


def test_byte_bpe_against_the_library(spark, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(f"a{c} {c}{c}1 " for c in every[i : i + 5000]) for i in range(0, len(every), 5000)]
    texts = [*TEXTS, *blocks]
    docs = rows(spark, texts)
    got = byte_bpe.decode(byte_bpe.encode(docs, queries.RANKS, PATTERN, carry=("word",)), queries.RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.word == "clash"
    assert byte_bpe.encode(docs.limit(0), queries.RANKS, PATTERN).count() == 0
    same = spark.createDataFrame([(None, "same text"), (None, "same text"), (1, "same text")], "doc_id long, text string")
    assert [r.ids for r in byte_bpe.encode(same, queries.RANKS, PATTERN).collect()] == [library.encode_ordinary("same text")] * 3
    odd = byte_bpe.decode(spark.createDataFrame([(1, [65, 10**6, 66]), (2, None), (3, [])], "doc_id long, ids array<int>"), queries.RANKS)
    back = {i: t for t, i in byte_bpe.read_ranks(queries.RANKS).items()}
    assert [None if r.decoded is None else bytes(r.decoded) for r in odd.orderBy("doc_id").collect()] == [back[65] + back[66], None, b""]


def test_op11_against_the_library(spark, library):
    data = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    texts = Counter((r.doc_id, r.text or "") for r in data)
    want = Counter()
    for (i, t), n in texts.items():
        ids = library.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()] += n
    assert Counter(map(tuple, queries.op11_byte_bpe(spark, str(DATA)).collect())) == want


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped_plainly(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def test_variants_against_all_pairs(spark):
    r = random.Random(7)
    words = {"".join(r.choice("abà") for _ in range(r.randint(7, 9))): r.choice([2, 3, 20, 30, 200, 2000, 30000]) for _ in range(500)}
    words |= {"aaaaaaaa": 5, "aaaaaaa": 50, "aaaaaaaaa": 5000, "zzzzzzzz": 2, "éééééééé": 2, "éééééééþ": 2, "éééééééÿ": 20}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants.group_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == Counter(grouped_plainly(words))
    assert variants.group_variants(df.limit(0)).count() == 0


def test_op12_counts_against_a_plain_loop(spark, tmp_path):
    texts = [None, "", "Straßburg straßburg STRASSBURG Ärgerlich ärgerlich", *[f"Something{'x' * (i % 3)} everything, nothing-Everything {'q' * 50}" for i in range(200)], "Everything" * 1000]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "clash", "clash", i) for i, t in enumerate(texts)] * 2, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in [(i if i % 5 else None, t) for i, t in enumerate(texts)] * 2:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert len(counts) > 10
    assert Counter(map(tuple, queries.op12_variants(spark, str(tmp_path)).collect())) == Counter(grouped_plainly(counts))


def runs_plainly(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(min_length, exponent * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_against_every_period():
    r = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(r.randint(1, 6)):
            words = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(0, 60))]
            for _ in range(r.randint(0, 3)):
                p, m, at = [r.randrange(4) for _ in range(r.randint(1, 7))], r.randint(2, 40), r.randint(0, len(words))
                words[at:at] = (p * m)[:m]
            docs.append(words)
        bounds = np.append(0, np.cumsum([len(x) for x in docs]))
        want = [(s + b, s + n + b, q) for b, d in zip(bounds, docs) for s, n, q in runs_plainly(d)]
        for min_length, exponent in ((6, 4), (9, 5)):
            got = periodic.find_runs(np.array(sum(docs, []), np.int64), bounds, min_length, exponent).tolist()
            assert got == sorted([s, e, q] for s, e, q in want if e - s >= max(min_length, exponent * q))
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), np.array([0, 9]), exponent=2)


def test_op13_against_a_plain_loop(spark, tmp_path):
    r = random.Random(4)
    texts = [*TEXTS, *[" ".join(r.choice("ab\xa0") * r.randint(1, 2) for _ in range(r.randint(0, 300))) for _ in range(120)], "same " * 20_000]
    data = [(i if i % 9 else None, t, "clash", "clash", i) for i, t in enumerate(texts)]
    spark.createDataFrame(data + data[:5], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t, *_ in data + data[:5]:
        w = regex.findall("[^\x20\x09-\x0d]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = runs_plainly(w) if len(set(w)) > 1 else [(0, n, 1)] if n >= 6 else []
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[i, len(runs), *head, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    got = queries.op13_periodic(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == want
    again = periodic.periodic_runs(rows(spark, TEXTS), carry=("word",))
    assert {x.doc_id: x.n_words for x in again.collect()} == {i: len(regex.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(TEXTS)}
    assert periodic.periodic_runs(rows(spark, TEXTS).limit(0)).count() == 0
