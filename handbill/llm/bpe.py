"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

The words (pre-tokens) of all documents are counted; the most frequent ones are
merged once and compiled into an automaton that shares suffixes. Its arcs carry
numbers that add up to a word's place in a table of ids. The arrays are sent to the
executors as one file and memory-mapped there. A word that the lexicon lacks is
merged exactly, in the task that meets it. The vocabulary file is a parameter.
"""

from __future__ import annotations

import heapq
import json
import re
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import cut, ship, words_of

#: Frequent words that the lexicon holds, at most.
LEXICON_WORDS = 32768
#: Characters of the longest run that the lexicon takes words from.
LISTED_CHARS = 64
#: Words that a task remembers, and characters that it works on at once.
MEMO_WORDS = 150_000
CHUNK_CHARS = 500_000
#: Bytes up to which a word is merged without a heap; no pair has this rank.
SHORT_WORD = 48
NO_RANK = 1 << 40


#: Code points below this are told apart by ranges; the texts of most languages need no more.
WRITTEN_OUT = 0x3000
BEYOND = re.compile(f"[^\\x00-{chr(WRITTEN_OUT - 1)}]")
#: White space among them.
WIDE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f"


def ranges_of(kind: str) -> str:
    """The code points below WRITTEN_OUT of a general category, as the inside of a character class."""
    found = [c for c in range(WRITTEN_OUT) if unicodedata.category(chr(c)).startswith(kind)]
    starts = [c for p, c in zip([-2, *found], found) if c != p + 1]
    stops = [c for c, n in zip(found, [*found[1:], -2]) if n != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, stops))


class Slots(dict):
    """Numbers words in the order in which they are first asked for; ``fresh`` lists those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, others = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + others)
            others += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and word pattern of a tokenizer file with word-end suffixes and byte letters."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: only BPE files that normalize by NFC, white space and lower case are read")
        self.ids: dict[str, int] = model["vocab"]
        # By the ids of a pair: its rank; by rank: the id of what it makes.
        pairs = [(self.ids.get(a), self.ids.get(b), self.ids.get(a + b)) for a, b in model["merges"]]
        self.ranks = {a << 32 | b: i for i, (a, b, _) in enumerate(pairs)}
        self.made = [c for *_, c in pairs]
        self.suffix = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        letters = byte_letters()
        self.first = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.suffix] for c in letters]
        # The same pattern for texts of ASCII alone, in the faster library; white space without \x1c to \x1f.
        plain = split["pattern"]["Regex"].replace("[\\p{L}]", "[a-z]").replace("[\\p{N}]", "[0-9]").replace("\\s\\p{L}\\p{N}", "\\t-\\r a-z0-9")
        self.plain = re.compile(plain)
        # And for texts below WRITTEN_OUT, with the classes of its code points as ranges.
        letters, numbers = ranges_of("L"), ranges_of("N")
        wide = split["pattern"]["Regex"].replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]").replace("\\s\\p{L}\\p{N}", WIDE_SPACE + letters + numbers)
        self.wide = re.compile(wide)
        # Pairs, sorted, with what each makes and its rank, for many words at a time.
        order = sorted(self.ranks)
        self.pairs = np.array(order, np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in order], np.int64)
        self.made_array = np.array(self.made, np.int64)
        self.first_array, self.last_array = np.array(self.first, np.int64), np.array(self.last, np.int64)
        self.tokens = {i: t for t, i in (self.ids | self.specials).items()}

    def words(self, text: str | None) -> list[str]:
        """The pre-tokens of a text; special tokens in it stay whole."""
        if not text:
            return []
        if self.special is not None and any(s in text for s in self.specials):
            out: list[str] = []
            for part in self.special.split(text):
                out += [part] if part in self.specials else self.words_of_part(part)
            return out
        return self.words_of_part(text)

    def words_of_part(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text.lower())
        # Each letter is lowered by itself, a final sigma too.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if BEYOND.search(text) is None:
            return self.wide.findall(text)
        # Code points that are newer than the library's tables are no letters to it.
        new = {ord(c): "\uffff" for c in set(text) if c > "\u024f" and unicodedata.category(c) == "Cn"}
        if new:
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(new))]
        return self.pattern.findall(text)

    def merge(self, word: str) -> list[int]:
        """The ids of one word, by merging the pair of least rank, leftmost first, until none is left."""
        if word in self.specials:
            return [self.specials[word]]
        coded = word.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in coded]
        ids[-1] = self.last[coded[-1]]
        if len(ids) > SHORT_WORD:
            return self.merge_long(ids)
        get, made = self.ranks.get, self.made
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NO_RANK:
            at = ranks.index(best)
            ids[at : at + 2] = [made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | ids[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 32 | ids[at + 1], NO_RANK)
        return ids

    def merge_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids a word): as merge() gives them, for many words at a time.

        Each round merges in every word the leftmost pair of its least rank; words
        that are done leave the arrays.
        """
        alone = {i: self.merge(w) for i, w in enumerate(words) if len(w) > SHORT_WORD or w in self.specials}
        coded = [b"" if i in alone else w.encode("utf-8", "surrogatepass") for i, w in enumerate(words)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        text = np.frombuffer(b"".join(coded), np.uint8)
        ids, own = self.first_array[text], np.repeat(np.arange(len(coded)), sizes)
        ends = np.cumsum(sizes)[sizes > 0] - 1
        ids[ends] = self.last_array[text[ends]]
        done = [(np.array([i], np.int64).repeat(len(x)), np.array(x, np.int64)) for i, x in alone.items()]
        ranks = np.full(len(ids), NO_RANK, np.int64)

        def rank(at: np.ndarray) -> None:
            """Sets the ranks of the pairs that begin at some places."""
            at = at[(at >= 0) & (at + 1 < len(ids))]
            keys = ids[at] << 32 | ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            ranks[at] = np.where((self.pairs[place] == keys) & (own[at] == own[at + 1]), self.pair_ranks[place], NO_RANK)

        if len(self.pairs):
            rank(np.arange(len(ids)))
        while len(ids):
            begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            lengths = np.diff(np.append(begins, len(ids)))
            least = np.minimum.reduceat(ranks, begins)
            over = np.repeat(least == NO_RANK, lengths)
            if over.any():
                done.append((own[over], ids[over]))
                ids, own, ranks = ids[~over], own[~over], ranks[~over]
                lengths, least = lengths[least != NO_RANK], least[least != NO_RANK]
            at = np.flatnonzero(ranks == np.repeat(least, lengths))
            at = at[np.append(True, own[at[1:]] != own[at[:-1]])] if len(at) else at
            ids[at] = self.made_array[ranks[at]]
            # A pair that its last symbol began begins at the new one now; it can't begin a pair into the next word.
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, own, ranks = ids[stays], own[stays], ranks[stays]
            at = at - np.arange(len(at))
            rank(at - 1)
            rank(at)
            if len(at) and at[-1] == len(ids) - 1:
                ranks[-1] = NO_RANK
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        own, ids = np.concatenate([o for o, _ in done]), np.concatenate([i for _, i in done])
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(words))

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long word, with a heap of pairs: near linear in its length."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j] = self.made[rank], False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := self.ranks.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, live in zip(ids, alive) if live]


def compile_lexicon(entries: dict[str, list[int]]) -> dict[str, np.ndarray]:
    """The minimal automaton of the words, built from sorted words with a register of finished states.

    ``arcs``: state * 256 + byte, sorted; ``targets`` and ``numbers`` beside it;
    ``final`` by state. The numbers along a path add up to a word's place among
    the sorted words; ``starts`` and ``ids`` hold what each place encodes to.
    """
    order = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items() if w)
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    below: list[list[tuple[int, int]]] = []
    sizes: list[int] = []

    def finish(node: list) -> int:
        """The number of the one state with these arcs and this finality."""
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            below.append(node[1])
            sizes.append(node[0] + sum(sizes[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[False, []]]  # of the last word: whether a word ends here, finished arcs
    last = b""
    for word, _ in order:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for at in range(len(last), common, -1):
            done = finish(path.pop())
            path[-1][1].append((last[at - 1], done))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for at in range(len(last), 0, -1):
        done = finish(path.pop())
        path[-1][1].append((last[at - 1], done))
    root = finish(path.pop())
    arcs, targets, numbers = [], [], []
    for state, out in enumerate(below):
        seen = int(finals[state])
        for label, target in out:
            arcs.append(state * 256 + label)
            targets.append(target)
            numbers.append(seen)
            seen += sizes[target]
    starts = np.cumsum([0, *(len(ids) for _, ids in order)])
    return {
        "arcs": np.array(arcs, np.int64), "targets": np.array(targets, np.int64), "numbers": np.array(numbers, np.int64),
        "final": np.array(finals, np.int64), "root": np.array([root], np.int64),
        "starts": starts.astype(np.int64), "ids": np.array([i for _, ids in order for i in ids], np.int64),
    }


def save_lexicon(lexicon: dict[str, np.ndarray], path: str) -> None:
    """One file: the lengths of the arrays in order, then the arrays, all as 8-byte integers."""
    np.concatenate([[len(x) for x in lexicon.values()], *lexicon.values()]).astype("<i8").tofile(path)


class Lexicon:
    """The memory-mapped automaton; looks up many words at a time."""

    def __init__(self, path: str) -> None:
        mapped = np.memmap(path, dtype="<i8", mode="r")
        names = ("arcs", "targets", "numbers", "final", "root", "starts", "ids")
        at, parts = len(names), {}
        for name, size in zip(names, mapped[: len(names)].tolist()):
            parts[name], at = mapped[at : at + size], at + size
        self.arcs, self.targets, self.numbers, self.final, root, self.starts, self.ids = parts.values()
        self.root = int(root[0])

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word, -1 for one that isn't in the lexicon."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        text = np.frombuffer(b"".join(coded), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state, place, live = np.full(len(words), self.root), np.zeros(len(words), np.int64), np.arange(len(words))
        depth = 0
        while len(live) and len(self.arcs):
            ended = sizes[live] == depth
            live = live[~ended]
            key = state[live] * 256 + text[begins[live] + depth]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            found = self.arcs[arc] == key
            state[live[~found]] = -1
            live, arc = live[found], arc[found]
            place[live] += self.numbers[arc]
            state[live] = self.targets[arc]
            depth += 1
        known = (state >= 0) & (self.final[np.maximum(state, 0)] > 0) if len(self.arcs) else np.zeros(len(words), bool)
        return np.where(known, place, -1)


def coded(vocabulary: Vocabulary, lexicon: Lexicon, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in turn, number of ids a word): from the lexicon, or merged where it lacks a word."""
    places = lexicon.places(words)
    lacking = places < 0
    merged, sizes_merged = vocabulary.merge_many([w for w, lacks in zip(words, lacking.tolist()) if lacks])
    begins, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    sizes[lacking] = sizes_merged
    begins[lacking] = np.cumsum(sizes_merged) - sizes_merged
    listed = places[~lacking]
    sizes[~lacking] = lexicon.starts[listed + 1] - lexicon.starts[listed]
    begins[~lacking] = lexicon.starts[listed] + len(merged)
    both = np.concatenate([merged, lexicon.ids])
    ends = np.cumsum(sizes)
    return both[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


def taken(values: array, at: np.ndarray) -> np.ndarray:
    """Copies of some of the values; the array may grow again once this returns."""
    return np.frombuffer(values, np.int64)[at] if len(values) else np.zeros(0, np.int64)


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHUNK_CHARS in all, with the place of the first."""
    start, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py()
        held.append(text)
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words, ``most`` at most, from counts over all documents.

    What stands between white space is counted in the JVM. A histogram of the
    counts' magnitudes tells from which count on there are ``most`` or fewer;
    only those come to the driver, which splits them into words.
    """
    runs = F.explode(words_of(F.lower(F.col(text_col).cast("string")))).alias("run")
    size = F.floor(F.log2("n") * 16).cast("int")
    # What is longer than LISTED_CHARS is merged exactly where it stands: what comes to the driver is bounded in bytes too.
    counted = cut(docs.select(runs).where(F.length("run") <= LISTED_CHARS).groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", size))
    least, total = 0, 0
    for row in sorted(counted.groupBy("size").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += row.words
        if total > most:
            least = row.size + 1
            break
    summed: Counter = Counter()
    for run, n, _ in counted.where(F.col("size") >= least).collect():
        for word in vocabulary.words(run):
            summed[word] += n
    return [w for w, _ in sorted(summed.items(), key=lambda x: (-x[1], x[0]))[:most]]


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lexicon_words: int = LEXICON_WORDS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *carry, ids): the token ids of every row of ``docs``, as the vocabulary's own library gives them.

    A null or empty text has no ids. Rows with one id, or none, keep a row each.
    A very long text is encoded whole, in memory as large as itself. ``path``
    must name the vocabulary file on the driver and the executors alike.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = Vocabulary(path)
    words = frequent_words(docs, vocabulary, text_col, lexicon_words)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = Path(tempfile.mkdtemp(prefix="handbill-")) / name
    save_lexicon(compile_lexicon({w: vocabulary.merge(w) for w in words}), str(file))
    spark.sparkContext.addFile(str(file))
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).cast("string").alias("_text"))
    kept = rows.drop("_text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lexicon = Vocabulary(path), Lexicon(SparkFiles.get(name))
        slots = Slots()
        starts, lengths, pool = array("q"), array("q"), array("q")
        for batch in batches:
            for start, texts in chunks(batch.column(len(kept))):
                by_text = [own.words(t) for t in texts]
                if len(slots) > MEMO_WORDS:
                    slots = Slots()
                    starts, lengths, pool = array("q"), array("q"), array("q")
                n_words = sum(map(len, by_text))
                at = np.fromiter(map(slots.__getitem__, chain.from_iterable(by_text)), np.int64, n_words)
                ids, sizes = coded(own, lexicon, slots.fresh)
                slots.fresh = []
                starts.frombytes((len(pool) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
                lengths.frombytes(sizes.astype(np.int64).tobytes())
                pool.frombytes(ids.astype(np.int64).tobytes())
                sizes = taken(lengths, at)
                ends = np.cumsum(sizes)
                total = int(ends[-1]) if len(ends) else 0
                gathered = taken(pool, np.repeat(taken(starts, at) - (ends - sizes), sizes) + np.arange(total)).astype(np.int32)
                bounds = np.cumsum([0, *map(len, by_text)])
                offsets = np.concatenate([[0], ends])[bounds]
                listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(gathered))
                others = [batch.column(i).slice(start, len(texts)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*others, listed], [*kept.names, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``to``: the tokens, word ends included, joined by a space.

    That is what the file's library gives, as it names no decoder. Ids without a token are skipped; null ids give null.
    """
    ship(encoded.sparkSession)
    names = [c for c in encoded.columns if c != to]
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(path).tokens
        table = np.array([tokens.get(i) for i in range(max(tokens) + 1)], object)
        whole = all(x is not None for x in table)
        for batch in batches:
            column = batch.column(place)
            ids, bounds, known = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist(), column.is_valid().to_pylist()
            start, held, size = 0, [], 0
            for row in range(batch.num_rows):
                own = ids[bounds[row] : bounds[row + 1]]
                if not known[row]:
                    held.append(None)
                elif whole and (not len(own) or (own.min() >= 0 and own.max() < len(table))):
                    held.append(" ".join(table[own].tolist()))
                else:
                    held.append(" ".join(t for i in own.tolist() if 0 <= i < len(table) and (t := table[i]) is not None))
                size += len(own)
                if size >= CHUNK_CHARS or row + 1 == batch.num_rows:
                    others = batch.slice(start, len(held)).columns
                    yield pa.RecordBatch.from_arrays([*others, pa.array(held, pa.string())], [*names, to])
                    start, held, size = row + 1, [], 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema)
    return encoded.select(*names).mapInArrow(run, f"{schema}, `{to}` string")
