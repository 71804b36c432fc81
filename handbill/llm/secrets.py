"""Secret scans: patterns, and values in credential contexts that are hard to guess.

The patterns find assignments, access keys and hexadecimal runs. Beyond them, a
value in a wider credential context is a secret if an attacker would need many
guesses: the least costly segmentation of it into known words, dates, repeats,
keyboard walks and brute-force spans, found by dynamic programming over its
positions, costs GUESSES (a power of ten) or more. So "changeme2024" or a plain
word is left alone and a random value isn't.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import cut, ship

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KEY = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|private[ _-]?key|credentials?|bearer|auth)["']?"""
SIGN = r"""\x20*(?:=>|->|:=|[:=])\x20*"""
#: Behind any of these stands a value that is judged by its guess cost, up to VALUE's end; another key isn't one.
CONTEXT = re.compile(rf"""{KEY}(?:{SIGN}|\x20+is\x20+|\x20+)["']?(?!{KEY}{SIGN})(?=[^\s"'<>,;])""", re.ASCII | re.IGNORECASE)
VALUE = re.compile(r"""[^\s"'<>,;]+""", re.ASCII)
#: The password of an address is judged too.
ADDRESS = re.compile(r"://[^\s/:@]+:([^\s/@]+)@", re.ASCII)
HINTS = ("pass", "pwd", "secret", "token", "api", "private", "credential", "bearer", "auth", "://")
BASE_HINTS = ("passw", "secret", "token", "api")
#: log10 of the guesses from which on a value counts as a secret.
GUESSES = 10.0
#: The same for a value that reads like a word where prose may follow: a rare word of a dozen letters costs less.
PROSE_GUESSES = 16.0
#: Words of passwords, by how soon they are tried; those of the corpus come after them.
WORDS = {
    w: i + 1
    for i, w in enumerate(
        """password admin secret qwerty letmein welcome login master user key get set by id is new my the test
        hello dragon monkey shadow root pass changeme default example guest token access api football baseball iloveyou
        sunshine princess love summer winter spring autumn monday tuesday wednesday thursday friday saturday sunday january
        february march april june july august september october november december michael jordan charlie superman batman
        trustno house server database private public system oracle mysql postgres redis docker google apple amazon azure
        cloud company temp demo sample dummy none null required placeholder insert your here value string field reset
        forgot change update enter invalid missing expired element account manager configuration service meeting handler
        factory provider controller request response session client config file path name data type list item object
        function class method event process thread buffer index table column query error message code input output""".split()
    )
}
#: Words of the corpus that the costs are fitted on, at most, and the texts that must hold one.
CORPUS_WORDS = 50_000
MIN_DOCUMENTS = 5
WORD_CHARS = (3, 24)
#: A word of any language, as far as letters tell: never five ASCII consonants in a row.
WORDLIKE = re.compile(r"(?!.*[b-df-hj-np-tv-xz]{5})[^\W\d_](?:[a-z'-]|[^\W\d_\x00-\x7f])*")
#: Characters of the longest unit whose repeats are tried, and how often at most unless to the end of its run.
UNIT, TIMES = 128, 8
#: Letters that digits and signs stand for.
LEET = str.maketrans("4301$5@7!8", "aeoissatib")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
DATES = (
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), math.log10(365 * 120)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), math.log10(365 * 120 * 2)),
    (re.compile(r"(?:19|20)\d\d"), math.log10(120)),
)


def steps() -> dict[str, set[str]]:
    """For each character those beside it on the keyboard, in the alphabet or in counting."""
    beside: dict[str, set[str]] = {}
    for row in ROWS:
        for a, b in zip(row, row[1:]):
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    for upper, lower in zip(ROWS, ROWS[1:4]):
        for i, c in enumerate(lower):
            for other in upper[i : i + 2]:
                beside.setdefault(c, set()).add(other)
                beside.setdefault(other, set()).add(c)
    return beside


BESIDE = steps()


def alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def case_cost(word: str) -> float:
    """What the capitals of a word cost: nothing for none, two ways for one at its start or for all."""
    return 0.0 if word == word.lower() else 0.3 if word in (word.capitalize(), word.upper()) else 0.7


#: Characters of the longest keyboard walk that is cheaper than GUESSES; a longer one is no way to a cheap value.
WALK = 66


def suffix_costs(value: str, words: dict[str, int], longest: int) -> list[float]:
    """log10 of the guesses that the cheapest segmentation of value[i:] needs, for each i, by dynamic programming from the end.

    A segment is what an attacker tries as one: a word, a date, a repeat, a
    keyboard walk of up to WALK characters, a single character. What a segment costs
    depends on its own characters alone, so one pass serves every end of the value.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # lowering may lengthen a text; then its letters are taken as they are
        low = value
    plain = low.translate(LEET)
    single = [math.log10(alphabet(c)) for c in value]
    repeated: list[list[tuple[int, int]]] = [[] for _ in value]
    for start, unit, times in repeats(value):
        repeated[start].append((unit, times))
    units: dict[str, float] = {}
    best = [math.inf] * n + [0.0]
    walk = n  # where a walk that starts at i ends
    for i in range(n - 1, -1, -1):
        least = single[i] + best[i + 1]
        for end in range(i + 2, min(i + longest, n) + 1):
            rank = words.get(plain[i:end]) or words.get(low[i:end])
            if rank is not None:
                least = min(least, math.log10(rank + 1) + case_cost(value[i:end]) + 0.7 * (low[i:end] != plain[i:end]) + best[end])
        if value[i] in "0123":
            for pattern, cost in DATES:
                if m := pattern.match(value, i):
                    least = min(least, cost + best[m.end()])
        if i + 1 < n and low[i + 1] not in BESIDE.get(low[i], ()):
            walk = i + 1
        for end in range(i + 3, min(walk, i + WALK) + 1):
            # Where it starts, how long it is, and which of a few ways it turns at each step.
            least = min(least, math.log10(len(BESIDE) * (end - i)) + 0.1 * (end - i) + best[end])
        for unit, times in repeated[i]:
            one = value[i : i + unit]
            if one not in units:  # the unit itself at its least cost
                units[one] = sum(single[i : i + unit]) if unit < 3 else suffix_costs(one, words, longest)[0]
            least = min(least, units[one] + math.log10(times) + best[i + unit * times])
        best[i] = least
    return best


def repeats(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, unit, times) of the repeats in a value of any length: units of up to UNIT characters, TIMES times at most or to the end of their run.

    One character repeats three times or more, else twice is enough. A unit that
    repeats within itself is none; the shorter one stands for it.
    """
    n = len(value)
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    for unit in range(1, min(UNIT, n // 2) + 1):
        if n < 64:  # for short values a loop is faster
            unlike = [-1, *(i for i in range(n - unit) if value[i] != value[i + unit]), n - unit]
            runs = [(a + 1, b) for a, b in zip(unlike, unlike[1:]) if b - a > max(unit, 2)]
        else:
            unlike = np.concatenate([[-1], np.flatnonzero(codes[:-unit] != codes[unit:]), [n - unit]])
            at = np.flatnonzero(np.diff(unlike) > max(unit, 2))
            runs = zip((unlike[at] + 1).tolist(), unlike[at + 1].tolist())
        for first, last in runs:
            one = value[first : first + unit]
            if (one + one).find(one, 1) < unit:
                continue
            for start in range(first, last - max(unit, 2) + 1):
                most = (last - start) // unit + 1
                for times in range(3 if unit == 1 else 2, min(most, TIMES + 1)):
                    yield start, unit, times
                yield start, unit, most


def guess_cost(value: str, words: dict[str, int] | None = None, longest: int | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs."""
    words = WORDS if words is None else words
    return suffix_costs(value, words, longest or max(map(len, words), default=0))[0]


class Values:
    """The values of a text. A value ends where its run of characters does, so all that start in one run are costed together, once."""

    def __init__(self, text: str, words: dict[str, int] | None, longest: int | None) -> None:
        self.text, self.words = text, WORDS if words is None else words
        self.longest = longest or max(map(len, self.words), default=0)
        self.start, self.run_end, self.end, self.costs, self.last = 0, 0, 0, [0.0], -1

    def at(self, start: int) -> tuple[int, float]:
        """(end, cost) of the value from ``start`` on, without marks at its end; ``last`` is the place of its last letter or digit."""
        if not self.start <= start < self.run_end:
            run = VALUE.match(self.text, start)
            value = run.group().rstrip(".!?)")
            self.start, self.run_end, self.end = start, run.end(), start + len(value)
            self.last = start + max((i for i in range(len(value) - 1, -1, -1) if value[i].isalnum()), default=-1)
            self.costs = suffix_costs(value, self.words, self.longest)
        return max(start, self.end), self.costs[min(start, self.end) - self.start]


def scan(text: str | None, words: dict[str, int] | None = None, longest: int | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind in the order of KINDS.

    ``words`` gives the ranks of words for the guess costs; WORDS if it is None.
    """
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(h in low for h in BASE_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(h in low for h in HINTS):
        values, at = Values(text, words, longest), 0
        key, address = CONTEXT.search(text), ADDRESS.search(text)
        while key or address:
            if key and not (address and address.start() < key.start()):
                start, (end, cost) = key.end(), values.at(key.end())
                # After a mere space or "is" prose may follow: there a value that reads like a word must cost more.
                signed = any(c in "=:>" for c in key.group())
                least = PROSE_GUESSES if not signed and WORDLIKE.fullmatch(text, start, end) else GUESSES
                judged = signed or start <= values.last
                past = values.run_end
            else:
                start, end, past, judged, least = *address.span(1), address.end(), True, GUESSES
                cost = guess_cost(text[start:end], values.words, values.longest)
            found = judged and cost >= least
            if found:
                out.append(("guess", start, end))
            at = past if found else start  # a rejected value may hold the next key
            key = CONTEXT.search(text, at) if key and key.start() < at else key
            address = ADDRESS.search(text, at) if address and address.start() < at else address
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> dict[str, int]:
    """WORDS and after them the words of the corpus by how many documents hold them: ``most`` at most, so the driver and each task can hold them.

    Counts are over all documents. A word is a run of letters of WORD_CHARS length
    in MIN_DOCUMENTS different texts or more, so a secret that is in one text, or in
    copies of it, isn't one. One that near copies spread may be, if it is of letters alone.
    Each text has one of 64 bits by its hash: the bits of a word's texts, which
    tasks combine before the shuffle, are at most as many as its texts.
    """
    few, many = WORD_CHARS
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{few},}}"), F.lit(0)))
    bit = F.expr("shiftleft(1L, cast(pmod(own, 64) AS int))").alias("bit")
    texts = docs.select(F.xxhash64(text).alias("own"), found.alias("words"))
    words = texts.select(bit, F.explode("words").alias("word")).where(F.length("word") <= many)
    size = F.floor(F.log2("n") * 16).cast("int").alias("size")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bit").alias("bits")).where(F.bit_count("bits") >= MIN_DOCUMENTS)
    counted = cut(counted.select("word", "n", size))
    # A histogram of the counts' magnitudes tells from which on there are ``most`` words or fewer.
    least, total = 0, 0
    for row in sorted(counted.groupBy("size").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += row.words
        if total > most:
            least = row.size + 1
            break
    ordered = [r.word for r in sorted(counted.where(F.col("size") >= least).collect(), key=lambda r: (-r.n, r.word))]
    ranks = dict(WORDS)
    for w in ordered:
        ranks.setdefault(w, len(ranks) + 1)
    return ranks


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the secrets of every row of ``docs`` as (kind, start, end), ends exclusive.

    A null text is empty and has none. Rows that share an id, or have none, keep
    a row each. A very long text, or value, is scanned whole. Of equal starts the kinds come in the order of KINDS.
    Words are those of WORDS and of the corpus; they are broadcast, CORPUS_WORDS of at most 24 characters.
    """
    spark = docs.sparkSession
    ship(spark)
    words = corpus_words(docs, text_col)
    sent = spark.sparkContext.broadcast((words, max(map(len, words))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(x.as_py(), *sent.value)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")
