"""Quality rules: counts of a text, and its distance from the prose of its language.

Two histograms of a document, over character classes and over the common words
of its language, are compared by Jensen-Shannon distance with references: the
sums of the same histograms over all documents of that language. A document
shorter than a guard is not judged by that histogram, nor is one of a language
with too little text. Characters are judged in every language, words in those that
have a word list.

Everything is DataFrame functions; the text is read once, the per-document
counts are checkpointed, and only one row a language is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import SPACES, cut, let, spread_join, words_of

SYMBOLS = "#*$%&|<>"
#: Common words, a dozen a language. A language that isn't listed gets no word histogram.
COMMON = {
    "de": "der die und in den von zu das mit sich des ist".split(),
    "en": "the of and to in a is that for it with as".split(),
    "es": "de la que el en los se del las un por con".split(),
    "fr": "de la le et les des en un une du que est".split(),
}
N_COMMON = 12
#: Upper-case letters, digits, white space, symbols, bytes beyond one a code point, and the rest.
CLASSES = ("upper", "digit", "space", "symbol", "wide", "other")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Guards and thresholds of the distances (0 to 1, logarithms to base 2).
MIN_CHARS_JUDGED = 300
MIN_WORDS_JUDGED = 150
MIN_REFERENCE_WORDS = 5000
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.22
#: Languages up to which the references are broadcast.
MOST_BROADCAST = 10_000


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more among ``words``.

    Windows are compared by a 64-bit hash. Where all are distinct, as in most
    texts, that is all; else they are sorted by hash and position, and equal
    neighbours are repeats. Each word counts once however many repeated windows
    hold it.
    """

    def repeated(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.aggregate(
            F.array_sort(F.transform(same, lambda x: x["p"])),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
            lambda a: a["n"],
        )

    def among(h: Column) -> Column:
        placed = F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(placed), repeated))

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.slice(hashes, F.lit(1), F.size(w) - 2), among))

    return let(words, of)


def found(text: Column, part: str) -> Column:
    """How often ``part`` occurs in ``text``, overlaps aside."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))
    return (gone / F.lit(len(part.encode()))).cast("long")


def common_counts(words: Column, lang: Column) -> Column:
    """How often each common word of the language occurs; null for a language without a list.

    A common word counts in lower case, in capitals and with one capital at its start.
    """
    every = sorted({x for v in COMMON.values() for w in v for x in (w, w.upper(), w.capitalize())})
    # Each hit between spaces of its own, so that a search for " of " meets every one.
    hits = F.concat(F.lit(" "), F.lower(F.array_join(F.filter(words, lambda w: w.isin(every)), "  ")), F.lit(" "))

    def of(h: Column) -> Column:
        out = F.lit(None)
        for k, v in COMMON.items():
            out = F.when(lang == k, F.array(*[found(h, f" {w} ") for w in v])).otherwise(out)
        return out

    return let(hits, of)


def counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of ``docs``: the base counts, ``chars`` (by class) and ``commons`` (by common word); ``carry`` as _carried.

    A null text is empty. Rows with equal or null ids stay separate rows. Other
    columns of ``docs``, whatever their names, are neither read nor returned.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = [F.struct(*carry).alias("_carried")] if carry else []
    base = docs.select(*held, F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != F.lit(""))
    classes = F.mask(F.col("text"), F.lit("X"), F.lit("x"), F.lit("0"), F.lit(None))
    own = ["_carried"] if carry else []
    base = base.select(
        *own, "doc_id", "lang", "text", words_of(F.col("text")).alias("words"), lines.alias("lines"), classes.alias("classes")
    )
    base = base.select(
        *own,
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_all"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        reduce(lambda a, b: a + b, [found(F.col("text"), c) for c in SYMBOLS]).alias("n_symbols"),
        found(F.col("classes"), "X").alias("n_upper"),
        found(F.col("classes"), "0").alias("n_digits"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        common_counts(F.col("words"), F.col("lang")).alias("commons"),
    )
    space, wide = F.col("n_all") - F.col("word_chars"), F.col("n_bytes") - F.col("n_all")
    parts = [F.col("n_upper"), F.col("n_digits"), space, F.col("n_symbols"), wide]
    rest = F.greatest(F.lit(0), F.col("n_all") - reduce(lambda a, b: a + b, parts))
    others = F.col("n_words") - F.aggregate("commons", F.lit(0).cast("long"), lambda a, x: a + x)
    return base.select(
        *own, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*parts, rest).alias("chars"), F.concat("commons", F.array(others)).alias("commons"),
    )


def references(counted: DataFrame) -> DataFrame:
    """One row a language: the summed histograms of all its documents; that of words is null without a list."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("commons", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON + 1)]
    grouped = counted.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("n_words").alias("ref_words"), *sums)
    return grouped.select(
        F.col("lang").alias("ref_lang"),
        "ref_words",
        F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_chars"),
        F.array(*[f"w{i}" for i in range(N_COMMON + 1)]).alias("ref_commons"),
    )


def js_distance(p: Column, q: Column, size: int) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; null if either is null or empty."""
    at = lambda a, i: F.get(a, F.lit(i)).cast("double")
    sums = [reduce(lambda a, b: a + b, [at(x, i) for i in range(size)]) for x in (p, q)]

    def of(t: Column) -> Column:
        terms = []
        for i in range(size):
            a, b = at(p, i) / t["p"], at(q, i) / t["q"]
            m = (a + b) / 2
            terms += [F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0)) for x in (a, b)]
        return F.sqrt(F.greatest(F.lit(0.0), reduce(lambda x, y: x + y, terms) / 2))

    return F.when((sums[0] > 0) & (sums[1] > 0), let(F.struct(sums[0].alias("p"), sums[1].alias("q")), of))


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Counts, distances and the verdict ``kept`` of every row of ``docs``, and its columns ``carry``.

    ``kept`` is false for fewer than MIN_WORDS words, for repeats above
    MAX_REPEAT_PERCENT, and for a judged distance above its maximum. A distance
    is null (no verdict) below its length guard, for a null language, and where
    the language's documents hold fewer than MIN_REFERENCE_WORDS words; that of
    words also in a language without a list. A very long text is counted whole.
    An empty table gives an empty result.
    """
    counted = cut(counts(docs, id_col, text_col, lang_col, carry))
    found = cut(references(counted))
    # A row a language is small, unless something else stands in that column.
    few = found.count() <= MOST_BROADCAST
    judged = counted.join(F.broadcast(found), F.col("lang") == F.col("ref_lang"), "left") if few else spread_join(counted, found, {"lang": "ref_lang"}, "left")
    enough = F.col("ref_words") >= MIN_REFERENCE_WORDS
    chars = F.when(enough & (F.col("word_chars") >= MIN_CHARS_JUDGED), js_distance(F.col("chars"), F.col("ref_chars"), len(CLASSES)))
    words = F.when(enough & (F.col("n_words") >= MIN_WORDS_JUDGED), js_distance(F.col("commons"), F.col("ref_commons"), N_COMMON + 1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False))
    own = ["_carried.*"] if carry else []
    return judged.select(
        *own, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.round(chars, 6).alias("char_distance"), F.round(words, 6).alias("word_distance"),
    ).select(
        *carry, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance",
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits: float) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, with their columns.

    The verdicts are computed once a row and joined back by id and text; equal
    rows have equal verdicts. A column of ``docs`` may have any name.
    """
    named = {"id": id_col, "text": text_col, "lang": lang_col}
    # The caller's columns travel as one, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`").alias(k) for k, c in named.items()])
    rows = rows.withColumn("key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("lang").cast("string")))
    verdicts = quality(rows, "id", "text", "lang", carry=("key",), **limits).where("kept")
    verdicts = verdicts.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    same = (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id"))
    return rows.join(verdicts, same, "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
