"""Spelling variants of words without pairs of words: wildcard groups for replacements, deletions for insertions.

Each word has a row for itself, for each of its wildcards (position, prefix,
suffix) and for each word that one deletion makes of it. Rows of one key form a
group. Words that share a wildcard differ by one replacement; a word meets those
that one deletion turns into it. A group tells each row its size and its two most
frequent words, so the best near word that isn't the word itself is known
without pairs. A group has at most a row for each letter of the alphabet and
place of the word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbill.llm.common import LOWER, UPPER, cut

LETTERS = r"A-Za-zÀ-ÿ"
#: Code points of the shortest word, and occurrences of the rarest.
MIN_CHARS = 7
MIN_COUNT = 2
#: A near word is the form of a word if it is that many times as frequent.
RATIO = 10
#: Stands for any letter; no letter itself.
ANY = "?"


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, run): the maximal runs of ``least`` letters or more of every whole text, A-Z in lower case. A null text has none."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def word_counts(runs: DataFrame, word: str = "run", least: int = MIN_CHARS, count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least ``least`` code points that occur ``count`` times or more."""
    kept = runs.where(F.length(word) >= least)
    return kept.groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def keys_of(word: Column, least: int) -> Column:
    """The word, its wildcards, and what one deletion makes of it, if that is long enough to be a word."""
    places = F.sequence(F.lit(1), F.length(word))
    but = lambda i, mark: F.concat(F.substr(word, F.lit(1), i - 1), F.lit(mark), F.substr(word, i + 1))
    shorter = F.when(F.length(word) > least, F.array_distinct(F.transform(places, lambda i: but(i, "")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(word), F.transform(places, lambda i: but(i, ANY)), shorter)


def near_words(words: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(word, n, n_near, near, near_n) of ``words`` (word, n): how many words are one edit off, and the most frequent of them.

    Ties go to the word that is first in code-point order. ``words`` has a row a word.
    """
    rows = words.select("word", "n", F.explode(keys_of(F.col("word"), least)).alias("key"))
    # The word that is the key comes first: it is what the others of its group are near to.
    group = Window.partitionBy("key")
    order = group.orderBy(F.col("word") != F.col("key"), F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = F.struct(F.negate("n").alias("less"), "word")
    told = rows.select("word", "n", "key", F.count(F.lit(1)).over(group).alias("size"), F.nth_value(pair, 1).over(order).alias("first"), F.nth_value(pair, 2).over(order).alias("second"))
    own, wild = F.col("word") == F.col("key"), F.contains("key", F.lit(ANY))
    met = told.where(own | (wild & (F.col("size") > 1)) | (~wild & (F.col("first.word") == F.col("key"))))
    near = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    each = met.select("word", "n", F.when(own | wild, F.col("size") - 1).otherwise(1).alias("k"), near.alias("near"))
    best = each.groupBy("word").agg(F.max("n").alias("n"), F.sum("k").alias("n_near"), F.min("near").alias("near"))
    return best.select("word", "n", "n_near", F.col("near.word").alias("near"), F.negate("near.less").alias("near_n"))


def group_variants(words: DataFrame, ratio: int = RATIO, least: int = MIN_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n).

    The form of a word is its most frequent near word, if that is ``ratio`` times
    as frequent (2 or more); the root is the end of the chain of forms, the word
    itself without one. Counts grow along a chain, so its length is the logarithm
    of the largest count and half of it is joined each round. Without words there are no rows.
    """
    is_form = F.col("near_n") >= ratio * F.col("n")
    found = near_words(words, least).select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    found = cut(found)
    ends = found.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    longest = int(math.log(ends.hi / max(1, ends.lo), ratio) + 1) if ends.hi else 1
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest))):
        further = links.select(F.col("word").alias("w"), F.col("root").alias("r"))
        links = cut(links.join(further, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root")))
    rooted = found.join(links.select(F.col("word").alias("w"), "root"), F.col("word") == F.col("w"), "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
