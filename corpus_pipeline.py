"""A corpus pipeline of five stages over documents; each stage calls one operator of handbill.llm.

run(spark, sf_dir) writes the result of each stage as Parquet in the shared folder
and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handbill.llm import bpe, line_dedup, mixing, quality, queries, similar
from handbill.llm.common import cut, discard, fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null text is empty and goes, as do all texts below 50 words. Repeated rows
    stay or go together, and so do rows that share id and text. An empty table gives an empty result.
    """
    return with_columns(quality.keep(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that another document keeps.

    Every row stays, with an empty text if all its lines go or its text is null.
    Rows that share an id count as one document; a null id is the smallest.
    """
    return with_columns(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8).

    It is the row with the smallest id; ties go to the least hash of the other
    columns, then of the text. Groups are of texts, not of ids: two unrelated
    texts with one id keep a row each, and repeated rows leave one. A null id
    comes after all others, and its copies go like any other. A null text is an
    empty one; texts without words are near copies of each other. An empty table
    gives an empty result.

    op3's search, SimHash at 3 of 64 bits, gives the first candidates. 64 bits can't tell similarity 0.8
    within limits, so ``similar`` adds those of MinHash bands, and shingle sets decide on both.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("lang", "source"), F.col("text").isNull())
    marked = docs.select(F.struct(*COLUMNS).alias("row"), similar.key_of().alias("own"), order.alias("order"))
    # Copies of a text are combined before the shuffle, so each text travels once.
    classes = marked.groupBy("own").agg(F.min_by("row", "order").alias("row"))
    firsts = marked.groupBy("own").agg(F.min("order").alias("first"))
    members = cut(similar.groups(docs).join(firsts, F.col("key") == F.col("own")).select("key", "root", F.struct("first", "key").alias("first")))
    kept = members.groupBy("root").agg(F.min("first")["key"].alias("kept"))
    gone = members.join(kept.select("kept"), F.col("key") == F.col("kept"), "left_anti").select("key")
    return with_columns(classes.join(gone, F.col("own") == F.col("key"), "left_anti").select("row.*"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, none or up to three times.

    A null source is a source. A source without words is not taken. Repeated
    rows are taken as often as that many documents are.
    """
    return with_columns(mixing.mix(docs.select(*COLUMNS)))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mixture: the number and digests of its tokens. A null or empty text has none; repeated rows stay."""
    return queries.digests_of_tokens(bpe.encode(docs, queries.VOCABULARY), queries.VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]
#: SQL can't express fingerprints and tokens; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, a written table; those of the stages before go as soon as the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
