"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handbill.llm import bpe, byte_bpe, html_text, line_dedup, media, mixing, periodic, quality, secrets, simhash, toxicity, variants, warc
from handbill.llm.common import let, words_of
from handbill.llm.sql import SQL  # noqa: F401

#: The vocabulary file of op8 and of the pipeline.
VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
#: The rank file of op11.
RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = media.index(media.store(table(spark, sf_dir, "documents")))
    frames = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"].cast("string"), k["size"].cast("string"))), ",")
    feature = F.concat_ws(";", "codec", F.concat_ws("/", F.col("duration").cast("string"), F.col("timescale").cast("string")), F.col("n_samples").cast("string"), F.size("keyframes").cast("string"), F.md5(frames))
    return indexed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def digests_of_tokens(encoded: DataFrame, path: str, tokenizer=bpe) -> DataFrame:
    """Per row of encode(): doc_id and the digests of its ids and of what they decode to."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokenizer.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), number("guess"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = warc.read(warc.write(pages))
    return records.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests_of_tokens(bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return digests_of_tokens(encoded, RANKS, byte_bpe)


def with_typing_errors(runs: DataFrame) -> DataFrame:
    """``runs`` (doc_id, run) with ``word``: the run, or what is left of it where a code point goes missing: one run in 31, told by a checksum."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.withColumn("word", F.when(h % 31 == 0, shorter).otherwise(F.col("run")))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = with_typing_errors(variants.letter_runs(table(spark, sf_dir, "documents")))
    return variants.group_variants(variants.word_counts(runs, "word"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` where one document in ten, told by a checksum of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    text = F.col("text").cast("string")
    return docs.withColumn("text", F.when(h % 10 == 0, let(words_of(text), repeated)).otherwise(text))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), F.negate(r["start"]).alias("start"), F.negate(r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    start, length, period = F.negate(longest["start"]), longest["length"], F.negate(longest["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_media": op1_media,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_warc": op5_warc,
    "op6_html_text": op6_html_text,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_variants": op12_variants,
    "op13_periodic": op13_periodic,
}
