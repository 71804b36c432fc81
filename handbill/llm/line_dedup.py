"""Line dedup: lines that several documents share stay in one document only.

The hashes of all long enough lines are range-partitioned with the document as
part of the range, so a line of a third of all documents is spread over many
partitions; within a partition they are sorted by document and position, and
the first occurrence in each document is streamed out. From those come, per
hash, the number of documents and the one that keeps the line. What goes back to
the documents is a compressed bitmap of kept lines, never text.

All steps are DataFrame functions. Two 64-bit hashes stand for a line's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbill.llm.common import LOWER, SPACES, UPPER, cut, let, spread_join

MIN_KEY_CHARS = 20
MIN_DOCUMENTS = 3
#: Lines in one block of a bitmap.
BLOCK = 64


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    # lower() changes A-Z alone in a text of ASCII and is the faster of the two.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row a line with a key of ``min_chars`` or more: h1, h2, doc_id, row_key, pos."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_key"), F.split(text, "\n", -1).alias("lines"))
    lines = rows.select("doc_id", "row_key", F.posexplode("lines").alias("pos", "line"))
    lines = lines.where(F.length(F.btrim("line", F.lit(SPACES))) >= min_chars)
    keys = lines.select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key"))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_key", "pos")


def shared_lines(hashes: DataFrame, min_docs: int) -> DataFrame:
    """Per hash that ``min_docs`` documents or more hold: ``keeper``, the largest of their ids."""
    ranged = hashes.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    at = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    firsts = ranged.select("h1", "h2", "doc_id", at.alias("at")).where("at = 1")
    held = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    return held.where(F.col("n") >= min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keeper")


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_KEY_CHARS,
    min_docs: int = MIN_DOCUMENTS,
) -> DataFrame:
    """Per document that loses lines: doc_id, row_key, n_dropped and ``keep``.

    ``keep`` lists blocks of 64 lines as (block, bits), bit i for line 64 * block
    + i, 1 if it stays; a block that isn't listed stays whole. ``row_key`` is
    xxhash64 of the text, so that rows with one id and unlike texts stay apart.
    Rows that share an id are one document when documents are counted; a null id
    is a document too, the smallest. A null text is one empty line.
    """
    hashes = cut(line_hashes(docs, id_col, text_col, min_chars))
    shared = shared_lines(hashes, min_docs)
    lost = spread_join(hashes, shared, {"h1": "k1", "h2": "k2"}).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bit = F.expr(f"shiftleft(1L, pmod(pos, {BLOCK}))")
    blocks = (
        lost.select("doc_id", "row_key", F.expr(f"pos div {BLOCK}").cast("int").alias("block"), bit.alias("bit"))
        .groupBy("doc_id", "row_key", "block")
        .agg(F.bit_or("bit").alias("gone"))
    )
    listed = F.struct("block", F.bitwise_not("gone").alias("bits"))
    return blocks.groupBy("doc_id", "row_key").agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(listed)).alias("keep")
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that a bitmap keeps, joined by a line feed; the whole text for a null bitmap."""
    # Each listed block after the whole ones that it skips: one pass over the list.
    whole = F.lit(-1).cast("long")
    skipped = lambda x, i: x["block"] - F.coalesce(F.get(keep, i - 1)["block"], F.lit(-1)) - 1
    blocks = F.flatten(F.transform(keep, lambda x, i: F.concat(F.array_repeat(whole, skipped(x, i)), F.array(x["bits"]))))

    def apply(bits: Column) -> Column:
        def stays(_: Column, i: Column) -> Column:
            word = F.coalesce(F.get(bits, F.floor(i / BLOCK).cast("int")), F.lit(-1).cast("long"))
            return F.getbit(word, i % BLOCK) == 1

        return F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")

    return F.when(keep.isNull(), text).otherwise(let(blocks, apply))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: int) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the kept lines, plus n_lines and n_dropped (long).

    Every row stays, one for one, even when all its lines go (its text is then
    empty). A column of ``docs`` named n_lines or n_dropped is replaced.
    """
    maps = keep_bitmaps(docs, id_col, text_col, **params).select(F.col("doc_id").alias("map_id"), F.col("row_key").alias("map_key"), F.col("n_dropped").alias("map_n"), "keep")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # The caller's columns travel as one, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("row_key"))
    joined = rows.join(maps, (F.col("row_key") == F.col("map_key")) & F.col("id").eqNullSafe(F.col("map_id")), "left")
    kept = kept_text(F.col("text"), F.col("keep")).alias(text_col)
    return joined.select(
        *[kept if c == text_col else F.col("row").getField(c).alias(c) for c in names],
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce("map_n", F.lit(0).cast("long")).alias("n_dropped"),
    )
