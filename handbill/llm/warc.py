"""WARC archives: written by tasks, indexed first, read back by coalesced byte ranges.

write() puts one record a page into files in the shared folder and returns the
index: file, offset, length, url and digest of each record. read() takes any
selection of index rows, puts neighbours into one task by a range partitioning
on file and offset, and merges ranges that are near each other into one read.
Payloads that were stored before become revisit records without a body.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbill.llm.common import fresh_path, ship, spread_join

MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task starts another file after so many bytes.
FILE_BYTES = 256 << 20
#: Ranges with a gap of up to GAP_BYTES are read as one, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Stored bytes that one reading task gets at most, and at least where there are fewer tasks than the session's shuffle partitions.
TASK_BYTES = 256 << 20
LEAST_TASK_BYTES = 1 << 20
INDEX = "page_id {id}, url string, file string, offset long, length long, digest string, record_type string, refers_to {id}"


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) of every row of ``pages``.

    Of rows with one payload of MIN_REVISIT_BYTES or more, those with the
    smallest id are responses, the others revisit it. A null payload is empty. A
    null id comes after all others; payloads that have only null ids are all
    responses. Rows that share an id and a payload get the same record type.
    Bodies travel once, to the task that writes them, spread evenly where one payload has very many copies.
    """
    body = F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_REVISIT_BYTES
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = firsts.select(F.col("digest").alias("_digest"), "_first")
    joined = spread_join(rows, firsts, {"digest": "_digest"}, "left")
    again = large & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to")
    )


def line(value: object) -> str:
    """A header's value on one line."""
    return " ".join(str(value).split())


def record(row: dict, zipped: bool, place: str = "") -> bytes:
    """One WARC record: named fields, the block, two line ends. ``place``, its file and offset, makes its id unlike all others.

    The page's own id, of any type and percent-encoded, is a field beside it; a null id has none. A revisit
    names the page that it refers to in the same way, and the payload's digest.
    """
    block = b"" if row["record_type"] == "revisit" else row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["page_id"] is not None:
        head.append(f"Page-ID: {quote(str(row['page_id']), safe='')}")
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {line(row['url'])}")
    head += [f"WARC-Payload-Digest: sha256:{row['digest']}", f"WARC-Payload-Length: {len(row['payload'])}"]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {quote(str(row['refers_to']), safe='')}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    out = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if zipped else out


def parse(data: bytes) -> dict:
    """The fields and the block of one record; raises ValueError if it isn't one."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size:
        raise ValueError("a record is cut short")
    return fields | {"block": block}


def write(pages: DataFrame, path: str | None = None, zipped: bool = True, **columns: str) -> DataFrame:
    """Writes a record a page, each a gzip member of its own unless not ``zipped``, below ``path`` and returns the index, itself a written table.

    A task that runs again writes files of new names; the index has only those
    of the attempt that Spark took, and no record is lost or doubled. The
    folder must be one that the driver and all executors share.
    """
    spark = pages.sparkSession
    ship(spark)
    path = path or fresh_path(spark, "warc")
    rows = revisits(pages, **columns)
    names = rows.columns
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, file, offset = None, "", 0
        for batch in batches:
            made: list[tuple] = []
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i].as_py() for j, k in enumerate(names)}
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    file, offset = f"{uuid.uuid4().hex}.warc" + ".gz" * zipped, 0
                    out = store.open_output_stream(f"{root}/{file}", compression=None)
                data = record(row, zipped, f"{file}:{offset}")
                out.write(data)
                made.append((file, offset, len(data)))
                offset += len(data)
            at = {k: batch.column(j) for j, k in enumerate(names)}
            columns = [at["page_id"], at["url"], *(pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))), at["digest"], at["record_type"], at["refers_to"]]
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    rows.mapInArrow(run, INDEX.format(id=kind)).write.mode("overwrite").parquet(f"{path}/index")
    found = spark.read.schema(INDEX.format(id=kind)).parquet(f"{path}/index")
    return found.withColumn("file", F.concat(F.lit(f"{path}/"), "file"))


def ranges(records: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, places): runs of records, sorted by file and offset, that one read covers."""
    run: list[int] = []
    file, start, end = "", 0, 0
    for i, (f, a, n) in enumerate(records):
        if run and (f != file or a - end > GAP_BYTES or a + n - start > READ_BYTES):
            yield file, start, end, run
            run = []
        if not run:
            file, start, end = f, a, a
        run.append(i)
        end = max(end, a + n)
    if run:
        yield file, start, end, run


def read(index: DataFrame) -> DataFrame:
    """The records of the selected ``index`` rows (any with file, offset, length): page_id as text and what the archive says.

    ``payload_bytes`` and ``payload_digest`` of a response are of the bytes that
    were read; those of a revisit are of its fields, as it has no body. A range
    of up to READ_BYTES is read at a time, a longer record whole. An empty index gives an empty result.
    """
    ship(index.sparkSession)
    placed = index.select("file", "offset", "length")
    stored = placed.agg(F.sum("length")).first()[0] or 0
    tasks = 1 + max(stored // TASK_BYTES, min(stored // LEAST_TASK_BYTES, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened, handle = "", None, None
        for batch in batches:
            records = list(zip(*(c.to_pylist() for c in batch.columns)))
            for file, start, end, places in ranges(records):
                if file != name:
                    if handle is not None:
                        handle.close()
                    opened, at = fs.FileSystem.from_uri(file)
                    name, handle = file, opened.open_input_file(at)
                data = handle.read_at(end - start, start)
                out: list[tuple] = []
                for i in places:
                    _, a, n = records[i]
                    r = parse(data[a - start : a - start + n])
                    again = r["warc-type"] == "revisit"
                    size = int(r["warc-payload-length"]) if again else len(r["block"])
                    digest = r["warc-payload-digest"].removeprefix("sha256:") if again else hashlib.sha256(r["block"]).hexdigest()
                    page, first = (unquote(r[k]) if k in r else None for k in ("page-id", "refers-to-page-id"))
                    out.append((page, r.get("warc-target-uri"), size, digest, r["warc-type"], first, None if again else r["block"]))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], [c.split(" ")[0] for c in schema.split(", ")])
        if handle is not None:
            handle.close()

    return placed.mapInArrow(run, schema)
