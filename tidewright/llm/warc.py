"""A content-addressed WARC archive.

Payloads are stored once, zstandard-compressed, under the SHA-256 of their bytes; record headers (the WARC header and the
HTTP header, byte for byte) are stored apart with the key of their payload.  A join puts the original records together
again -- each payload is unpacked and must match its key -- and they are written as WARC files, one gzip member a record.
On reading, payloads are hashed anew and must match the digests and lengths that their headers, and those of their
revisits, state.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from itertools import batched
from urllib.parse import unquote_plus

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_file, write_once
from .shared import written

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records whose pages have none.
DATE = "2000-01-01T00:00:00Z"
#: What stands for a null page_id; others are named by their text, encoded as in a URL.
NO_PAGE = "<urn:x-page-null:>"
#: Compression of stored payloads and of WARC files, and bytes read at once.
LEVEL, GZIP_LEVEL, CHUNK = 6, 6, 1 << 20
#: Records of payloads below so many bytes are never revisits.
LEAST_BYTES = 0


def record_id(page_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:x-page:"), F.url_encode(page_id.cast("string")), F.lit(">")), F.lit(NO_PAGE))


def page_of(record: str | None) -> str | None:
    """The page_id, as text, of a record's name."""
    return unquote_plus(record[len("<urn:x-page:") : -1]) if record and record != NO_PAGE else None


def sha1_base32(data: bytes) -> str:
    return b32encode(hashlib.sha1(data).digest()).decode()


def described(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload): page_id, url, and the payload's key, digest and length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x or b"" for x in batch.column(2).to_pylist()]
            made = (pa.array(map(f, data)) for f in (lambda x: hashlib.sha256(x).hexdigest(), sha1_base32, len))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["page_id", "url", "key", "digest", "bytes"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "payload").mapInArrow(read, f"page_id {kind}, url string, key string, digest string, bytes long")


def packed(pages: DataFrame) -> DataFrame:
    """key, packed: each payload compressed, under the SHA-256 of its bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            data = [x or b"" for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashlib.sha256(x).hexdigest() for x in data), pa.array(map(packer.compress, data))], names=["key", "packed"])

    return pages.select("payload").mapInArrow(read, "key string, packed binary")


def write_archive(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Store a record for each row of ``pages`` (page_id, url, html) in folder: tables headers and payloads.

    Of records with equal payloads of at least least_bytes, the one with the smallest page_id is the response and the
    others revisit it; smaller payloads are all responses.  A null html is an empty payload, a null url an empty one
    (line breaks in a url are dropped).  Identifiers are of any type that can be ordered and cast from text.  Rows that
    repeat the smallest page_id are responses too; a null page_id never is a response that others revisit, and is one
    itself only if its payload has no other page_id.  Payloads of any length are stored whole.  An empty table gives an
    empty archive; other columns are not read.
    """
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("url"), F.encode("html", "UTF-8").alias("payload"))
    facts = written(described(rows), "warc-facts")
    owners = facts.groupBy(F.col("key").alias("of")).agg(F.min("page_id").alias("owner"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = (F.col("bytes") >= least_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("owner"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    records = facts.join(owners, F.col("key") == F.col("of")).withColumn("http", http).withColumn("revisit", revisit)
    records.select("page_id", "key", "revisit", F.encode(F.concat(head, "http"), "UTF-8").alias("header")).write.parquet(f"{folder}/headers")
    # Equal keys hold equal payloads, so any of them is kept; most copies go before the shuffle.
    packed(rows).groupBy("key").agg(F.first("packed").alias("packed")).write.parquet(f"{folder}/payloads")


def original_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record: the bytes of each WARC record.  Revisits carry no payload, so each payload is joined to its responses only.

    A payload that is absent or does not match its key is an error.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    responses = headers.where(~F.col("revisit")).join(spark.read.parquet(f"{folder}/payloads").withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    rows = responses.select("page_id", "key", "header", "packed").unionByName(headers.where("revisit").select("page_id", F.lit(None).cast("string").alias("key"), "header", F.lit(None).cast("binary").alias("packed")))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()

        def payload(key: str | None, packed: bytes | None) -> bytes:
            if key is None:
                return b""
            try:
                data = unpacker.decompress(packed)
            except (zstandard.ZstdError, TypeError):
                data = None
            if data is None or hashlib.sha256(data).hexdigest() != key:
                raise ValueError(f"payload and key disagree: {key}")
            return data

        for batch in batches:
            records = [h + payload(k, p) + b"\r\n\r\n" for k, h, p in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.binary())], names=["page_id", "record"])

    kind = headers.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(rebuild, f"page_id {kind}, record binary")


def export_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write records (page_id, record) as .warc.gz files, one per partition that has any; returns path and n_records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, count = f"{folder}/records-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return

        def fill(sink) -> None:
            nonlocal count
            batch = first
            while batch is not None:
                for record in batch.column(0):
                    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    sink.write(packer.compress(record.as_py()) + packer.flush())
                    count += 1
                batch = next(batches, None)

        write_once(path, fill)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count]})

    return written(records.select("record").mapInArrow(write, "path string, n_records long"), "warc-files")


def read_warc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a .warc.gz file, of which one record is held at a time."""

    def record(data: bytes) -> tuple[dict[str, str], bytes]:
        end = data.index(b"\r\n\r\n") + 4
        first, *lines = data[:end].decode().rstrip("\r\n").split("\r\n")
        if first != VERSION:
            raise ValueError(f"{path} holds something else than records")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        if len(data) != end + size + 4 or data[-4:] != b"\r\n\r\n":
            raise ValueError(f"a record of {path} and its length disagree")
        return fields, data[end : end + size]

    with open_file(path) as file:
        member, parts, data = zlib.decompressobj(31), [], b""
        while data := data or file.read(CHUNK):
            parts.append(member.decompress(data))
            data = member.unused_data
            if member.eof:
                yield record(b"".join(parts))
                member, parts = zlib.decompressobj(31), []
        if parts:
            raise ValueError(f"{path} ends within a record")


READ = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def read_archive(files: DataFrame, id_type: str = "long") -> DataFrame:
    """files: path.  page_id, url, record_type, refers_to, payload_bytes, payload_digest of each record in the files.

    Payloads are hashed anew.  A payload that does not match its header's digest or length, or a revisit that does not
    match the payload of the response that it names, is an error.  id_type: the type that identifiers are cast to.
    """
    spark, names = files.sparkSession, [x.split()[0] for x in READ.split(", ")]
    paths = [r.path for r in files.select("path").collect()]  # a row per file
    if not paths:
        return spark.createDataFrame([], READ).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})

    def facts(path: str) -> Iterator[tuple]:
        for fields, block in read_warc(path):
            http, payload = block.split(b"\r\n\r\n", 1)
            stated, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
            size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
            if kind == "response" and (sha1_base32(payload) != stated or len(payload) != size):
                raise ValueError(f"payload and header disagree: {fields}")
            yield page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, page_of(fields.get("WARC-Refers-To")), size, stated

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for rows in batched(facts(path), 10_000):
                    columns = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if n == "payload_bytes" else pa.string()) for n, x in zip(names, columns, strict=True)], names=names)

    listed = spark.sparkContext.parallelize([(p,) for p in paths], len(paths)).toDF("path string")
    rows = written(listed.mapInArrow(read, READ), "warc-records")
    # What a revisit says must hold for its response: the same digest and length.
    held = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("sha")).agg(F.max("payload_bytes").alias("held_bytes"))
    checked = rows.join(held, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("sha")), "left")
    fine = (F.col("record_type") != "revisit") | F.coalesce(F.col("payload_bytes") == F.col("held_bytes"), F.lit(False))
    digest = F.when(fine, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("revisit and response disagree: "), F.coalesce("page_id", F.lit("null")))).cast("string"))
    return checked.select(F.col("page_id").cast(id_type).alias("page_id"), "url", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "payload_bytes", digest.alias("payload_digest"))
