"""WARC archives through a table of record chunks.

A payload is a run of rows (record, chunk number, bytes) with the digest of all bytes so far, so
neither writing nor reading holds a whole record: the writer streams chunks into one gzip member per
record, the reader streams members back into chunk rows. The digest of the last chunk is that of the
payload. Records with equal payloads are found by digest and size; one of them is written as the
response, the others as revisits that refer to it.

Each task writes archive files of its own below the folder given, which all machines must reach, and
reports them as rows; the stored report is the list of archives. A task that is run again writes
other files, and what its first attempt left isn't in the list.

Cases: a null payload is empty; empty payloads equal each other. A null id is written as an empty one
and read back as null; it is never referred to while its payload has another id. Rows that repeat an
id and a payload are responses all. Header values lose line breaks. An empty table gives no archives
and no rows. Only the id, the address and the payload are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import batch_of, field_type, in_arrow, same, small, stored

CHUNK = 1 << 20
#: Bytes of a file after which the next one is begun.
FILE_BYTES = 1 << 30
#: Rows sent to every task at most (about 100 bytes each).
MOST_SENT = 500_000
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def bare_digest(sha1) -> str:
    """Base32 of a SHA-1."""
    return base64.b32encode(sha1.digest()).decode()


def sources(pages: DataFrame, id_col: str, payload_col: str, uri_col: str | None) -> DataFrame:
    """`id`, `uri`, `payload`, `n_bytes` and a key of the payload."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    uri = F.coalesce(F.col(uri_col).cast("string"), F.lit("")) if uri_col else F.lit("")
    return pages.select(F.col(id_col).alias("id"), uri.alias("uri"), payload.alias("payload")).select(
        "id", "uri", "payload", F.octet_length("payload").cast("long").alias("n_bytes"),
        F.xxhash64("payload").alias("row_key"),
    )


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """`rows` with `chunk_no`, `n_chunks` and `data` instead of `payload`; a record's chunks follow
    each other in one partition."""
    count = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk)).cast("int")
    numbers = F.sequence(F.lit(0), F.col("n_chunks") - 1)
    kept = [c for c in rows.columns if c != "payload"]
    return (
        rows.withColumn("n_chunks", count)
        .select(*kept, "payload", "n_chunks", F.explode(numbers).alias("chunk_no"))
        .withColumn("data", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
        .drop("payload")
    )


def digested(chunks: DataFrame) -> DataFrame:
    """Per record of a chunk table: `id`, `row_key`, `n_bytes`, `n_chunks`, `digest`."""
    keys = ["id", "row_key", "n_bytes", "n_chunks"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = hashlib.sha1()
        for batch in batches:
            at, found = [], []
            numbers, counts = batch.column("chunk_no").to_pylist(), batch.column("n_chunks").to_pylist()
            for i, data in enumerate(batch.column("data")):
                if numbers[i] == 0:
                    running = hashlib.sha1()
                running.update(data.as_buffer())
                if numbers[i] == counts[i] - 1:
                    at.append(i)
                    found.append(bare_digest(running))
            schema = pa.schema([*(batch.schema.field(k) for k in keys), ("digest", pa.string())])
            yield batch_of(schema, *(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), found)

    out = f"id {field_type(chunks, 'id')}, row_key long, n_bytes long, n_chunks int, digest string"
    return in_arrow(chunks.select(*keys, "chunk_no", "data"), each, out)


def decided(records: DataFrame, least_bytes: int) -> DataFrame:
    """`records` with `refers_to`: the largest id with the same payload, null for responses."""
    groups = (
        records.where(F.col("n_bytes") >= least_bytes)
        .groupBy("digest", "n_bytes").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n")
    )
    other = F.when(~same(F.col("id"), F.col("response")), F.col("response"))
    return records.join(groups, ["digest", "n_bytes"], "left").withColumn("refers_to", other).drop("response")


#: What Hadoop calls a file system and what Arrow calls it, where the names differ.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def record_id(value: str) -> str:
    return f"<urn:x-record:{quote(value, safe='')}>"


def id_of(urn: str) -> str:
    return unquote(urn[len("<urn:x-record:") : -1])


def arrow_uri(spark: SparkSession, folder: str) -> str:
    """The folder as tasks open it: qualified by Spark's file systems, so that a path without a scheme means the
    same place for both, and in the terms of Arrow, which writes the files.

    Raises for a file system that Arrow doesn't know here.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, rest = whole.split(":", 1)
    uri = f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}"
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ValueError) as problem:
        raise ValueError(f"archives can't be kept at {whole}: tasks open file, hdfs, s3, gs and abfs paths ({problem})") from problem
    return uri


class _Files:
    """The archive files of one task."""

    def __init__(self, folder: str, level: int, most: int):
        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.folder, self.level, self.most = folder, level, most
        self.out, self.name, self.bytes, self.records, self.done = None, "", 0, 0, []

    def begin(self) -> None:
        if self.out is not None and self.bytes >= self.most:
            self.close()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.bytes, self.records = self.system.open_output_stream(f"{self.base}/{self.name}", compression=None), 0, 0
        self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.records += 1

    def write(self, data) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self._put(self.member.flush())

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.records, self.bytes))
            self.out = None


def _clean(value: str) -> str:
    return " ".join(value.split())


def header(identity: str, uri: str, n_bytes: int, digest: str, refers_to: str | None, date: str) -> tuple[bytes, bytes]:
    """The record's header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(identity)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(uri)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        lines += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    lines += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (n_bytes if refers_to is None else 0))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n", http


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url",
    least_bytes: int = 0, chunk: int = CHUNK, level: int = 1, date: str = "1970-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES, most_sent: int = MOST_SENT,
) -> DataFrame:
    """Write the archives below `folder`; returns their stored list (path, records, bytes)."""
    spark = pages.sparkSession
    rows = sources(pages, id_col, payload_col, uri_col)
    records = stored(decided(digested(chunked(rows, chunk)), least_bytes), "warc-records")
    # The writer makes a record's digest itself if it sees the whole payload at once.
    needed = records.where("refers_to IS NOT NULL OR n_chunks > 1").select(
        F.col("id").alias("its_id"), F.col("row_key").alias("its_key"), "digest",
        F.col("refers_to").cast("string").alias("refers_to"),
    ).distinct()
    needed = stored(needed, "warc-needed")
    decisions = small(needed, needed.count(), most_sent)
    match = same(F.col("id"), F.col("its_id")) & (F.col("row_key") == F.col("its_key"))
    known = rows.join(decisions, match, "left").drop("its_id", "its_key", "row_key")
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    content = F.octet_length(payload).cast("long")
    parts = chunked(known.withColumns({"full_bytes": F.col("n_bytes"), "n_bytes": content, "payload": payload}), chunk)
    parts = parts.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "uri", "full_bytes", "digest", "refers_to",
        "chunk_no", "n_chunks", "data",
    )
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    folder = arrow_uri(spark, folder)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, level, file_bytes)
        running = hashlib.sha1()
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in batch.schema.names[:-1]]
            for (identity, uri, full, digest, refers_to, number, count), cell in zip(zip(*columns), batch.column("data")):
                data = cell.as_buffer()
                if number == 0:
                    running = hashlib.sha1(data)
                    own = bare_digest(running) if digest is None else digest
                    head, http = header(identity, uri, full, own, refers_to, date)
                    files.begin()
                    files.write(head)
                    files.write(http)
                else:
                    running.update(data)
                files.write(data)
                if number == count - 1:
                    if refers_to is None and bare_digest(running) != own:
                        raise ValueError(f"the payload of record {identity} changed while it was written")
                    files.write(b"\r\n\r\n")
                    files.end()
        files.close()
        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield batch_of(schema, *(zip(*files.done) if files.done else [[]] * 3))

    return stored(in_arrow(parts, each, "path string, records long, bytes long"), "warc-archives")


class _Stream:
    """Bytes of an archive of gzip members, read piece by piece."""

    def __init__(self, source):
        self.source, self.raw, self.plain = source, b"", bytearray()
        self.member = zlib.decompressobj(31)

    def _fill(self) -> bool:
        while True:
            if self.member.eof:
                self.raw = self.member.unused_data or self.raw
                self.member = zlib.decompressobj(31)
            data = self.raw or self.source.read(1 << 18)
            self.raw = b""
            if not data:
                return False
            got = self.member.decompress(data, 1 << 20)
            self.raw = self.member.unconsumed_tail
            if got:
                self.plain += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to the mark, without it; None at the end of the archive."""
        start = 0
        while (at := self.plain.find(mark, start)) < 0:
            start = max(0, len(self.plain) - len(mark))
            if not self._fill():
                if self.plain:
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def some(self, most: int) -> bytes:
        """At least one and at most so many bytes."""
        if not self.plain and not self._fill():
            raise ValueError("the archive ends within a record")
        out = bytes(self.plain[:most])
        del self.plain[:most]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.plain) < n and self._fill():
            pass
        return self.some(n) if n else b""


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, v in pairs}


def records_of(source, chunk: int) -> Iterator[tuple]:
    """Chunk rows of an archive: id, uri, type, refers_to, declared digest and size, chunk number,
    whether it is the last, bytes and digest so far, data."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = _fields(head)
        left = int(fields["content-length"])
        http = stream.until(b"\r\n\r\n") if left else b""
        left -= len(http) + 4 if http else 0
        kind = fields["warc-type"]
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        refers = fields.get("warc-refers-to")
        size = int(_fields(http).get("content-length", left))
        common = (
            id_of(fields["warc-record-id"]), fields.get("warc-target-uri", ""), kind,
            id_of(refers) if refers else None, declared, size,
        )
        running, number, so_far = hashlib.sha1(), 0, 0
        while True:
            data = stream.exactly(min(chunk, left))
            running.update(data)
            left, so_far = left - len(data), so_far + len(data)
            yield (*common, number, left == 0, so_far, bare_digest(running), data)
            number += 1
            if not left:
                break
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError(f"record {common[0]} is longer or shorter than it says")


def read_archives(archives: DataFrame, id_type: str = "long", chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk table of the listed archives: `id`, `uri`, `record_type`, `refers_to`,
    `declared_digest`, `declared_bytes`, `chunk_no`, `last`, `bytes_so_far`, `digest_so_far` and
    `data` (null without `payloads`). Files are dealt to tasks one by one."""
    schema = pa.schema([
        ("id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
        ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()),
        ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary()),
    ])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as source:
                    for row in records_of(source, chunk):
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(row[-1]) + 200
                        if held >= 16 * CHUNK:
                            yield batch_of(schema, *zip(*rows))
                            rows, held = [], 0
                if rows:
                    yield batch_of(schema, *zip(*rows))

    out = (
        "id string, uri string, record_type string, refers_to string, declared_digest string, declared_bytes long, "
        "chunk_no int, last boolean, bytes_so_far long, digest_so_far string, data binary"
    )
    n = max(1, archives.count())
    found = in_arrow(archives.select("path").repartition(n), each, out)

    def typed(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)).cast(id_type)

    return found.withColumns({"id": typed("id"), "refers_to": typed("refers_to")})


def records_read(chunks: DataFrame) -> DataFrame:
    """Per record: `id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`. What a revisit
    leaves out is as its header says; a response is measured."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        "id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
