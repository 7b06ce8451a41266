"""WARC archives: monolithic gzip files, rewritten with one gzip member for each record and an offset index.

``write_archives`` makes a WARC record of every row and lets Spark write them as text files under the gzip
codec: each file is one gzip stream, as many crawlers leave them, which only a reader of the whole file
can use.  ``normalise`` inflates each such file once, in pieces, and rewrites every record as a gzip member
of its own; the members' places go to a sidecar index, a Parquet table that is written last.  The index
is also what counts: a task that is repeated writes a file of another name, and files that no index row
names are left by lost tasks.  ``read_archives`` deals the index over tasks, seeks to the members it
needs and inflates just these.

A payload of at least ``LEAST_SHARED`` bytes that occurs again is stored once, with the largest key that
has it (``response``); the others are ``revisit`` records, which name the response and hold no payload.
Equal payloads are found by SHA-1, XXH64 and length together.

Memory: a task holds a piece of a file and a record's header while it rewrites, and one record while it
reads.  Archives are opened with pyarrow, so the shared folder may be on any file system that pyarrow
knows by its address; the pages are read by Spark.

Defined cases: a null payload is empty; a null address is empty, control characters and spaces in one are
percent-encoded; a null key is less than any other, and payloads with null keys alone are all responses;
rows that share the largest key are all responses; repeated rows are records of their own; an empty table gives
archives without records; other columns are ignored; very long payloads are stored whole.  A file that
ends inside a record, or whose payload misses its digest, is an error that names it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, new_folder, remove, settle, table, trim

#: Payloads of fewer bytes are stored each time.
LEAST_SHARED = 1000
#: Bytes of archive that a reading task is meant to get.
READ_BYTES = 8 << 20
#: Bytes that are inflated or read at a time.
PIECE = 1 << 20

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# fixed values of the format
VERSION, LINE, RECORD_END = "WARC/1.1", "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, record_type string, key long, payload_digest string, payload_bytes long, refers_to long"


# from rows to records


def with_verdicts(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """key, url, payload, digest, bytes and ``response`` (null: the row is one) of each row."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long"), "other": F.xxhash64("payload")})
    same = ["digest", "bytes", "other"]
    shared = rows.where(F.col("bytes") >= LEAST_SHARED).groupBy(*same).agg(F.max("key").alias("response"), F.count("*").alias("n"))
    shared = settle(shared.where("n > 1 AND response IS NOT NULL").drop("n"))
    found = rows.join(if_small(shared), same, "left").drop("other")
    return found.withColumn("response", F.when(~F.col("response").eqNullSafe(F.col("key")), F.col("response")))


def _record_id(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", key.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _address(url: Column) -> Column:
    """The address without characters that could end a header line."""
    out = F.coalesce(url, F.lit(""))
    for c in "\r\n\t ":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def record(rows: DataFrame) -> Column:
    """A row of ``with_verdicts`` as the text of a WARC record, but for the lines that end it."""
    revisit = F.col("response").isNotNull()
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    length = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("bytes"))
    lines = F.concat_ws(
        LINE,
        F.lit(VERSION),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", _record_id(F.col("key"), F.col("digest"))),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", _address(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, header("WARC-Refers-To", _record_id(F.col("response"), F.col("digest")))),
        header("X-Key", F.col("key")),
        header("X-Refers-To-Key", F.col("response")),
        header("X-Payload-Length", F.col("bytes")),
        F.lit("Content-Type: application/http; msgtype=response"),
        header("Content-Length", length),
    )
    return F.concat(lines, F.lit(RECORD_END + HTTP_HEAD), F.when(revisit, "").otherwise(F.col("payload")))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """A WARC record for every row, in files of one gzip stream each; the payloads are not shuffled where few are shared."""
    rows = with_verdicts(pages, key, url, payload)
    rows.select(record(rows).alias("value")).write.option("compression", "gzip").option("lineSep", RECORD_END).text(folder)


# from one stream a file to one member a record


class Inflated:
    """The bytes of a gzip file, of one member or of many, inflated as they are asked for."""

    def __init__(self, raw, name: str):
        self.raw, self.name, self.held = raw, name, bytearray()
        self.z, self.waiting, self.begun = zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        """A piece more in ``held``; False at the end of the file."""
        while True:
            if self.z.eof:
                self.waiting = self.z.unused_data
                self.z, self.begun = zlib.decompressobj(31), False
            data = self.waiting or self.raw.read(PIECE)
            ended = not data
            data = data if self.begun else data.lstrip(b"\0")  # padding between members
            try:
                got = self.z.decompress(data, PIECE)
            except zlib.error as e:
                raise ValueError(f"{self.name}: {e}") from e
            self.waiting = self.z.unconsumed_tail
            self.begun |= bool(data)
            if got:
                self.held += got
                return True
            if ended and not self.z.eof:
                if self.begun:
                    raise ValueError(f"{self.name}: the file ends inside a gzip member")
                return False

    def header(self) -> bytes | None:
        """The next record's header with the empty line that ends it; None at the end of the file."""
        while True:
            while len(self.held) < 2:
                if not self._more():
                    if self.held:
                        raise ValueError(f"{self.name}: the file ends inside a record's header")
                    return None
            if self.held[:2] != b"\r\n":  # such lines stand between records
                break
            del self.held[:2]
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            seen = len(self.held)
            if not self._more():
                raise ValueError(f"{self.name}: the file ends inside a record's header")
        out = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes."""
        while size:
            if not self.held and not self._more():
                raise ValueError(f"{self.name}: the file ends inside a record")
            out = bytes(self.held[:size])
            del self.held[: len(out)]
            size -= len(out)
            yield out


def fields(header: bytes) -> dict[str, str]:
    """A header's named lines, the names in lower case."""
    lines = header.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:80]!r}")
    return {n.strip().lower(): v.strip() for n, found, v in (x.partition(":") for x in lines[1:]) if found}


class _Payload:
    """Digest and length of what follows the HTTP header of a block, fed in pieces."""

    def __init__(self, http: bool):
        self.head, self.sha, self.bytes = (b"" if http else None), hashlib.sha1(), 0

    def feed(self, piece: bytes) -> bytes:
        """The part of the piece that belongs to the payload."""
        if self.head is not None:
            self.head += piece
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return b""
            piece, self.head = self.head[at + 4 :], None
        self.sha.update(piece)
        self.bytes += len(piece)
        return piece


def _long(text: str | None) -> int | None:
    return None if text is None else int(text)


def _described(named: dict[str, str], payload: _Payload, name: str) -> tuple:
    """The index's values of a record that has been read; checks the payload that is there."""
    kind, digest = named.get("warc-type"), named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = _long(named.get("x-payload-length"))
    if kind != "revisit":
        if named.get("x-payload-length") is not None and (digest, size) != (payload.sha.hexdigest(), payload.bytes):
            raise ValueError(f"{name}: a payload of {payload.bytes} bytes misses its digest {digest}")
        digest, size = payload.sha.hexdigest(), payload.bytes
    return kind, _long(named.get("x-key")), digest, size, _long(named.get("x-refers-to-key"))


def opened(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it."""
    return pafs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))


def normalise(files: DataFrame, target: str) -> None:
    """Rewrites the archives of ``files`` (path) below ``target``: ``<name>.warc.gz`` files and ``index``, a Parquet table of INDEX.

    Every record is a gzip member; its place in the file is ``offset`` and ``length``.
    """
    schema = pa.schema([("file", pa.string()), *[(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in INDEX.split(", ")[1:])]])

    def rewritten(path: str) -> Iterator[pa.RecordBatch]:
        place, source = opened(path)
        home, base = opened(target)
        name = f"{source.rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex}.warc.gz"
        offset, rows = 0, []
        with place.open_input_stream(source, compression=None) as raw, home.open_output_stream(f"{base}/{name}", compression=None) as out:
            stream = Inflated(raw, path)
            while (header := stream.header()) is not None:
                named = fields(header)
                payload = _Payload("http" in named.get("content-type", ""))
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                length = out.write(z.compress(header))
                for piece in stream.pieces(int(named["content-length"])):
                    payload.feed(piece)
                    length += out.write(z.compress(piece))
                length += out.write(z.compress(RECORD_END.encode()) + z.flush())
                kind, key, digest, size, refers = _described(named, payload, path)
                rows.append((name, offset, length, kind, key, digest, size, refers))
                offset += length
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                    rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from rewritten(path)
        trim()

    home, base = opened(target)
    home.create_dir(base, recursive=True)
    files.select("path").mapInArrow(of, INDEX).write.parquet(f"{target}/index")


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of a folder's gzip files, dealt over tasks by their sizes; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "length").where("length > 0")


# reading through the index


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


RECORD = "record_type string, key long, url string, payload_digest string, payload_bytes long, refers_to long"


def read_archives(folder: str, index: DataFrame, payload: bool = True) -> DataFrame:
    """The records whose members ``index`` names (all of ``read_index``, or any rows of it), with their payload if asked for.

    A revisit's payload is null; digest and size are those of the full payload.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    block = (F.col("offset") / READ_BYTES).cast("long")
    dealt = index.select("file", "offset", "length").repartition(max(1, -(-total // READ_BYTES)), "file", block).sortWithinPartitions("file", "offset")
    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payload
    kinds = {"key": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def member(data: bytes, name: str) -> dict:
        stream = Inflated(pa.BufferReader(data), name)
        named = fields(stream.header())
        found, kept = _Payload("http" in named.get("content-type", "")), []
        for piece in stream.pieces(int(named["content-length"])):
            part = found.feed(piece)
            if payload:
                kept.append(part)
        kind, key, digest, size, refers = _described(named, found, name)
        out = {"record_type": kind, "key": key, "url": named.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size, "refers_to": refers}
        return out | ({"payload": None if kind == "revisit" else b"".join(kept)} if payload else {})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, base = opened(folder)
        name, file, rows, size = None, None, [], 0
        for batch in batches:
            for at, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if at != name:
                    if file is not None:
                        file.close()
                    name, file = at, home.open_input_file(f"{base}/{at}")
                rows.append(member(file.read_at(length, offset), f"{at} at {offset}"))
                size += 200 + length
                if size > PIECE:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_pylist(rows, schema)
        trim()

    return dealt.mapInArrow(of, RECORD + ", payload binary" * payload)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, single = new_folder(spark, "warc-whole"), new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), whole)
    normalise(archive_files(spark, whole), single)
    remove(spark, whole)
    read = read_archives(single, read_index(spark, single), payload=False)
    out = settle(read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, single)
    return out


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT *, CASE WHEN strlen(html) >= {LEAST_SHARED} THEN max(page_id) OVER (PARTITION BY html) END AS latest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN latest IS NULL OR latest IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN latest IS DISTINCT FROM page_id THEN latest END AS refers_to
FROM s
"""
