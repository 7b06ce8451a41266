"""BPE encoding through a distinct-word table, and decoding through an id-to-piece join.

Texts are read in chunks of bounded size.  A chunk numbers its distinct words and turns each
text into word numbers.  The chunks' distinct words are dealt out by hash, so equal words of all
chunks meet in one part of the distinct-word table, where each is encoded once; its ids go back
to the chunks that asked and are put in place of the word numbers.  Only distinct words of
chunks and compressed word numbers are shuffled, never the text or one row a word.  A word that
is in every text is in every chunk once, so it makes no hot key.

Decoding looks up the pieces of the ids in the vocabulary, whose size the tokenizer fixes (a join
with that small side by position), and joins them with the space that the library's decoder puts
between pieces.

The chunks are made twice, once for the words and once for the numbers, so ``docs`` must be
read from storage or settled; both readings carry a checksum of the chunk's words, and the join
fails rather than mix chunks that differ.

The table's parts grow with the input, up to MOST_PARTS; beyond that a part's words are many, and
its task forgets them after KNOWN_WORDS, so memory stays bounded and a word may be encoded again.

Defined cases: a null text is empty and has no ids; a very long text is a chunk of its own; strings
of special tokens in a text become their id, as in the library; a null doc_id is kept; repeated rows
are encoded each; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table, trim, trimmed

#: A chunk ends when its texts have this many characters, or this many distinct words.
CHUNK_CHARS = 8_000_000
CHUNK_WORDS = 200_000
#: Parts of the distinct-word table: PARTS_PER_SPLIT for each split of the input, within these bounds.  The upper
#: one keeps a dozen words or more of a full chunk in each packed row that goes to a part.
PARTS_PER_SPLIT = 4
LEAST_PARTS, MOST_PARTS = 512, 1 << 14
#: Words that a task on a part keeps the ids of.
KNOWN_WORDS = 1_000_000
#: Ids in one output batch.
BATCH_IDS = 1_000_000


class _Chunk:
    def __init__(self):
        self.number: dict[str, int] = {}
        self.docs: list[tuple[int | None, bytes]] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str, split, keep: bool) -> None:
        number = self.number
        words = split(text)
        for w in words:
            if w not in number:
                number[w] = len(number)
        if keep:
            codes = np.fromiter(map(number.__getitem__, words), dtype="<u4", count=len(words))
            self.docs.append((doc_id, zstandard.ZstdCompressor(level=1).compress(_narrow(codes))))
        self.chars += len(text) + 1

    def full(self) -> bool:
        return self.chars >= CHUNK_CHARS or len(self.number) >= CHUNK_WORDS

    def ordered(self, parts: int) -> tuple[list[str], np.ndarray, np.ndarray, int]:
        """Words, the part of each of them, the order that puts parts together, and a checksum."""
        words = list(self.number)
        part = np.fromiter((zlib.crc32(w.encode()) for w in words), dtype="<u4", count=len(words)) % parts
        return words, part, np.argsort(part, kind="stable"), zlib.crc32(" ".join(words).encode())


def parts_for(splits: int) -> int:
    """Parts of the distinct-word table for an input of ``splits`` splits: a power of two."""
    return min(MOST_PARTS, max(LEAST_PARTS, 1 << (splits * PARTS_PER_SPLIT - 1).bit_length()))


def _narrow(codes: np.ndarray) -> bytes:
    """Numbers in two bytes each where they fit, after a byte that tells which."""
    small = not len(codes) or codes.max() < 1 << 16
    return (b"\x02" + codes.astype("<u2").tobytes()) if small else (b"\x04" + codes.tobytes())


def _widen(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1)


def _chunks(batches: Iterator[pa.RecordBatch], spec: str, keep: bool) -> Iterator[tuple[int, _Chunk]]:
    split = tokens.encoder(spec).split
    first = TaskContext.get().partitionId() << 32
    chunk, n = _Chunk(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            chunk.add(doc_id, text.as_py() or "", split, keep)
            if chunk.full():
                yield first + n, chunk
                chunk, n = _Chunk(), n + 1
    if chunk.chars:
        yield first + n, chunk


def _words(docs: DataFrame, spec, parts: int) -> DataFrame:
    """part, chunk, check, words: the distinct words of each chunk that belong to the part, in the chunk's order, as packed lines."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("check", pa.int64()), ("words", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for number, chunk in _chunks(batches, spec.value, keep=False):
            words, part, order, check = chunk.ordered(parts)
            used, counts = np.unique(part, return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            dealt = [words[i] for i in order]
            lines = [squeeze("\n".join(dealt[i:j]).encode()) for i, j in zip(offsets, offsets[1:])]
            same = [pa.array(np.full(len(used), v, np.int64)) for v in (number, check)]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *same, pa.array(lines, pa.binary())], schema=schema)

    return docs.mapInArrow(trimmed(of), "part int, chunk long, check long, words binary")


def _codes(docs: DataFrame, spec, parts: int) -> DataFrame:
    """chunk, check, doc_id, codes: a row for each text, and a first one with the chunk's checksum and the order of its words."""
    schema = pa.schema([("chunk", pa.int64()), ("check", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in _chunks(batches, spec.value, keep=True):
            _, _, order, check = chunk.ordered(parts)
            packed = zstandard.ZstdCompressor(level=1).compress(_narrow(order.astype("<u4")))
            for at in range(0, len(chunk.docs), 5000):
                own = chunk.docs[at : at + 5000]
                head = [(check, None, packed)] if not at else []
                rows = head + [(None, d, c) for d, c in own]
                columns = [pa.array([number] * len(rows), pa.int64())] + [pa.array(x, t) for x, t in zip(zip(*rows), schema.types[1:])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(trimmed(of), "chunk long, check long, doc_id long, codes binary")


def _encode_parts(words: DataFrame, spec) -> DataFrame:
    """chunk, check, part, sizes, ids: each part of the distinct-word table encodes each of its words once."""
    schema = pa.schema([("chunk", pa.int64()), ("check", pa.int64()), ("part", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(spec.value)
        known: dict[str, bytes] = {}
        current = None
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            rows = []
            for part, chunk, check, lines in zip(*(c.to_pylist() for c in batch.columns)):
                if part != current or len(known) > KNOWN_WORDS:
                    known, current = {}, part
                words = zstandard.ZstdDecompressor().decompress(lines).decode().split("\n")
                encoder.learn([w for w in words if w not in known], known)
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), dtype="<u4", count=len(found)) // tokens.ID_BYTES
                rows.append((chunk, check, part, squeeze(_narrow(sizes)), squeeze(_narrow(np.frombuffer(b"".join(found), dtype="<u4")))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    dealt = words.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(trimmed(of), "chunk long, check long, part int, sizes binary, ids binary")


def _put_in_place(key, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
    """The texts of one chunk: word numbers replaced by the ids of the words."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    parts = sorted(zip(right["part"].to_pylist(), right["sizes"].to_pylist(), right["ids"].to_pylist()))
    sizes = np.concatenate([_widen(s).astype(np.int64) for _, s, _ in parts] or [np.zeros(0, np.int64)])
    flat = np.concatenate([_widen(i).astype("<u4") for _, _, i in parts] or [np.zeros(0, "<u4")])
    codes, heads = left["codes"], [i for i, c in enumerate(left["check"].to_pylist()) if c is not None]
    order = np.concatenate([np.zeros(0, np.int64), *(_widen(codes[i].as_py()).astype(np.int64) for i in heads)])
    checks = {*right["check"].to_pylist(), *(left["check"][i].as_py() for i in heads)}
    if len(heads) != 1 or len(checks) != 1 or len(order) != len(sizes):
        raise ValueError("a chunk's words changed between two readings; settle the documents first")
    start, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    start[order] = np.cumsum(sizes) - sizes
    size[order] = sizes
    doc_ids = left["doc_id"].to_pylist()
    rows: list[tuple[int | None, bytes]] = []
    pending = 0
    for i in range(left.num_rows):
        if i == heads[0]:
            continue
        numbers = _widen(codes[i].as_py())
        n = size[numbers]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start[numbers] - (ends - n), n) + np.arange(total)]
        rows.append((doc_ids[i], ids.tobytes()))
        pending += total
        if pending > BATCH_IDS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
            rows, pending = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)


def encode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and ids (binary, see ``tokens``) for each row of ``docs``."""
    spec = tokens.load(docs.sparkSession, tokenizer_path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_for(docs.rdd.getNumPartitions())  # ``docs`` is read from storage, so this runs nothing
    encoded = _encode_parts(_words(docs, spec, parts), spec)

    def place(key, left: pa.Table, right: pa.Table) -> pa.Table:
        placed = pa.Table.from_batches(_put_in_place(key, left, right), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))
        trim()
        return placed

    return _codes(docs, spec, parts).groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(place, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that its ids' pieces make; special tokens are kept."""
    vocabulary = tokens.load_pieces(encoded.sparkSession, tokenizer_path)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(vocabulary.value, pa.large_string())
        for batch in batches:
            column = batch.column(1)
            for at in range(0, batch.num_rows, 500):
                ids = [x or b"" for x in column.slice(at, 500).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) // tokens.ID_BYTES for x in ids])])
                joined = pieces.take(pa.array(np.frombuffer(b"".join(ids), dtype="<u4")))
                text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), joined), pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), column.slice(at, 500), text.cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(of), "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return decode(encode(docs)).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
