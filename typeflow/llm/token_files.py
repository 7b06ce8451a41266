"""Token-ID files in shuffled planes.

Documents are range-partitioned and sorted by doc_id; each partition becomes a shard.  A shard is
a run of chunks of whole documents; a chunk cuts its ids into blocks of BLOCK_IDS ids, transposes
each block into byte planes (all lowest bytes, then all second bytes, ...) and compresses each
plane with zstandard.  Chunks are rows of a Parquet table ``chunks`` with the documents' ids and
lengths.  ``index`` holds, for each chunk, its first id's place in the whole sequence and its least
and greatest doc_id: ``read`` takes the places from it, and ``read_documents`` opens only the chunks
whose bounds hold a wanted doc_id.  Spark's writer and reader move all bytes, so any file system it
knows will do, and a lost task is written again or not at all.

Defined cases: a null text is empty, so it has the end id only; a very long text is encoded whole
and is a chunk of its own; null doc_ids come first; rows of equal doc_id are in the order of their
text's 64-bit hash, and equal rows may be dealt over several shards, so they make no hot range; an
empty table makes empty files; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import new_folder, portions, remove, settle, table

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
END_ID = 1
PLANES = tokens.ID_BYTES

_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int32()),
        ("shard_start", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("planes", pa.list_(pa.binary())),
    ]
)
_DDL = "shard int, chunk int, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, planes array<binary>"


def pack(ids: np.ndarray, level: int = 1) -> list[bytes]:
    """Blocks of ids as compressed byte planes: PLANES entries a block, lowest bytes first."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    out = []
    for at in range(0, len(ids), BLOCK_IDS):
        block = np.ascontiguousarray(ids[at : at + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
        out += [squeeze(plane.tobytes()) for plane in block]
    return out


def unpack(planes: list[bytes]) -> np.ndarray:
    """The ids that ``pack`` was given."""
    open_ = zstandard.ZstdDecompressor().decompress
    blocks = []
    for at in range(0, len(planes), PLANES):
        rows = [np.frombuffer(open_(p), dtype=np.uint8) for p in planes[at : at + PLANES]]
        blocks.append(np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").ravel())
    return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, shards: int | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write them as token files under ``path``; shards grow in number with the input's splits."""
    spark = docs.sparkSession
    spec = tokens.load(spark, tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    end = np.array([end_id], dtype="<u4").tobytes()

    def row(chunk: int, start: int, docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(b for _, b in docs), dtype="<u4")
        values = (TaskContext.get().partitionId(), chunk, start, len(ids), [d for d, _ in docs], [len(b) // tokens.ID_BYTES for _, b in docs], pack(ids))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _SCHEMA.types)], schema=_SCHEMA)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.WordIds(tokens.encoder(spec.value))
        chunk = start = size = 0
        held: list[tuple[int | None, bytes]] = []
        for batch in batches:
            encoded = (ids for run in portions(t.as_py() or "" for t in batch.column(1)) for ids in known.texts(run))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                held.append((doc_id, ids + end))
                size += len(held[-1][1]) // tokens.ID_BYTES
                if size >= CHUNK_IDS:
                    yield row(chunk, start, held)
                    chunk, start, size, held = chunk + 1, start + size, 0, []
        if held:
            yield row(chunk, start, held)

    keyed = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("own"))
    dealt = keyed.repartitionByRange(shards, "doc_id", "hash", "own").sortWithinPartitions("doc_id", "hash", "own").select("doc_id", "text")
    dealt.mapInArrow(of, _DDL).write.option("compression", "uncompressed").parquet(f"{path}/chunks")

    bounds = [F.array_min("doc_ids").alias("least_doc_id"), F.array_max("doc_ids").alias("greatest_doc_id"), F.exists("doc_ids", lambda d: d.isNull()).alias("has_null")]
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "shard_start", "n_ids", *bounds)
    first = (F.col("before") + F.col("shard_start")).alias("first_id")
    placed = chunks.join(F.broadcast(_shard_starts(chunks)), "shard").select("shard", "chunk", first, "n_ids", "least_doc_id", "greatest_doc_id", "has_null")
    placed.write.parquet(f"{path}/index")


def _shard_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each shard: one row a shard, so its size is bounded by the number of write partitions."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _documents(placed: DataFrame, wanted: frozenset[int | None] | None = None) -> DataFrame:
    """doc_id, start, ids of the documents in chunks with their first_id; of the ``wanted`` ones only, if given."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                first, doc_ids, lengths, planes = (c[r].as_py() for c in batch.columns)
                ids = unpack(planes)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                picked = np.array([i for i, d in enumerate(doc_ids) if wanted is None or d in wanted], dtype=np.int64)
                for at in range(0, len(picked), 2000):
                    part = picked[at : at + 2000]
                    data = [ids[b:e].tobytes() for b, e in zip(begins[part], ends[part])]
                    own = pa.array([doc_ids[i] for i in part], pa.int64())
                    yield pa.RecordBatch.from_arrays([own, pa.array(first + begins[part]), pa.array(data, pa.binary())], names=["doc_id", "start", "ids"])

    return placed.select("first_id", "doc_ids", "lengths", "planes").mapInArrow(of, "doc_id long, start long, ids binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (binary) of each document in the files; no shuffle of the chunks."""
    # where each shard begins, from the index: one row a shard, so its size is bounded by the number of write partitions
    begins = spark.read.parquet(f"{path}/index").where("chunk = 0").select("shard", F.col("first_id").alias("before"))
    chunks = spark.read.parquet(f"{path}/chunks").join(F.broadcast(begins), "shard")
    return _documents(chunks.withColumn("first_id", F.col("before") + F.col("shard_start")))


def wanted_chunks(spark: SparkSession, path: str, doc_ids: Iterable[int | None]) -> DataFrame:
    """shard, chunk and first_id of the chunks whose bounds hold some of ``doc_ids``."""
    ids = sorted({d for d in doc_ids if d is not None})
    index = spark.read.parquet(f"{path}/index")
    inside = F.exists(F.lit(ids).cast("array<bigint>"), lambda d: (d >= F.col("least_doc_id")) & (d <= F.col("greatest_doc_id")))
    return index.where(inside | (F.lit(None in doc_ids) & F.col("has_null"))).select("shard", "chunk", "first_id")


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int | None]) -> DataFrame:
    """doc_id, start, ids of the documents of a short list of doc_ids (None: those without); other chunks are not opened.

    The chunks' places, a few for each id, go into the scan's filter, so Parquet skips the rest by its statistics.
    """
    wanted = frozenset(doc_ids)
    places = wanted_chunks(spark, path, wanted).collect()
    near = F.col("shard").isin(sorted({p["shard"] for p in places})) & F.col("chunk").isin(sorted({p["chunk"] for p in places}))
    first = spark.createDataFrame([tuple(p) for p in places], "shard int, chunk int, first_id long")
    return _documents(spark.read.parquet(f"{path}/chunks").where(near).join(F.broadcast(first), ["shard", "chunk"]), wanted)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from files of all documents; the files are removed once those are settled."""
    path = new_folder(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path)
    found = settle(read(spark, path).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    remove(spark, path)
    return found
