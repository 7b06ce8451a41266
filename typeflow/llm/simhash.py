"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions carries a non-zero vector of GF(2)^(r+1); table ``a`` keeps the
bits whose vector has an odd product with ``a``.  For any r positions some non-zero ``a`` is
orthogonal to their vectors, so a pair of fingerprints that differ in at most r bits agrees on
all bits of some table: none is missed, whatever the data.

Fingerprints alone in their bucket in every table have no partner.  In a bucket with more, all
differences lie in the bits that the table drops, so each fingerprint probes its own value and
those one dropped bit away: two fingerprints within two bits meet at a common probe, and all
that meet at a probe are within two bits of each other.  A probe holds at most one fingerprint
more than there are dropped bits, so links grow with the fingerprints, not with pairs.

That takes few probes for RADIUS 2 only.  ``wide_components`` serves larger radii, for copies with more
edits.  So wide a radius would link strangers in a very large corpus, so a second, independent SimHash of
the same shingles must confirm each link: two fingerprints are linked if some text of the one and some text of the other are
within SECOND_RADIUS bits there.  Texts of one fingerprint are linked as they are.  ``both_ways`` does the same with the two
SimHashes in each other's place, and joins what either links: a pair whose edits hit one of them harder is found by the other.  In every bucket each fingerprint is linked to the bucket's least one and to the one before it, if
they are within the radius.  A bucket that then still holds several components is cut once more: of
radius + 1 blocks of the bits, two fingerprints within the radius agree on one at least.  The parts, which
agree on a bucket's kept bits and a block's, are searched for links between their components, so no link
is missed.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links like any
other; equal texts share a fingerprint and so a component; a null doc_id belongs to its
component but never names it while another id does; a very long text is hashed whole, in blocks of
bounded memory; repeated rows stay; an empty table gives no rows; columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import free_name, hot_join, if_small, settle, table, trimmed
from .components import connected_components

RADIUS = 2
#: Differing bits that still link two documents where one of each group is to stay (127 tables).
WIDE_RADIUS = 6
#: Differing bits of the second fingerprints that such a link may have.  Unrelated fingerprints are within 6 bits with
#: a chance of 4.5e-12 a pair, which is too many among 10^10 documents; within 16 bits of the second one with 5e-5.
SECOND_RADIUS = 16
SHINGLE_WORDS = 3
SEED = 42
BITS = 64


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # very long texts in bounded memory
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number."""
    return _majority(_hashes(text))


def second_fingerprint(text: str | None) -> int:
    """Another SimHash of the same shingles, whose bits are independent of the first one's."""
    return _majority(_remixed(_hashes(text)))


def _remixed(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).astype("<u8")


def fingerprints(docs: DataFrame, second: bool = False) -> DataFrame:
    """doc_id, the text's hash (print) and fingerprint (fp), and the ``second`` one (fp2), signed bigints, a row for each row of ``docs``."""
    names = ["doc_id", "print", "fp", *(["fp2"] if second else [])]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((batch.num_rows, len(names) - 2), dtype="<u8")
            for i, text in enumerate(batch.column(1)):
                hashes = _hashes(text.as_py())
                values[i] = [_majority(hashes), *([_majority(_remixed(hashes))] if second else [])]
            columns = [pa.array(np.ascontiguousarray(column).view("<i8")) for column in values.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))
    return rows.mapInArrow(trimmed(of), ", ".join(f"{name} long" for name in names))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks of kept bits, as signed 64-bit numbers.

    With fewer vectors than bits all are dealt in turn.  With more, those with the highest bit set are,
    one for each bit, so every mask but the full one keeps half of the bits.
    """
    tables = (2 << radius) - 1
    vectors = [1 + i % tables if tables < BITS else (1 << radius) | i % (1 << radius) for i in range(BITS)]
    masks = [sum(1 << i for i, v in enumerate(vectors) if (a & v).bit_count() % 2) for a in range(1, 2 << radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def block_masks(radius: int) -> list[int]:
    """radius + 1 masks that part the bits, as signed 64-bit numbers: a pair within the radius agrees on all bits of one."""
    masks = [sum(1 << i for i in range(k, BITS, radius + 1)) for k in range(radius + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << BITS) if bit == BITS - 1 else 1 << bit


def _probes(mask: int) -> Column:
    dropped = [_signed(i) for i in range(BITS) if not (mask >> i) & 1]
    return F.transform(F.array(*[F.lit(b).cast("long") for b in (0, *dropped)]), lambda b: F.col("fp").bitwiseXOR(b))


def links(values: DataFrame) -> DataFrame:
    """(u, v) edges that connect the distinct fingerprints ``values`` (fp) just as all pairs within RADIUS do."""
    masks = covering_masks()
    keyed = _keyed(values, masks)
    crowded = keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "key")
    inside = keyed.join(crowded, ["t", "key"], "left_semi")
    by_table = F.coalesce(*[F.when(F.col("t") == t, _probes(m)) for t, m in enumerate(masks)])
    probes = inside.select("fp", "t", F.explode(by_table).alias("probe"))
    met = probes.groupBy("t", "probe").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v").distinct()


def _keyed(values: DataFrame, masks: list[int], *columns: str) -> DataFrame:
    """t, key and the ``columns`` of each fingerprint fp, under its kept bits in every table."""
    exploded = values.select("fp", *columns, F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("t", "mask"))
    return exploded.select(*(columns or ["fp"]), "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _mixed(rooted: DataFrame, *bucket: str) -> DataFrame:
    """The rows of buckets that hold several roots."""
    whole = Window.partitionBy(*bucket)
    marked = rooted.withColumns({"__a": F.min("root").over(whole), "__b": F.max("root").over(whole)})
    return marked.where("__a <> __b").drop("__a", "__b")


def wide_components(values: DataFrame, radius: int) -> DataFrame:
    """(u, root) of the fingerprints fp of ``values`` (distinct fp, fp2), as linked by all pairs within ``radius`` and SECOND_RADIUS bits."""
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    near = lambda a, b: (apart(f"{a}.fp", f"{b}.fp") <= radius) & (apart(f"{a}.fp2", f"{b}.fp2") <= SECOND_RADIUS)
    bucket = Window.partitionBy("t", "key").orderBy("own")
    placed = _keyed(values.select("fp", F.struct("fp", "fp2").alias("own")), covering_masks(radius), "own").select(
        "t", "key", "own", F.first("own").over(bucket).alias("least"), F.lag("own").over(bucket).alias("prev"), F.lead("own").over(bucket).alias("next")
    )
    crowded = settle(placed.where(F.col("prev").isNotNull() | F.col("next").isNotNull()).select("t", "key", "own", "least", "prev"))
    after = crowded.where(F.col("prev").isNotNull())
    edge = lambda to: after.where(near("own", to)).select(F.col("own.fp").alias("u"), F.col(f"{to}.fp").alias("v"))
    roots = connected_components(edge("least").unionByName(edge("prev")))

    # a bucket of one component needs no more links; the others are cut finer and searched for links between components
    rooted = crowded.select("t", "key", "own").join(roots, F.col("own.fp") == F.col("u"), "left").select("t", "key", "own", F.coalesce("root", "own.fp").alias("root"))
    rooted = _mixed(settle(rooted), "t", "key")
    finer = F.array(*[F.lit(m).cast("long") for m in block_masks(radius)])
    cut = rooted.select("t", "key", "own", "root", F.posexplode(finer).alias("s", "mask"))
    part = F.xxhash64("t", "key", "s", F.col("own.fp").bitwiseAND(F.col("mask"))).alias("part")
    parts = settle(_mixed(cut.select(part, "own", "root"), "part"))
    other = parts.select("part", F.col("own").alias("other"), F.col("root").alias("v"))
    more = parts.withColumnRenamed("root", "u").join(other, "part").where((F.col("u") > F.col("v")) & near("own", "other"))
    joined = connected_components(more.select("u", "v"))
    # roots that were joined pass their new root on
    again = joined.select(F.col("u").alias("root"), F.col("root").alias("higher"))
    members = roots.unionByName(joined.select("u", F.col("u").alias("root")).join(roots.select("u"), "u", "left_anti"))
    return settle(members.join(again, "root", "left").select("u", F.coalesce("higher", "root").alias("root")).where("u <> root"))


def both_ways(values: DataFrame, radius: int) -> DataFrame:
    """(u, root) of the fingerprints fp of ``values`` (distinct fp, fp2), as linked by ``wide_components`` over fp, or over fp2."""
    first = wide_components(values, radius).select(F.col("u").alias("fp"), F.col("root").alias("r1"))
    second = wide_components(values.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2")), radius).select(F.col("u").alias("fp2"), F.col("root").alias("r2"))
    placed = values.join(first, "fp", "left").join(second, "fp2", "left")
    placed = settle(placed.select("fp", F.coalesce("r1", "fp").alias("r1"), F.coalesce("r2", "fp2").alias("r2")))
    least = placed.groupBy("r2").agg(F.min("r1").alias("v"), F.max("r1").alias("most")).where("v <> most").select("r2", "v")
    edges = placed.join(if_small(settle(least)), "r2").where("r1 <> v").select(F.col("r1").alias("u"), "v").distinct()
    joined = connected_components(edges).select(F.col("u").alias("r1"), "root")
    roots = placed.select("fp", "r1").distinct().join(if_small(settle(joined)), "r1", "left")
    return settle(roots.select(F.col("fp").alias("u"), F.coalesce("root", "r1").alias("root")).where("u <> root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, print, fp, root (a component's least fp), component_id (the least doc_id reachable) for each row of ``docs``."""
    wide = radius != RADIUS
    prints = settle(fingerprints(docs, second=wide))
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    if wide:
        values = settle(values)
        roots = both_ways(settle(prints.select("fp", "fp2").distinct()), radius)
    else:
        roots = connected_components(links(values.select("fp")))
    rooted = settle(values.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.join(ids, "root").select("fp", "root", "component_id", "n"))
    return hot_join(prints, named, "fp").select("doc_id", "print", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """One document of each component of ``docs``, with its columns: the one whose doc_id names it.

    Rows are told apart by doc_id and text.  Where several of a component have its least doc_id, or
    all have none, the one with the least hash of its text stays; of equal rows one stays.  Texts are
    read again only to leave out the other rows.
    """
    found = settle(near_duplicates(docs, radius).groupBy("root", "doc_id", "print").agg(F.count("*").alias("copies")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")).alias("leader")
    leaders = found.groupBy("root").agg(least, F.count("*").alias("n"), F.max("copies").alias("most")).where("n > 1 OR most > 1").drop("most")
    leads = F.col("doc_id").eqNullSafe(F.col("leader.doc_id")) & (F.col("print") == F.col("leader.print"))
    name = free_name(docs, "__row")
    row = F.struct("doc_id", "print").alias(name)
    # what leaves: rows that don't lead, and leading rows that occur more than once, of which one comes back
    marked = hot_join(found, settle(leaders), "root").where(~leads | (F.col("copies") > 1)).select(row, leads.alias("leads"))
    gone = settle(marked)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{name}.doc_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col(f"{name}.print"))
    once = docs.join(if_small(gone.select(name)), same, "left_anti")
    again = docs.join(if_small(settle(gone.where("leads").select(name))), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
