"""A trie of conversation prefixes from vertical bitmaps.

Conversations are dealt into shards of ``SHARD`` neighbouring ids, of which a base conversation and those that
begin with it share one.  A shard's turns come sorted by position; per position the index holds, for each turn
(by a digest of role and text), the bitset of the conversations that have it there.  From the root, depth
first, a node's bitset intersected with the postings of the next position gives its children: the counts of set bits are
their conversations, the bits that no posting takes are the conversations that end.  ``LEVELS`` positions
are indexed at a time, and nodes that reach below them wait for the next ones, so a task holds at
most ``LEVELS`` turns of each of a shard's conversations, whatever their length.

A node's key is a digest of its path, so equal prefixes of several shards meet in one aggregate.  What is summed
over subtrees must count each node once: a node belongs to the shard that holds its smallest
member, which holds all its ancestors too.  Its share is added up inside that shard from the
deepest level upwards, and the shards' sums meet in a second aggregate.  Ended ids pass to their digest in order of
shards, as a stream: a digest of many ids is sequential, but no task holds them.

Defined cases: a null role or text is empty; null turn numbers come first; turns of equal number are in the
order of role, then text; repeated rows are turns of their own; rows without a conv_id take no
part; an empty table has no nodes; other columns are ignored; texts are digested whole.  All turns of one
conversation pass through one task, in turn.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_join, settle, table, trim

#: Conversation ids of a shard; a multiple of BASE.
SHARD = 1_000
#: Conversations begin with turns of the one whose id ends their block of so many ids.
BASE = 100
#: One more than the most turns that are taken from a base conversation.
SHARED = 6
#: Positions that are indexed together.
LEVELS = 64
#: Nodes of a batch that a task gives back.
BATCH = 10_000

ROOT = bytes(16)
NODES = "shard long, key binary, parent binary, depth long, n long, conv_id long, chars long, ends string"
SHARES = "key binary, weighed long, owned long, leaves long"

Turn = tuple[bytes, int]  # digest and code points


def _arrow(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _batched(rows: Iterator[tuple], fields: str) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, BATCH)):
        yield _arrow(held, fields)
    trim()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def base_of(conv: int) -> int:
    """conv - conv % BASE, the remainder having the sign of ``conv``."""
    rest = abs(conv) % BASE
    return conv - rest if conv >= 0 else conv + rest


def shared_turns(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % SHARED


def rebuilt(levels: Iterator[tuple[int, list[tuple[int, Turn]]]]) -> Iterator[tuple[list[int], list[tuple[int, Turn]]]]:
    """The rebuilt conversations of a shard, position by position, from its original ones.

    ``levels`` are (position from 1, its turns); yields (all ids in order, the next position's turns), first an empty
    position.  A turn moves up by less than SHARED places, so no more positions are held.
    """
    head = list(islice(levels, SHARED - 1))
    ids = sorted(conv for conv, _ in head[0][1]) if head else []
    bases: dict[int, list[Turn]] = defaultdict(list)
    for _, turns in head:
        for conv, turn in turns:
            if base_of(conv) == conv:
                bases[conv].append(turn)
    yield ids, []
    taken, moved, waiting = {}, {}, defaultdict(list)
    for conv in ids:
        taken[conv] = shared_turns(conv)
        first = bases.get(base_of(conv), [])[: taken[conv]]
        moved[conv] = taken[conv] - len(first)
        for at, turn in enumerate(first, 1):
            waiting[at].append((conv, turn))
    last = 0
    for source in (head, levels):
        for last, turns in source:
            for conv, turn in turns:
                if last > taken[conv]:
                    waiting[last - moved[conv]].append((conv, turn))
            if last >= SHARED:
                yield ids, waiting.pop(last - SHARED + 1, [])
    for at in range(max(last - SHARED + 2, 1), last + SHARED):
        yield ids, waiting.pop(at, [])


def shard_trie(shard: int, positions: Iterator[tuple[list[int], list[tuple[int, Turn]]]]) -> Iterator[tuple]:
    """A shard's nodes as rows of NODES, from its conversations' turns position by position."""
    ids, _ = next(positions)
    place = {conv: i for i, conv in enumerate(ids)}
    named = lambda bits: ",".join(str(ids[i]) for i in _places(bits))
    waiting = [(ROOT, None, 0, (1 << len(ids)) - 1, 0)]  # key, parent, depth, bits, chars
    depth = 0
    while waiting:
        # vertical bitmaps: for each of the next positions, turn -> bits; and the turn of each conversation
        postings, turn_of = [], []
        for _, turns in islice(positions, LEVELS):
            bits: dict[bytes, int] = defaultdict(int)
            for conv, (digest, _) in turns:
                bits[digest] |= 1 << place[conv]
            postings.append(bits)
            turn_of.append({place[conv]: turn for conv, turn in turns})
        ended = len(postings) < LEVELS
        present = [_union(p.values()) for p in postings]
        stack, waiting = waiting, []
        while stack:
            node = stack.pop()
            key, parent, at, members, chars = node
            below = at - depth
            if below == len(postings) and not ended:
                waiting.append(node)
                continue
            rest = members & present[below] if below < len(postings) else 0
            yield shard, key, parent, at, members.bit_count(), ids[_lowest(members)], chars, named(members & ~rest)
            while rest:
                digest, size = turn_of[below][_lowest(rest)]
                child = rest & postings[below][digest]
                stack.append((hashlib.blake2b(key + digest, digest_size=16).digest(), key, at + 1, child, size))
                rest &= ~child
        depth += LEVELS


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _places(bits: int) -> Iterator[int]:
    while bits:
        yield _lowest(bits)
        bits &= bits - 1


def _union(bitsets: Iterable[int]) -> int:
    out = 0
    for b in bitsets:
        out |= b
    return out


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, position, conv_id, digest, chars) in that order, to NODES."""

    def nodes() -> Iterator[tuple]:
        for shard, rows in groupby(_rows(batches), lambda r: r[0]):
            levels = ((at, [(conv, (digest, chars)) for _, _, conv, digest, chars in turns]) for at, turns in groupby(rows, lambda r: r[1]))
            yield from shard_trie(shard, rebuilt(levels))

    return _batched(nodes(), NODES)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, depth, key, parent, weighed, owned, leaves), each shard's deepest first, to SHARES summed over subtrees."""

    def summed() -> Iterator[tuple]:
        for _, rows in groupby(_rows(batches), lambda r: r[0]):
            above: dict[bytes, list[int]] = {}
            for _, level in groupby(rows, lambda r: r[1]):
                below, above = above, {}
                for _, _, key, parent, *own in level:
                    total = [a + b for a, b in zip(own, below.pop(key, (0, 0, 0)))]
                    yield key, *total
                    if parent is not None:
                        above[parent] = [a + b for a, b in zip(total, above.get(parent, (0, 0, 0)))]

    return _batched(summed(), SHARES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, shard, ends) in that order, to (key, ends_sha256)."""

    def digests() -> Iterator[tuple]:
        for key, rows in groupby(_rows(batches), lambda r: r[0]):
            sha = hashlib.sha256()
            for n, (_, _, ends) in enumerate(rows):
                sha.update((("," if n else "") + ends).encode())
            yield key, sha.hexdigest()

    return _batched(digests(), "key binary, ends_sha256 string")


def shard_of(conv: Column) -> Column:
    """Shards in the order of ids; a base conversation is in the shard of those that begin with it."""
    return F.floor((conv - conv % BASE) / F.lit(SHARD)).cast("long")


def local_tries(turns: DataFrame) -> DataFrame:
    """The nodes of every shard, NODES; the turns are shuffled once, by their shard."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(shard_of(F.col("conv_id")).alias("shard"), "conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("shard", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)), 1, 16)
    placed = rows.repartition("shard").select("shard", F.row_number().over(order).alias("at"), "conv_id", digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    return placed.sortWithinPartitions("shard", "at", "conv_id").mapInArrow(_tries, NODES)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and the prefix's key.
    """
    local = settle(local_tries(turns))
    first = lambda c: F.any_value(c).alias(c)
    nodes = local.groupBy("key").agg(first("parent"), first("depth"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = settle(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    owner = nodes.select("key", F.col("conv_id").alias("least"), "n_children")
    owns = F.col("conv_id") == F.col("least")
    own = local.drop("ends").join(owner, "key").select(
        "shard", "depth", "key", "parent", (F.col("n") * F.col("chars")).alias("weighed"),
        F.when(owns, F.col("chars")).otherwise(0).alias("owned"), F.when(owns & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves"),
    )
    shares = own.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "key").mapInArrow(_shares, SHARES)
    totals = shares.groupBy("key").agg((F.sum("weighed") - F.sum("owned")).alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = local.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_digests, "key binary, ends_sha256 string")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = nodes.join(totals, "key").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))

    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    whole = settle(whole)
    linked = hot_join(whole.where("parent IS NOT NULL"), parents, "parent")
    root = whole.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key"]
    return linked.select(*names).unionByName(root.select(*names))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).drop("key")


# crc32 of the decimal id, from its characters: bits are shifted out one by one
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""

ORACLE_SQL = f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM s),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, conv_id - conv_id % {BASE} AS base, {_CRC} % {SHARED} AS h FROM c),
r AS (
  SELECT h.conv_id, t.p AS q, role, text FROM h JOIN t ON t.conv_id = h.base AND t.p <= h.h
  UNION ALL
  SELECT t.conv_id, t.p - h.h + least(h.h, coalesce(c.n, 0)), role, text FROM t JOIN h ON t.conv_id = h.conv_id LEFT JOIN c ON c.conv_id = h.base WHERE t.p > h.h),
d AS (SELECT conv_id, q AS depth, length(text) AS chars, string_agg(sha256(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY q) AS path FROM r),
k AS (SELECT conv_id, depth, chars, sha256(path) AS key FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM k),
n AS (
  SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM l GROUP BY key),
w AS (SELECT n.*, coalesce(m.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent) m USING (key)),
u AS (
  SELECT a.key, sum((w.n_convs - 1) * w.chars)::BIGINT AS saved_tokens, (count(*) FILTER (w.n_children = 0))::BIGINT AS n_leaves
  FROM w JOIN k a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.key)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, u.n_leaves, u.saved_tokens, w.ends_sha256
FROM w JOIN u USING (key) LEFT JOIN w p ON w.parent = p.key
"""
