"""The prefix trie against a trie of nested dictionaries in plain Python, and against DuckDB."""

import hashlib
import random
import zlib

import duckdb
import pytest

from typeflow.llm import prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows (conv_id, turn, role, text) to sorted node tuples."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = abs(c) % 100
        base = own.get(c - rest if c >= 0 else c + rest, [])
        paths[c] = tuple(base[:h] + turns[h:])
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    leaves, saved, children = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            if node not in children:
                leaves[node[:d]] = leaves.get(node[:d], 0) + 1
            saved[node[:d]] = saved.get(node[:d], 0) + (len(convs) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, convs in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children.get(node, 0), leaves[node], saved[node], sha))
    return sorted(out, key=repr)


def made(spark, rows):
    kinds = "conv_id long, turn long, role string, text string, key string, shard int, depth string"
    return spark.createDataFrame([(*r, "x", 1, "d") for r in rows], kinds).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def dialogues(seed, convs, most, texts):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, most)):
            rows.append((c, rng.choice([turn, turn, turn, 0, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nodes_against_plain_python(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "LEVELS", [64, 2, 3][seed])
    monkeypatch.setattr(trie, "SHARD", [1000, 100, 200][seed])
    convs = [*range(0, 60), *range(100, 130), *range(201, 220), *range(990, 1010), *range(-250, -90, 7), 5000, 10**12 + 7]
    rows = dialogues(seed, convs, 9, ["", "a", "ü😀", None, "longer text"])
    rows += [(None, 1, "user", "lost"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    assert found(trie.prefix_trie(made(spark, rows))) == brute(rows)


def test_odd_tables(spark):
    assert found(trie.prefix_trie(made(spark, []))) == []
    assert found(trie.prefix_trie(made(spark, [(None, 0, "user", "x")]))) == []
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(turnless, 0, "user", "gone")]  # its base is absent, and its own turn is among the first h
    got = found(trie.prefix_trie(made(spark, rows)))
    assert got == brute(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    # roles and texts that join to equal strings are different turns
    rows = [(c, 0, r, t) for c, r, t in ((0, "ab", "c"), (100, "a", "bc"), (200, "", "abc"), (300, "1:a", "bc"))]
    rows += [(c, 1 + k, "user", f"t{k}") for c in (0, 100, 200, 300) for k in range(8)]
    assert found(trie.prefix_trie(made(spark, rows))) == brute(rows)


def test_long_and_common_conversations(spark):
    """One conversation with a third of all rows, one text that very many share, a first turn with very many different second ones."""
    rows = [(700, k, "user", f"turn {k % 7}") for k in range(300)]
    rows += [(c, k, "user", ("hello", "hi")[k]) for c in range(2000, 2150) for k in range(2)]
    rows += [(c, k, "user", ("hello", f"reply {c}")[k]) for c in range(4000, 4150) for k in range(2)]
    got = found(trie.prefix_trie(made(spark, rows)))
    assert got == brute(rows)
    assert max(r[1] for r in got) >= 295


def test_a_shard_holds_few_positions(monkeypatch):
    """No more than LEVELS positions are read ahead of the nodes that are given out."""
    monkeypatch.setattr(trie, "LEVELS", 8)
    read = 0

    def levels():
        nonlocal read
        for at in range(1, 2001):
            read = at
            yield at, [(100, (at.to_bytes(16, "big"), 1))]

    depths = []
    for _, _, _, depth, *_ in trie.shard_trie(0, trie.rebuilt(levels())):
        depths.append(depth)
        assert read <= depth + trie.LEVELS + trie.SHARED + 1
    assert depths == list(range(2001))


def test_rows_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    want = sorted(con.sql(trie.ORACLE_SQL).select(", ".join(COLUMNS)).fetchall(), key=repr)
    assert want == brute(rows)
    assert found(trie.op12_prefix_trie(spark, sf_dir)) == want
