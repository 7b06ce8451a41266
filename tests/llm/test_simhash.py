import functools
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from typeflow.llm import common, simhash
from typeflow.llm.components import connected_components


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    """(doc_id, fingerprint, component) by comparing all pairs, beyond radius 2 by second fingerprints too."""
    values = sorted({brute_print(t) for _, t in rows})
    seconds = {}
    for _, t in rows:
        seconds.setdefault(brute_print(t), set()).add(simhash.second_fingerprint(t))

    def linked(a, b):
        first = (a ^ b).bit_count()
        if radius == 2:
            return first <= radius
        apart = [(x ^ y).bit_count() for x in seconds[a] for y in seconds[b]]
        return any(first <= radius and d <= simhash.SECOND_RADIUS or d <= radius and first <= simhash.SECOND_RADIUS or d == 0 for d in apart)

    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if linked(a, b):
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        r = find(brute_print(t))
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted((str(i), f"{brute_print(t):016x}", least.get(find(brute_print(t)))) for i, t in rows)


def found(df):
    return sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect())


def test_edge_cases(docs, empty):
    assert found(simhash.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(simhash.near_duplicates(empty)) == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(9) == 1 and 10 not in ids and 3 not in ids and 2 in ids
    assert simhash.keep_one(empty).count() == 0


def test_one_of_each_component_stays_without_unique_ids(spark):
    texts = [" ".join(f"{w}{k}" for k in range(30)) for w in "abcd"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[2])]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, __leader int, n int, root int").checkpoint()
    kept = sorted((str(r.doc_id), r.text, r["__leader"], r.n, r.root) for r in simhash.keep_one(df).collect())
    assert kept == sorted((str(i), t, 1, 2, 3) for i, t in zip((None, None, 7, 7), texts))


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf_dir).collect())
    assert got == brute(rows)


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            difference = 1 << i | 1 << j
            assert any(not m & difference for m in masks)


@pytest.mark.parametrize("radius", [3, 5, 6])
def test_masks_of_larger_radii_cover_and_keep_half_of_the_bits(radius):
    import random

    random.seed(radius)
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(radius)]
    assert len(masks) == (2 << radius) - 1 and min(m.bit_count() for m in masks) >= 28
    blocks = [m & (1 << 64) - 1 for m in simhash.block_masks(radius)]
    assert len(blocks) == radius + 1 and sum(blocks) == (1 << 64) - 1
    for _ in range(3000):
        difference = sum(1 << b for b in random.sample(range(64), radius))
        assert any(not m & difference for m in masks) and any(not m & difference for m in blocks)


def test_links_in_a_crowded_bucket(spark):
    """A chain and a dense cluster are linked as all pairs would link them."""
    import random

    random.seed(5)
    base = random.getrandbits(64)
    values = {base}
    for _ in range(300):
        values.add(random.choice(sorted(values)) ^ 1 << random.randrange(64) ^ 1 << random.randrange(64))
    values |= {random.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    roots = {r.u: r.root for r in connected_components(edges).collect()}
    groups = {}
    for v in signed:
        groups.setdefault(roots.get(v, v), set()).add(v)
    want = {}
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    for v in values:
        want.setdefault(find(v), set()).add(v - (1 << 64) if v >> 63 else v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.root for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.where("false")).count() == 0


@pytest.mark.parametrize("radius", [3, 6])
def test_wide_components_are_those_of_all_pairs(spark, radius):
    """Families of copies, chains, one dense group and strangers."""
    import random

    random.seed(radius)
    flipped = lambda v, n, bits=64: functools.reduce(lambda x, _: x ^ 1 << random.randrange(bits), range(n), v)
    values = {random.getrandbits(64) for _ in range(40)}
    for seed in sorted(values)[:8]:
        family = [seed]
        for _ in range(30):
            family.append(flipped(random.choice(family), random.randrange(1, radius + 4)))
        values |= set(family)
    base = random.getrandbits(64)
    values |= {flipped(base, random.randrange(1, 8), 20) for _ in range(250)}
    common_bits = random.getrandbits(64)
    second = {v: flipped(common_bits, random.choice((2, 9, 14))) for v in values}
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius and (second[a] ^ second[b]).bit_count() <= simhash.SECOND_RADIUS:
                root[find(a)] = find(b)
    want = {}
    for v in values:
        want.setdefault(find(v), set()).add(v)
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in (v, second[v])) for v in values]
    roots = {r.u: r.root for r in simhash.wide_components(spark.createDataFrame(signed, "fp long, fp2 long"), radius).collect()}
    got = {}
    for v, _ in signed:
        got.setdefault(roots.get(v, v), set()).add(v & (1 << 64) - 1)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert simhash.wide_components(spark.createDataFrame([], "fp long, fp2 long"), radius).collect() == []


def test_second_fingerprints_are_independent_of_the_first(sf_dir, spark):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text and len(r.text) > 300]
    apart = [(simhash.fingerprint(t) ^ simhash.second_fingerprint(t)).bit_count() for t in texts]
    assert 30 < sum(apart) / len(apart) < 34
    one, two = texts[0], texts[0].replace(texts[0].split()[20], "edited", 1)
    assert (simhash.second_fingerprint(one) ^ simhash.second_fingerprint(two)).bit_count() <= 16


def test_texts_longer_than_a_block_of_shingles():
    for words in (65_537, 65_538, 65_539, 200_000):
        text = " ".join(f"w{k % 70_000}" for k in range(words))
        assert simhash.fingerprint(text) == brute_print(text)


def test_hot_fingerprints_join_by_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert found(simhash.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.keep_one(docs.checkpoint()).count() == len({c for _, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], simhash.WIDE_RADIUS)})


def test_no_link_is_lost_where_fingerprints_are_equal(spark, monkeypatch):
    """Texts of one fingerprint with several second ones link by each of them."""
    near, far = 0, (1 << 40) - 1
    pairs = [(0, near), (0, far), (7, far), (1 << 50 | 0xFF, near), (1 << 50 | 0xF, near ^ 3)]
    roots = {r.u: r.root for r in simhash.wide_components(spark.createDataFrame(pairs, "fp long, fp2 long"), 6).collect()}
    assert roots[7] == 0 and roots[1 << 50 | 0xFF] == roots.get(1 << 50 | 0xF, 1 << 50 | 0xF) == 0
    # the same through documents
    prints = {f"t{k}": p for k, p in enumerate(pairs[:3])} | {"other": (-1, 0x5555555555555555)}
    rows = [(k, t, 1, *prints[t]) for k, t in enumerate(sorted(prints), 10)]
    made = spark.createDataFrame(rows, "doc_id long, text string, print long, fp long, fp2 long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, second=False: made.select("doc_id", "print", "fp", "fp2"))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(made, 6).collect()}
    assert got == {10: 10, 11: 11, 12: 11, 13: 11}


def test_links_of_either_fingerprint(spark):
    """Components are those of all pairs that either rule links, in chains that need both."""
    import random

    random.seed(3)
    flip = lambda v, n: functools.reduce(lambda x, b: x ^ 1 << b, random.sample(range(60), n), v)
    pairs = {(random.getrandbits(62), random.getrandbits(62)) for _ in range(30)}
    for a, b in sorted(pairs)[:10]:
        for _ in range(12):
            n, m = random.choice([(5, 14), (14, 5), (6, 16), (9, 9), (0, 20), (20, 0), (17, 6), (3, 3)])
            a, b = random.choice([(a, b), (flip(a, n), flip(b, m))])
            pairs.add((a, b))
    near = lambda p, q: [(p[0] ^ q[0]).bit_count(), (p[1] ^ q[1]).bit_count()]
    root = {p: p for p in pairs}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for p in pairs:
        for q in pairs:
            d = near(p, q)
            if 0 in d or min(d) <= 6 and max(d) <= simhash.SECOND_RADIUS:
                root[find(p)] = find(q)
    least = {}
    for p in pairs:
        least[find(p)] = min(least.get(find(p), p[0]), p[0])
    got = {r.u: r.root for r in simhash.both_ways(spark.createDataFrame(sorted(pairs), "fp long, fp2 long"), 6).collect()}
    assert {p[0]: got.get(p[0], p[0]) for p in pairs} == {p[0]: least[find(p)] for p in pairs}
    assert len(got) > 30
