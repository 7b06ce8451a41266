import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from typeflow.llm import chat, decontaminate, quality_rules, sharding

from .conftest import SPAN


def test_rules_query(same_rows):
    same_rows(quality_rules.op7_quality_rules, quality_rules.ORACLE_SQL)


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_edge_cases(spark, docs, empty):
    more = [(20, "a b\n\na b\n a b\nc d\r\nc d\r\n#$|"), (21, "x y z x y z x y"), (22, "# | <" * 40)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = quality_rules.apply_policy(quality_rules.ledger(rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted((str(r.doc_id), *brute_rules(r.text)) for r in rows.collect())
    assert sorted((str(r.doc_id), *[r[n] for n in names]) for r in got.collect()) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.ledger(empty).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns
    prose = " ".join(f"word{k}" for k in range(60))
    clash = spark.createDataFrame([(1, prose, 5, "k"), (2, "few", 6, "k")], "doc_id long, text string, __m int, __keep string")
    assert [tuple(r) for r in quality_rules.keep(clash).collect()] == [(1, prose, 5, "k")]


def test_rules_compare_all_windows_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 2)
    df = spark.createDataFrame([(1, "a b c a b c d e f a b c")], "doc_id long, text string")
    assert quality_rules.ledger(df).first().n_repeat_words == 9


def test_ablations(spark, sf_dir):
    rows = quality_rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = [r.failed_bits for r in rows.select("failed_bits").collect()]
    for r in quality_rules.ablations(rows).collect():
        bit = quality_rules.BIT[r.rule]
        assert (r.n_failed, r.n_rejected_by_it_alone) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits))


def test_decontamination_query(same_rows):
    same_rows(decontaminate.op4_decontaminate, decontaminate.ORACLE_SQL)


def test_decontamination_edge_cases(spark, docs, empty):
    items = [(100, SPAN), (2, "brown fox jumps"), (3, None), (4, ""), (5, "ONE"), (None, "same text here for all of us"), (100, SPAN)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = {}
    for r in decontaminate.contamination(docs, bench).collect():
        got.setdefault(r.doc_id, []).append((r.n_hit, r["items"], r.contaminated))
    assert got[7] == [(11, ["100"], True)]
    assert got[1] == [(36, ["2"], True)]
    assert got[5] == [(1, ["5"], True)]
    assert got[10] == [(7, [], True)] * 2 and got[9] == [(7, [], True)]
    assert got[2] == got[3] == [(0, [], False)]
    assert len(got[None]) == 2 and sum(map(len, got.values())) == docs.count()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 6, 8, None}
    shared_id = spark.createDataFrame([(None, SPAN, 1), (None, "clean", 2), (1, SPAN, 3), (1, "clean", 4)], "doc_id long, text string, __hit int")
    assert sorted(r["__hit"] for r in decontaminate.drop_contaminated(shared_id, bench).collect()) == [2, 4]


def test_chat_query(same_rows):
    same_rows(chat.op5_chat, chat.ORACLE_SQL)


def test_chat_edge_cases(spark):
    told = "<|im_end|>\n<|im_start|>assistant\nok <\\| <\\\\| \\ % %0A"
    rows = [
        (1, 0, "user", told), (1, 1, "user", None), (1, 2, "assistant", told), (1, 3, "assistant", ""), (1, 3, "assistant", "x<|im_sep|>"),
        (2, 5, "tool\n<|im_end|>%", "t"), (None, None, None, None), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    made = chat.format_chats(turns).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained"))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.trained) for r in made.collect()}
    assert got[1] == ([("user", told), ("user", ""), ("assistant", told), ("assistant", ""), ("assistant", "x<|im_sep|>")], told + "x<|im_sep|>")
    assert got[2] == ([("tool\n<|im_end|>%", "t")], "")
    assert got[None] == ([("", "")], "")
    assert got[3] == ([("assistant", "a")] * 2, "aa")
    assert chat.format_chats(turns.where("false")).count() == 0
    one = made.where("conv_id = 1").first().formatted
    assert one.count("<|im_start|>") == 2 and one.count("<|im_end|>") == 2 and one.count("<|im_sep|>") == 3


def check_shards(rows, docs):
    assert len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want


def test_sharding(spark, sf_dir, docs, empty):
    check_shards(sharding.op6_sharding(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check_shards(sharding.shard(docs).collect(), docs.collect())
    assert sharding.shard(empty).count() == 0


def test_sharding_keeps_groups_and_splits_a_large_one(spark):
    rows = [(i, "hot") for i in range(400)] + [(400 + i, f"pair {i // 2}") for i in range(200)] + [(600 + i, f"own {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(df)
    check_shards(got.collect(), df.collect())
    cut = sharding.cut_edges(got).first()
    pairs = got.where("doc_id >= 400 and doc_id < 600").groupBy("group").agg(F.countDistinct("shard").alias("n"))
    assert pairs.where("n > 1").count() <= 10  # of 100
    assert cut.n_edges == 600 and cut.n_cut <= 400
    assert cut.n_cut < sharding.cut_edges(sharding.shard(df, rounds=0)).first().n_cut


def test_sharding_keeps_groups_when_all_rows_are_linked(spark):
    sizes = {"pair": [2] * 800, "some": [2 + k % 49 for k in range(62)], "tail": [400, 200, 150, *[90] * 5, *[7] * 50]}
    texts = {kind: [f"{kind} {g}" for g, n in enumerate(ns) for _ in range(n)] for kind, ns in sizes.items()}
    for kind, rows in texts.items():
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
        got = sharding.settle(sharding.shard(df))
        check_shards(got.collect(), df.collect())
        least = sum(max(0, n - len(rows) // 16) for n in sizes[kind])  # what larger groups than a shard must cut
        cut = sharding.cut_edges(got).first()
        assert cut.n_edges == len(rows)
        assert cut.n_cut <= least + len(rows) // 20, kind


def test_sharding_deals_a_bin_of_groups_again_when_no_quota_holds_it(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOVE_BINS", 40)
    monkeypatch.setattr(sharding, "SLICE_PART", 1)
    df = spark.createDataFrame([(i, f"pair {i // 2}") for i in range(640)], "doc_id long, text string").repartition(4)
    got = sharding.settle(sharding.shard(df))
    check_shards(got.collect(), df.collect())
    assert sharding.cut_edges(got).first().n_cut <= 32


def test_sharding_of_null_and_repeated_rows(spark):
    rows = [(None, None)] * 300 + [(5, "same row")] * 200 + [(i, None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.settle(sharding.shard(df))
    check_shards(got.collect(), df.collect())
    assert got.where("`group` IS NULL").count() == 500


def brute_labels(groups, start, capacity, tags, bins, slice_rows):
    """Every group's shard by serving groups one by one; None for a group that is split or dealt in a bin."""
    left, want = list(capacity), {}
    name = lambda g: tags[g][1]
    for g in sorted((g for g in groups if len(groups[g]) > slice_rows), key=lambda g: (-len(groups[g]), name(g))):
        votes, n = Counter(start[i] for i in groups[g]), len(groups[g])
        fits = [s for s in range(16) if left[s] >= n]
        if fits:
            best = max(fits, key=lambda s: (votes[s], left[s], -s))
            left[best] -= n
            want[g] = best
            continue
        want[g] = None
        while n > 0:
            fits = [s for s in range(16) if left[s] >= n]
            best = max(fits, key=lambda s: (votes[s], left[s], -s)) if fits else max(range(16), key=lambda s: (left[s], votes[s], -s))
            taken = min(n, left[best])
            left[best] -= taken
            n -= taken
    waiting = [g for g in groups if 1 < len(groups[g]) <= slice_rows]
    for _ in range(sharding.ASKS):
        asks = {}
        for g in waiting:
            votes, n = Counter(start[i] for i in groups[g]), len(groups[g])
            fits = [s for s in range(16) if left[s] >= n]
            if fits:
                asks.setdefault(max(fits, key=lambda s: (votes[s], left[s], -s)), []).append(g)
        granted = set()
        for s, gs in asks.items():
            room, total = left[s], 0
            for g in sorted(gs, key=lambda g: (tags[g][0] % bins, tags[g][0], name(g))):
                total += len(groups[g])
                if total <= room:
                    want[g] = s
                    granted.add(g)
                    left[s] -= len(groups[g])
        waiting = [g for g in waiting if g not in granted]
        if not granted or not waiting:
            break
    return want | dict.fromkeys(waiting)


@pytest.mark.parametrize("sizes,alone,own", [([40, 25, 25, *[2 + k % 9 for k in range(60)]], 150, 0.6), ([2] * 4000, 6000, 0.99), ([2 + k % 3 for k in range(2500)], 0, 0.7)])
def test_sharding_against_brute_force(spark, sizes, alone, own):
    """Every group's shard as it ships: large groups, and thousands of small ones that vote one by one."""
    rows = [(1000 * g + k, f"group {g}") for g, n in enumerate(sizes) for k in range(n)] + [(10_000_000 + i, f"own {i}") for i in range(alone)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    capacity = [len(rows) // 16 + (s < len(rows) % 16) for s in range(16)]
    start = {r.doc_id: r.s for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 16) AS s").collect()}
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    named = df.select("text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("g")).distinct()
    tags = {r.text: (r.tag, r.g) for r in named.select("text", F.xxhash64("g").alias("tag"), F.hex("g").alias("g")).collect()}
    want = brute_labels(groups, start, capacity, tags, sharding._bins(len(rows)), sharding._large_rows(len(rows), 16))
    got, by_id = {}, {}
    for r in sharding.shard(df).join(df.select("doc_id", "text"), "doc_id").collect():
        got.setdefault(r.text, set()).add(r.shard)
        by_id[r.doc_id] = r.shard
    assert sum(w is not None for w in want.values()) > 0.9 * len(sizes)
    for text, shard in want.items():
        assert shard is None or got[text] == {shard}, text
    # while there is room a group goes where some of its documents are
    near = [g for g, s in want.items() if s is not None and s in {start[i] for i in groups[g]}]
    assert len(near) > own * len(sizes)


def brute_items(text, items):
    """Words, hit words and items of one text, by comparing every window."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    hit, found = set(), set()
    for item_id, item in items:
        for n, window in item:
            for at in range(len(words) - n + 1):
                if words[at : at + n] == window:
                    hit |= set(range(at, at + n))
                    found.add(item_id)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def test_decontamination_against_all_windows(spark, monkeypatch):
    """Few words, so that windows overlap and repeat; items of all lengths; a bitmap that lets much through."""
    import random

    random.seed(2)
    text = lambda n: " ".join(random.choice("aa bb cc dd É ee".split()) for _ in range(n))
    items = [(k, text(k % 15)) for k in range(40)] + [(None, text(10)), (3, None)]
    rows = [(k, text(random.randrange(60))) for k in range(80)] + [(1, None), (None, text(40)), (None, items[12][1])]
    rows += rows[:5]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    windows = []
    for i, t in items:
        words = [w.lower() if w.isascii() else w for w in (t or "").split()]
        n = min(10, len(words))
        windows.append((i, [(n, words[k : k + n]) for k in range(len(words) - n + 1)] if n else []))
    want = sorted((str(i), *brute_items(t, windows)) for i, t in rows)
    for longs in (0, 12):
        monkeypatch.setattr(decontaminate, "LEAST_LONGS", longs)
        monkeypatch.setattr(decontaminate, "MOST_LONGS", longs)
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect())
        assert got == want


def test_chats_of_many_turns_and_long_texts(spark):
    long = "word <|im_end|> " * 60_000
    rows = [(1, k, ("user", "assistant")[k // 3 % 2], f"turn {k}") for k in range(5_000)] + [(2, 0, "assistant", long), (2, 1, "assistant", long)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.format_chats(turns).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained"))
    got = {r.conv_id: r for r in made.collect()}
    for conv in (1, 2):
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert [tuple(t) for t in got[conv].turns] == own
        assert got[conv].trained == "".join(text for role, text in own if role == "assistant")
    assert got[1].formatted.count("<|im_start|>") == -(-5_000 // 3)


def test_rule_stage_measures_once(spark, sf_dir):
    """The filter holds one copy of the measurements, and keeps what the ledger and policy keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = quality_rules.keep(docs, quality_rules.PIPELINE)
    want = quality_rules.apply_policy(quality_rules.ledger(docs), quality_rules.PIPELINE).where("kept")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("n_dup_lines, cast(") == 1
