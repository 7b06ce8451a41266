import zlib
from collections import Counter

import corpus_pipeline
from typeflow.llm import simhash

from .test_models import brute_buckets
from .test_native import brute_rules
from .test_simhash import brute
from .test_tokens import brute as brute_tokens

SF = "/root/testdata/sf0.001"


def brute_keep(text):
    """The pipeline's rules in plain Python."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute_rules(text)
    n_lines = len([x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")])
    upper = sum(c.isupper() for c in text or "")
    fails = [
        n_words < 50, 100 * n_repeat > 50 * n_words, word_chars < 2 * n_words, word_chars > 20 * n_words,
        100 * n_symbols > 25 * n_words, 100 * n_dup_lines > 50 * n_lines, 100 * upper > 60 * word_chars,
    ]
    return not any(fails)


def brute_known(rows):
    """The documents whose language a naive Bayes model of the same rows recognises, in plain Python."""
    import math

    taught = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 and lang is not None]
    counts, sizes = {}, Counter(lang for _, lang in taught)
    for t, lang in taught:
        counts.setdefault(lang, Counter()).update(brute_buckets(t))
    totals = {lang: sum(c.values()) + 0.5 * (1 << 15) for lang, c in counts.items()}
    kept = []
    for i, t, _ in rows:
        grams = Counter(brute_buckets(t))
        log = {
            lang: sum(n * math.log((c[b] + 0.5) / totals[lang]) for b, n in grams.items()) / 3 + math.log(sizes[lang] / len(taught))
            for lang, c in counts.items()
        }
        p = [math.exp(x - max(log.values())) for x in log.values()]
        if any(map(str.isalpha, t)) and max(p) / sum(p) >= 0.5:
            kept.append((i, t))
    return kept


def brute_words(text):
    """A text's words: runs of ASCII letters and digits and of characters beyond ASCII."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = "".join(c if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 0x7F else " " for c in folded).split(" ")
    return [p for p in parts if p]


def brute_clean(rows, items):
    """The documents without a window of an item."""
    windows = set()
    for item in map(brute_words, items):
        n = min(10, len(item))
        windows |= {tuple(item[k : k + n]) for k in range(len(item) - n + 1) if n}
    lengths = {len(w) for w in windows}
    clean = []
    for i, t in rows:
        words = brute_words(t)
        if not any(tuple(words[k : k + n]) in windows for n in lengths for k in range(len(words) - n + 1)):
            clean.append((i, t))
    return clean


def test_pipeline_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    known = brute_known([d for d in docs if brute_keep(d[1])])
    texts = dict(known)
    leaders = {c for _, _, c in brute(known, simhash.WIDE_RADIUS)}
    clean = brute_clean([(i, texts[i]) for i in leaders], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert 0 < len(clean) < len(leaders) < len(known) < len(docs)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == brute_tokens(clean)


def test_stages_keep_columns_and_survive_edge_cases(spark, docs, empty):
    for df in (docs.checkpoint(), empty.checkpoint()):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF).columns == docs.columns
            stage(spark, df, SF).collect()
        corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()


def test_a_clean_text_is_never_too_long(spark):
    words = " ".join(f"word{k} goes by {k}." for k in range(260_000))
    df = spark.createDataFrame([(1, words)], "doc_id long, text string")
    assert corpus_pipeline.quality_stage(spark, df, SF).count() == 1
