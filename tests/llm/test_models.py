import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeflow.llm import language_id, quality_model, toxicity
from typeflow.llm.common import held_out
from typeflow.llm.labelled import hash_bound, in_sample, labelled_sample

SF = "/root/testdata/sf0.01"


def test_held_out_is_a_fifth(spark):
    got = {r.id: r.h for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = language_id.op8_language_id(spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, docs, empty):
    model = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    got = language_id.predict(docs, model)
    assert got.columns == [*docs.columns, "__lang_pred", "__score"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r["__lang_pred"], r["__score"]))
    assert by[2] == by[3] == by[4] == [("und", 0.0)] and by[1][0][0] in model.languages
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["__lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.keep_known(docs).columns == docs.columns
    clash = docs.withColumns({"__lang_pred": F.lit(5), "__SCORE": F.lit(6), "__guess": F.lit(7)})
    kept = language_id.keep_known(clash)
    assert kept.columns == clash.columns and {(r["__lang_pred"], r["__SCORE"], r["__guess"]) for r in kept.collect()} == {(5, 6, 7)}


MASK = (1 << 64) - 1


def brute_buckets(text):
    """The bucket of every 1-, 2- and 3-gram of a text, in plain Python."""
    chars, before = [], False
    for c in text.lower():
        other = ord(c) < 97 or 122 < ord(c) < 170
        if not (other and before):
            chars.append(32 if other else ord(c))
        before = other
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            key = 0
            for k in range(n):
                key = (key * 0x9E3779B97F4A7C15 + chars[i + k] + k + 1) & MASK
            yield ((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9 & MASK) >> 49


def test_ngrams_are_counted_once_wherever_a_run_ends(monkeypatch):
    texts = ["Ein kurzer   Text, der geteilt wird", "", "a", "..!!", "İ ΑΣ x", "x" * 50, " " * 30, "é ??  q" * 9]
    want = Counter((i, b) for i, t in enumerate(texts) for b in brute_buckets(t))
    for step in (*range(1, 30), 10**6):
        monkeypatch.setattr(language_id, "STEP_CHARS", step)
        got = Counter()
        for row, bucket in language_id.ngrams(texts):
            got.update(zip(row.tolist(), bucket.tolist()))
        assert got == want, step


def test_language_against_brute_force(spark, sf_dir):
    """Counts, priors and posteriors of all documents, recomputed in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    taught = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 and d.lang is not None and d.text is not None]
    counts, sizes = {}, Counter(d.lang for d in taught)
    for d in taught:
        counts.setdefault(d.lang, Counter()).update(brute_buckets(d.text))
    logs = {}
    for lang, found in counts.items():
        total = sum(found.values()) + 0.5 * (1 << 15)
        logs[lang] = {b: math.log((found[b] + 0.5) / total) for b in range(1 << 15)}
    got = {r.doc_id: r for r in language_id.op8_language_id(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        if not any(map(str.isalpha, d.text or "")):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
            continue
        grams = Counter(brute_buckets(d.text))
        log = {lang: sum(n * of[b] for b, n in grams.items()) / 3 + math.log(sizes[lang] / len(taught)) for lang, of in logs.items()}
        top = max(log.values())
        odds = sorted(((math.exp(x - top), lang) for lang, x in log.items()), reverse=True)
        p = odds[0][0] / sum(x for x, _ in odds)
        assert got[d.doc_id].lang_pred == odds[0][1] or odds[1][0] > 0.99
        assert got[d.doc_id].score == pytest.approx(p, abs=1e-2)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    docs = spark.range(100).selectExpr("id AS doc_id", "'text' AS text", "concat('l', id % 7) AS lang")
    with pytest.raises(ValueError, match="more than 3"):
        language_id.learn(docs)


def test_samples_are_never_empty_and_bounded(spark):
    for total in (10**9, 10**10, 10**11, 10**12):
        share = (hash_bound(6_000, total) + (1 << 63)) / (1 << 64)
        assert share * total == pytest.approx(6_000, rel=1e-3)
    ids = spark.range(3 * 10**6)
    assert ids.where(in_sample(F.col("id"), 20_000, 10**9)).count() == pytest.approx(60, abs=30)
    assert ids.where(in_sample(F.col("id"), 6_000, 3 * 10**6)).count() == pytest.approx(6_000, rel=0.1)
    assert spark.range(50).where(in_sample(F.col("id"), 50, 50)).count() == 50


def test_sampled_labels_keep_what_is_known_of_each_category(spark):
    rows = [(i, None if i % 2 else 1, i % 3 % 2) for i in range(40)] + [(2, 0, 1), (3, None, None), (None, 1, 1), (41, None, None)]
    got = labelled_sample(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), ["quality", "toxic"], 1000).collect()
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r.doc_id for r in got) == free
    assert {r.doc_id: (r.quality, r.toxic) for r in got} == {i: (None if i % 2 else 1, 1 if i == 2 else i % 3 % 2) for i in free}


def labelled(spark, df):
    return df.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()


def test_toxicity(spark, docs, empty):
    rows = labelled(spark, toxicity.op9_toxicity(spark, SF))
    toxic = [r for r in rows if r.toxic]
    assert len(toxic) >= 5 and sum(r.predicted for r in toxic) / len(toxic) >= 0.6
    assert sum(r.predicted for r in rows if not r.toxic) <= 1
    links = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(links) == 2 and len(links[1].earlier) == 1
    assert toxicity.score(docs, links).count() == docs.count() and toxicity.score(empty, links).count() == 0
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.toxic for r in toxicity.score(docs, none).collect()} == {0.0}
    check_scores(docs, links, toxicity.score(docs, links))


def brute_words(text):
    """The distinct buckets of a text's words and of their beginnings."""
    found = set()
    for word in (text or "").lower().split():
        bare = word.strip(".,;:!?\"'()[]{}<>|*#$%&-_/\\\n") or word[:1]
        found |= {bare, *(f"{n} {bare[:n]}" for n in (4, 5, 6) if len(bare) > n)}
    return {zlib.crc32(f.encode()) % toxicity.BUCKETS for f in found}


def check_scores(docs, links, scored):
    """Each category's probability by plain sums, from the earlier links to the later ones."""
    want = []
    for d in docs.collect():
        logits, found = [], brute_words(d.text)
        for link in links:
            earlier = sum(e * min(6, max(-6, x)) for e, x in zip(link.earlier, logits))
            logits.append(sum(link.weights[b] for b in found) + earlier + link.intercept)
        want.append((str(d.doc_id), *[1 / (1 + math.exp(-min(30, max(-30, x)))) for x in logits]))
    got = sorted((str(r.doc_id), r.low_quality, r.toxic) for r in scored.collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)


def tiny_chain():
    rng = np.random.default_rng(3)
    features = [np.unique(rng.integers(0, 12, rng.integers(1, 7))) for _ in range(90)]
    first = np.array([float(0 in f or 1 in f) for f in features])
    second = np.array([float(first[i] and 2 in f) for i, f in enumerate(features)])
    labels = np.column_stack([first, second])
    labels[::10, 0] = np.nan  # a null label of one category
    return features, labels, np.arange(90) % toxicity.FOLDS


def dense(features):
    return np.array([[float(b in f) for b in range(12)] for f in features])


def slope(x, extra, y, w, e, b):
    error = (1 / (1 + np.exp(-(x @ w + extra @ e + b))) - y) / len(y)
    return x.T @ error, extra.T @ error, error.sum()


def test_chain_learns_from_out_of_fold_predictions(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 3000)
    features, labels, folds = tiny_chain()
    fits, fit = [], toxicity._fit

    def spy(rows, cols, width, extra, y):
        fits.append((extra.copy(), y.copy(), fit(rows, cols, width, extra, y)))
        return fits[-1][2]

    monkeypatch.setattr(toxicity, "_fit", spy)
    links = toxicity.fit_chain(features, labels, folds)
    x, known = dense(features), ~np.isnan(labels[:, 0])
    assert len(fits) == 2 * (toxicity.FOLDS + 1)
    # every fit is a minimum of the penalised loss, by the conditions on its slopes
    trained = [known & (folds != f) for f in range(toxicity.FOLDS)] + [known] + [folds != f for f in range(toxicity.FOLDS)] + [np.ones(90, bool)]
    for train, (extra, y, (w, e, b)) in zip(trained, fits, strict=True):
        by_feature, by_earlier, by_intercept = slope(x[train], extra, y, w, e, b)
        assert (np.abs(by_feature[w == 0]) <= toxicity.L1 + 1e-4).all()
        assert np.allclose(by_feature[w != 0], -toxicity.L1 * np.sign(w[w != 0]), atol=1e-4)
        assert np.allclose(by_earlier, 0, atol=1e-4) and abs(by_intercept) < 1e-4
    # the second link saw, for each document, the first link's margin from the fold that left it out
    margins = np.zeros(90)
    for f in range(toxicity.FOLDS):
        w, e, b = fits[f][2]
        margins[folds == f] = x[folds == f] @ w + b
    assert np.allclose(fits[-1][0][:, 0], np.clip(margins, -6, 6))
    assert np.allclose(links[0].weights[:12], fits[toxicity.FOLDS][2][0]) and np.allclose(links[1].earlier, fits[-1][2][1])


def test_repeated_documents_do_not_change_what_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    hot = labels.where("doc_id % 5 <> 0").first().doc_id
    more = docs.unionByName(docs.where(F.col("doc_id") == hot).crossJoin(spark.range(300)).drop("id"))
    once, often = toxicity.learn(docs, labels), toxicity.learn(more, labels)
    assert all(np.array_equal(a.weights, b.weights) and a.intercept == b.intercept for a, b in zip(once, often, strict=True))
    a, b = (quality_model.learn(quality_model.features(d), labels) for d in (docs, more))
    assert a.intercept == b.intercept and all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


def test_quality(spark, docs, empty):
    rows = labelled(spark, quality_model.op10_quality_model(spark, SF))
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    measured = quality_model.features(docs)
    none = quality_model.learn(measured, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_model.score(measured, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    assert quality_model.score(quality_model.features(empty), none).count() == 0
    few = spark.createDataFrame([(1, 1), (2, None), (6, 0), (7, 1), (99, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_model.score(measured, quality_model.learn(measured, few)).collect())


def test_quality_scores_by_hand(spark, sf_dir):
    """Scores of all documents from bins found by comparison and table entries added one by one."""
    measured = quality_model.features(spark.read.parquet(f"{sf_dir}/documents.parquet")).checkpoint()
    model = quality_model.learn(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert len(model.tables) == len(quality_model.FEATURES) and model.pairs
    for r in quality_model.score(measured, model).collect():
        x = [r[f] for f in quality_model.FEATURES]
        total = model.intercept + sum(model.tables[f][sum(e <= v for e in model.edges[f])] for f, v in enumerate(x))
        for a, b, tab in model.pairs:
            total += tab[sum(e <= x[a] for e in model.pair_edges[a])][sum(e <= x[b] for e in model.pair_edges[b])]
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_boosting_finds_the_best_cut():
    """A tree's first cut and its leaves, against all cuts."""
    rng = np.random.default_rng(5)
    g, h = rng.normal(size=9), rng.random(9) + 0.1
    worth = lambda part: g[part].sum() ** 2 / (h[part].sum() + quality_model.DAMPING)
    gains = [worth(slice(0, c)) + worth(slice(c, None)) - worth(slice(None)) for c in range(1, 9)]
    gain, cut = quality_model._split(g, h)
    assert gain == pytest.approx(max(gains)) and cut == 1 + int(np.argmax(gains))
    tree = quality_model._line_tree(g, h, depth=1)
    for part in (slice(0, cut), slice(cut, None)):
        assert np.allclose(tree[part], g[part].sum() / (h[part].sum() + quality_model.DAMPING))


def test_language_samples_count_documents_not_rows(spark):
    """One id with very many rows is one document: its language is learned, by the text with the least hash."""
    rows = [(1, f"the word number {k}", "en") for k in range(100)] + [(k, "das ist ein wort", "de") for k in range(2, 30)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.learn(df, 20)
    assert model.languages == ("de", "en")
    for row in model.log_prob:
        assert row.max() - row.min() > 1  # no flat model
    got = language_id.predict(spark.createDataFrame([("the number " * 40,), ("das ist ein " * 40,)], "text string"), model).collect()
    assert [r["__lang_pred"] for r in got] == ["en", "de"]
    # equal likelihoods: the first language by name
    same = [(k, "abc", lang) for k in range(1, 40) if zlib.crc32(str(k).encode()) % 5 for lang in ("xx", "aa")]
    model = language_id.learn(spark.createDataFrame(same, "doc_id long, text string, lang string"))
    assert language_id.predict(spark.createDataFrame([("abc",)], "text string"), model).first()["__lang_pred"] == "aa"


def test_rows_without_a_language_column(spark):
    known = spark.createDataFrame([(k, "the word" if k % 2 else "das wort", "en" if k % 2 else "de") for k in range(1, 40)], "doc_id long, text string, lang string")
    plain = spark.createDataFrame([(1, "the word", 5), (2, "123", 6)], "doc_id long, text string, n int")
    kept = language_id.keep_known(plain, labelled=known)
    assert kept.columns == plain.columns and [r.doc_id for r in kept.collect()] == [1]
