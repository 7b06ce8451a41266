"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts n-grams on the executors and sends only the summed (language, bucket) counts to
the driver, a matrix of fixed width.  It reads at most about ``sample`` labelled documents a
language, chosen by a hash of doc_id, whole texts each.  The log-probability matrix is broadcast.
Texts are scored many at a time: all their n-grams form one sparse matrix of (text, bucket)
places, which picks entries of a language's log-probabilities, summed by text.

Texts are read in runs of STEP_CHARS characters; a text that a run cuts goes on in the next one
with the last characters of the former before it, and every n-gram is counted just once.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a very long text is
scored whole, in runs of bounded memory; documents with a null lang are predicted but not learned
from; a null doc_id counts as held out; with nothing to learn from all is ``und``; a language with any document to
learn from has one in its sample, which counts distinct doc_ids; equal likelihoods go to the language that comes first
by name; repeated rows are predicted each; an empty table gives no rows; other columns are ignored; more than
MAX_LANGUAGES values of lang are an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, held_out, portions, table, trim, trimmed
from .labelled import in_sample

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE = 10_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters of text that are turned into buckets at once.
STEP_CHARS = 250_000
#: Weight of one n-gram's evidence: overlapping n-grams repeat each other.
TEMPER = 1 / len(ORDERS)
#: Languages that a model may have, which bounds its matrix to 64 MB.
MAX_LANGUAGES = 512


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # languages x BUCKETS, float32
    log_prior: np.ndarray


def _runs(texts: Iterable[str]) -> Iterator[tuple[list[int], list[str], bool, bool]]:
    """Runs of lower-case texts: their numbers, the texts or parts of texts, and whether the first began, or the last ends, elsewhere."""
    numbers, parts, size, begun = [], [], 0, False
    for i, text in enumerate(texts):
        text, at = text.lower(), 0
        while True:
            part = text[at : at + STEP_CHARS - size]
            numbers.append(i)
            parts.append(part)
            size, at = size + len(part), at + len(part)
            cut = at < len(text)
            if size >= STEP_CHARS:
                yield numbers, parts, begun, cut
                numbers, parts, size, begun = [], [], 0, cut
            if not cut:
                break
    if parts:
        yield numbers, parts, begun, False


def ngrams(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram of every text, in many pairs of arrays.

    A text's characters are its lower-case code points, with every run of other characters one space.
    """
    width = max(ORDERS) - 1
    carried, after_other = np.zeros(0, "<u4"), False
    for numbers, parts, begun, cut in _runs(texts):
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        other = (raw < 97) | ((raw > 122) & (raw < 170))
        keep = np.ones(len(raw), dtype=bool)
        keep[1:] = ~(other[1:] & other[:-1])
        keep[(np.cumsum(lengths) - lengths)[lengths > 0]] = True  # what stands before a text is another text's
        if begun and len(raw) and other[0] and after_other:
            keep[0] = False
        points = np.where(other, np.uint32(32), raw)[keep]
        row = np.repeat(np.array(numbers, np.int64), lengths)[keep]
        seen = len(carried) if begun else 0
        if seen:
            points, row = np.concatenate([carried, points]), np.concatenate([np.full(seen, numbers[0]), row])
        key = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, min(max(ORDERS), len(points)) + 1):
            key = key[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                inside = row[: len(key)] == row[n - 1 :]
                inside[: max(0, seen - n + 1)] = False  # the former run had these
                mixed = (key[inside] ^ (key[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield row[: len(key)][inside], (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        if cut:
            last = points[row == numbers[-1]]
            carried, after_other = last[len(last) - min(width, len(last)) :], bool(other[-1])


def count(texts: Iterable[str]) -> np.ndarray:
    """How often each bucket's n-grams stand in all of ``texts``."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for _, found in ngrams(texts):
        total += np.bincount(found, minlength=BUCKETS)
    return total


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the languages in ``lang`` from about ``sample`` documents each that are not held out.

    Documents are told apart by doc_id and language; of several texts of one, that with the least hash teaches.
    """
    usable = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = usable.groupBy("lang").agg(F.count_distinct("doc_id").alias("ids")).limit(MAX_LANGUAGES + 1)
    sizes = {r.lang: r.ids for r in counts.collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    if not sizes:
        return Model((), np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.float32))
    chosen = usable.where(F.coalesce(*[F.when(F.col("lang") == lang, in_sample(F.col("doc_id"), sample, n)) for lang, n in sizes.items()]))
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                counts[lang] = counts.get(lang, 0) + count(batch.column(0)[int(i)].as_py() for i in np.flatnonzero(langs == lang))
        for lang, row in counts.items():
            at = np.nonzero(row)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "bucket", "n"])

    summed = chosen.select("text", "lang").mapInArrow(trimmed(of), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(sizes))
    matrix = np.full((len(languages), BUCKETS), SMOOTHING)
    place = {lang: i for i, lang in enumerate(languages)}
    for lang, bucket, n in zip(*(summed[c].to_pylist() for c in ("lang", "bucket", "n"))):
        matrix[place[lang], bucket] += n
    log_prob = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
    total = sum(min(n, sample) for n in sizes.values())
    return Model(languages, log_prob, np.log([min(sizes[x], sample) / total for x in languages]).astype(np.float32))


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    """Log-likelihoods, texts x languages."""
    out = np.zeros((len(texts), len(model.languages)))
    for row, bucket in ngrams(texts):
        if len(row):
            first = row[0]  # a run holds neighbouring texts
            row = row - first
            for k in range(len(model.languages)):
                sums = np.bincount(row, weights=model.log_prob[k][bucket])
                out[first : first + len(sums), k] += sums
    return out


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("__lang_pred", "__score")) -> DataFrame:
    """The columns of ``docs`` with the language and its score, called ``names``; only the text column is read for them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS, whatever the corpus's size
    languages = np.array([*model.languages, UNKNOWN], dtype=object)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        m, best, score = shared.value, [], []
        for run in portions((t.as_py() or "" for t in texts), STEP_CHARS):
            lettered = np.array([any(map(str.isalpha, t)) for t in run], dtype=bool)
            own, sure = np.full(len(run), len(m.languages)), np.zeros(len(run))
            if m.languages and lettered.any():
                log = score_texts([t for t, x in zip(run, lettered) if x], m) * TEMPER + m.log_prior
                p = np.exp(log - log.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                own[lettered], sure[lettered] = p.argmax(axis=1), p.max(axis=1)
            best += languages[own].tolist()
            score += sure.tolist()
        trim()
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    columns = [F.col(f"`{c}`") for c in docs.columns]
    guess = free_name(docs, "__guess")
    guessed = docs.select(*columns, of(F.col("text").cast("string")).alias(guess))
    return guessed.select(*columns, F.col(f"{guess}.lang_pred").alias(names[0]), F.col(f"{guess}.score").alias(names[1]))


def keep_known(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more, with their columns.

    The languages are learned from ``labelled`` (doc_id, text, lang), or from ``docs`` itself.
    """
    lang, score = free_name(docs, "__lang_pred"), free_name(docs, "__score")
    guessed = predict(docs, learn(docs if labelled is None else labelled, sample), (lang, score))
    return guessed.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    guessed = predict(docs.select("doc_id", "text"), learn(docs))
    return guessed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))
