"""Corpus pipeline: quality rules, language ID, near-dedup, decontamination, BPE.

Every stage takes documents (doc_id, text and any other columns) and all but the last give the rows
that they keep, with the columns they had.  ``run`` writes each stage's documents as Parquet in the
shared folder, so the next one reads only the columns it needs and a lost executor costs no earlier
stage; a stage's files go once the next one's are there.

Defined cases, each from its operator: a null or empty text has no words and leaves at the quality
rules; by itself, language ID drops a text without letters, near-dedup takes all texts without words
for copies of each other, decontamination and BPE keep them; very long texts are read whole; a null
doc_id is kept; of equal rows one stays at near-dedup, elsewhere each counts; an empty table goes
through all stages; other columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from typeflow.llm.bpe import digests
from typeflow.llm.common import new_folder, remove, table
from typeflow.llm.decontaminate import drop_contaminated
from typeflow.llm.language_id import keep_known
from typeflow.llm.quality_rules import PIPELINE, keep
from typeflow.llm.simhash import WIDE_RADIUS, keep_one

#: Fingerprints, learned models and the tokenizer have no SQL form; see the brute-force test.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy PIPELINE passes: op7's, but that no text is too long.

    A null or empty text has too few words and goes.
    """
    return keep(docs, PIPELINE)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a null text, or one without letters, goes.

    Languages are learned from ``docs``, or from the corpus's documents where ``docs`` has no lang.
    """
    return keep_known(docs, labelled=None if "lang" in docs.columns else table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, linked within WIDE_RADIUS bits; equal rows give one."""
    return keep_one(docs, WIDE_RADIUS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark; texts without words stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of each document; a null text is empty."""
    return digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
