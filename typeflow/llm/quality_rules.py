"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document.  The ledger keeps the measurements and one
``failed_bits`` number with a bit for each failed rule; a policy is a versioned mask over
those bits, so trying another policy, or asking what one rule costs, never reads a text again.
Everything is built from Spark expressions.

Defined cases: a null text has no words and fails ``too_few_words``; a null doc_id is kept
as null; repeated rows give repeated ledger rows; an empty table gives an empty ledger;
columns besides doc_id and text are ignored, whatever their names.  Very long texts are measured
whole; from 2^24 words on all their windows are compared by words instead of keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, table

#: A window's key holds its position in this many low bits, below a piece of its hash.
POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """A named condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: Callable[[Column], Column]


RULES: tuple[Rule, ...] = (
    Rule("too_few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("too_many_words", lambda m: m["n_words"] > 1_000_000),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 25 * m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("shouting", lambda m: 100 * m["n_upper"] > 60 * m["word_chars"]),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask_of("too_few_words", "repeated_windows")
#: Policies by version.  A document passes if none of the policy's bits is set.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "full-1": BASE | mask_of("too_many_words", "short_words", "long_words", "symbols", "duplicate_lines", "shouting"),
    "full-2": BASE | mask_of("short_words", "long_words", "symbols", "duplicate_lines", "shouting"),
}
CURRENT = "full-1"
#: The pipeline's policy: a clean text is never rejected for its length alone.
PIPELINE = "full-2"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _prefix(key: Column) -> Column:
    return F.shiftright(key, POSITION_BITS)


def _repeated_positions(words: Column, n: Column) -> Column:
    """Start positions of the 3-word windows that are found twice or more.

    Sorted 64-bit keys put windows of equal hash pieces side by side; only those are then
    compared by their words, so the answer is exact.  Texts with more words than a key has
    positions for compare all windows.
    """
    starts = F.sequence(F.lit(0), n - 3)
    keys = F.transform(
        starts,
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        .bitwiseAND(F.lit(-(1 << POSITION_BITS)))
        .bitwiseOR(i.cast("long")),
    )

    def beside(keys: Column, same) -> Column:
        return F.filter(
            keys,
            lambda x, k: F.coalesce(same(x, F.get(keys, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(keys, k - 1)), F.lit(False)),
        )

    near = let(F.sort_array(keys), lambda s: F.transform(beside(s, lambda a, b: _prefix(a) == _prefix(b)), lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")))
    suspects = F.when(n <= (1 << POSITION_BITS), near).otherwise(starts)
    return let(
        suspects,
        lambda p: F.when(F.size(p) == 0, p).otherwise(
            let(
                F.sort_array(F.transform(p, lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(3)), " ").alias("w"), i.alias("i")))),
                lambda s: F.transform(beside(s, lambda a, b: a["w"] == b["w"]), lambda x: x["i"]),
            )
        ),
    )


def _repeat_words(words: Column) -> Column:
    n = F.size(words)
    covered = let(
        _repeated_positions(words, n),
        lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2))))),
    )
    return F.when(n >= 4, covered).otherwise(F.lit(0))


def measurements(text: Column) -> Column:
    """One struct with every number that a rule uses."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        )

    return let(words_of(text), lambda w: let(lines, lambda ls: of(w, ls)))


def measured(text: Column) -> Column:
    """The measurements and ``failed_bits`` as one struct; the measurements are made once."""

    def bits(m: Column) -> Column:
        failed = [F.when(rule.fails(m), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long") for rule in RULES]
        return reduce(Column.bitwiseOR, failed)

    return let(measurements(text), lambda m: m.withField("failed_bits", bits(m)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed_bits``, one row for each row of ``docs``."""
    return docs.select("doc_id", measured(F.col("text")).alias("m")).select("doc_id", "m.*")


def _passes(failed_bits: Column, version: str) -> Column:
    """A policy's verdict; base failures never pass."""
    return failed_bits.bitwiseAND(F.lit(BASE | POLICIES[version])) == 0


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger with ``base_failed`` and the policy's verdict ``kept``; base failures are never kept."""
    failed = F.col("failed_bits")
    return rows.withColumns({"base_failed": failed.bitwiseAND(F.lit(BASE)) != 0, "kept": _passes(failed, version)})


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it rejects.

    The ledger is first counted by its distinct bit patterns (at most 2 to the number of
    rules), so the rules are crossed with that bounded table alone.
    """
    mask = POLICIES[version]
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in RULES if BIT[r.name] & mask])
    return (
        patterns.select("bits", "n", F.explode(names).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_rejected_by_it_alone"),
        )
    )


def keep(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` whose ledger entry the policy passes, with their columns."""
    return docs.where(_passes(measured(F.col("text"))["failed_bits"], version))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "failed_bits"
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper
  FROM d LEFT JOIN repeated r USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * word_chars THEN 128 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, n_lines, n_upper, failed_bits
FROM f
"""
