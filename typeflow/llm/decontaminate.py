"""Benchmark decontamination by winnowing.

Both sides keep the minimum hash of every sliding window of word k-grams.  Two texts that
share a span of ``k + w - 1`` words share every k-gram hash window in it, hence its minimum,
so no shared window of WINDOW words can be missed.  Surviving fingerprints of a document are
extended to the windows around them, and those are joined by their full words with the windows
of the items, so the result is exact.  An item with fewer words than WINDOW is one window of its
own length: from GRAM words on it has the same k-grams, below that it is a k-gram itself, so a
text's words are hashed for at most GRAM sizes whatever the lengths of the items.

A bitmap of the items' fingerprints thins the documents' fingerprints before anything is exploded;
it only ever lets too many through.  It has BITS_PER_PRINT bits or more for each fingerprint, up to
16 MB; a benchmark of more than 2^23 fingerprints only makes it less sharp.

Only documents with a candidate window take part in the join, each under a number of its own.

Defined cases: a null text has no words, so it is clean; an empty text likewise; very long texts are
searched whole, in time that grows with their words; items without words have no window; repeated
documents give a row each; a null doc_id is kept; an item_id that is null is not listed, though its
words count as hit; repeated item rows count once; an empty benchmark leaves all clean; columns
besides doc_id, item_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, if_small, let, settle, table

WINDOW = 10
#: Words of a k-gram; WINDOW - GRAM + 1 k-gram hashes make one winnowing window.
GRAM = 5
#: Bits of the bitmap for each fingerprint, and the bounds of its longs as powers of two: 32 KB to 16 MB.
BITS_PER_PRINT = 16
LEAST_LONGS, MOST_LONGS = 12, 21
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _gram_hashes(words: Column, k: int) -> Column:
    """Hash of the k-gram that starts at each word."""
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _minima(hashes: Column, w: int) -> Column:
    """The minimum of every w neighbouring hashes: the winnowed fingerprints, with repeats."""
    if w == 1:
        return hashes
    return F.when(
        F.size(hashes) >= w,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - w), lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _gram(length: int) -> int:
    """Words of the k-grams that windows of ``length`` words are found by."""
    return min(length, GRAM)


def _slot(h: Column, longs: int) -> Column:
    return F.shiftright(h, 6).bitwiseAND(F.lit(longs - 1)).cast("int")


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63)).cast("int")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """length, window (words joined by a space) and the sorted items that hold it, one row for each distinct window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    return (
        items.select("item_id", "words", F.explode(starts).alias("at"))
        .select(
            "item_id",
            F.least(F.size("words"), F.lit(WINDOW)).alias("length"),
            F.array_join(F.slice("words", F.col("at") + 1, F.lit(WINDOW)), " ").alias("window"),
        )
        .groupBy("length", "window")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )


def _prints(windows: DataFrame, gram: int, lengths: list[int]) -> DataFrame:
    """The distinct winnowed fingerprints of the windows of ``lengths`` words (h)."""
    found = [
        windows.where(F.col("length") == n).select(F.explode(_minima(_gram_hashes(F.split("window", " "), gram), n - gram + 1)).alias("h"))
        for n in lengths
    ]
    return reduce(DataFrame.unionByName, found).distinct()


def _bitmap(prints: DataFrame, longs: int) -> Column:
    """The bits of all fingerprints as one array of ``longs`` numbers."""
    bits = prints.groupBy(_slot(F.col("h"), longs).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits"))
    slots = prints.sparkSession.range(longs).select(F.col("id").cast("int").alias("slot"))
    filled = slots.join(bits, "slot", "left").select("slot", F.coalesce("bits", F.lit(0)).cast("long").alias("bits"))
    # the slots number ``longs`` whatever the benchmark holds
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"]).alias("bits")).scalar()


def _candidates(words: Column, gram: int, lengths: list[int], known: Column, longs: int) -> Column:
    """Structs (at, length, window) for the document's windows around winnowed fingerprints that are in the bitmap."""
    w = min(lengths) - gram + 1  # the least of a longer run of hashes is the least of the shorter runs inside it too

    def around(hashes: Column) -> Column:
        def kept(p: Column) -> Column:
            h = F.get(hashes, p)
            in_map = F.getbit(F.get(known, _slot(h, longs)), _bit(h)) == 1
            if w == 1:
                return in_map
            near = [F.least(*[F.coalesce(F.get(hashes, p - j + k), h) for k in range(w)]) == h for j in range(w)]
            return in_map & reduce(Column.__or__, near)

        return F.when(F.size(hashes) > 0, F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), kept)).otherwise(F.array().cast("array<int>"))

    def windows(positions: Column, n: int) -> Column:
        starts = F.array_distinct(F.flatten(F.transform(positions, lambda p: F.sequence(p - (n - gram), p))))
        inside = F.filter(starts, lambda a: (a >= 0) & (a <= F.size(words) - n))
        return F.transform(
            inside, lambda a: F.struct(a.alias("at"), F.lit(n).alias("length"), F.array_join(F.slice(words, a + 1, F.lit(n)), " ").alias("window"))
        )

    return let(let(_gram_hashes(words, gram), around), lambda ps: F.concat(*[windows(ps, n) for n in lengths]))


def _candidate_rows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, print, n_words, spans: a row for each row of ``docs`` with its candidate windows."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW values
    by_gram = {g: [n for n in lengths if _gram(n) == g] for g in sorted(set(map(_gram, lengths)))}
    text = F.col("text").cast("string")
    mapped = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    longs = {}
    for gram, ns in by_gram.items():
        prints = settle(_prints(windows, gram, ns))
        longs[gram] = 1 << min(MOST_LONGS, max(LEAST_LONGS, (prints.count() * BITS_PER_PRINT // 64).bit_length()))
        mapped = mapped.withColumn(f"map_{gram}", _bitmap(prints, longs[gram]))

    def spans(words: Column) -> Column:
        found = [_candidates(words, gram, ns, F.col(f"map_{gram}"), longs[gram]) for gram, ns in by_gram.items()]
        none = F.array().cast("array<struct<at:int,length:int,window:string>>")
        return F.struct(F.size(words).cast("long").alias("n_words"), (F.concat(*found) if found else none).alias("spans"))

    spread = mapped.select("row", "doc_id", F.xxhash64("text").alias("print"), let(words_of(F.col("text")), spans).alias("s"))
    return settle(spread.select("row", "doc_id", "print", "s.*"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, print (the text's hash) for each row of ``docs``."""
    windows = settle(item_windows(benchmark))
    rows = _candidate_rows(docs, windows)
    spread = rows.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    found = (
        spread.join(windows.select("window", "items"), "window")
        .groupBy("row")
        .agg(F.collect_set(F.struct("at", "length")).alias("hits"), F.collect_set("items").alias("items"))
    )
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1)))))
    items = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda i: i.cast("string")))
    hit = found.select("row", n_hit.cast("long").alias("n_hit"), items.alias("items"))
    plain = ["row", "doc_id", "print", "n_words"]
    suspects = rows.where(F.size("spans") > 0).select(plain).join(hit, "row", "left")
    others = rows.where(F.size("spans") == 0).select(*plain, F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return suspects.unionByName(others).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"), "print"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit word, with their columns; documents are told apart by doc_id and text."""
    name = free_name(docs, "__hit")
    hit = settle(contamination(docs, benchmark).where("contaminated").select(F.struct("doc_id", "print").alias(name)).distinct())
    same = docs["doc_id"].eqNullSafe(F.col(f"{name}.doc_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col(f"{name}.print"))
    return docs.join(if_small(hit), same, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
          FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
