import pytest

SPAN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
TEXTS = [
    (1, "The quick brown fox, jumps over 12 dogs! " * 12),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one"),
    (6, "word " * 30_000),
    (7, f"Before it all {SPAN.upper()} and after."),
    (8, "Été à l’école, ΑΣ İstanbul <|endoftext|> naïve 中文 é"),
    (9, "same text here for all of us"),
    (10, "same text here for all of us"),
    (10, "same text here for all of us"),
    (None, "no id"),
    (None, None),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use inside."""
    rows = [(i, t, "en" if t else None, "s", len(t or ""), 1, 2, 3, 4) for i, t in TEXTS]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, `group` int, unit int, fp int, `__m` int"
    return spark.createDataFrame(rows, kinds).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
