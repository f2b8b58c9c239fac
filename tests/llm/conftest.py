import pytest

ODD = [None, "", " ", "a", "x" * 60_000, "Déjà vu, déjà vu.", "one two", "\x1c\x85 é́ Σ", "the same words come again here " * 40]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names clash with those inside."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a"), (None, "null id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "1 AS fp", "2 AS a", "3 AS key", "4 AS node", "5 AS row", "6 AS chunk", "7 AS gone").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
