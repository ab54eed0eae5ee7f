import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    base = "the quick brown fox jumps over the lazy dog near a quiet river bank while seven wise owls watch from old oak trees at dusk "
    rows = [
        (1, base * 4, "a", 1),
        (2, base * 4, "b", 2),
        (2, base * 4, "b", 2),
        (3, None, None, None),
        (4, "", "c", 4),
        (5, " \n\t ", "c", 5),
        (6, "word", "c", 6),
        (7, "x" * 70_000, "c", 7),
        (8, "alpha beta " * 12_000, "c", 8),
        (None, "no id here but some words to read", "d", 9),
        (9, "Ünïcödé 🎉 straße ÉÈ İx. Done! é\x1c\x85", "d", None),
        (-5, "negative id, ties\nties\nties", "d", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
