import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977} lorem{i % 31}" for i in range(30_000))
    shared = " ".join(f"passage{i}" for i in range(40))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "Alpha beta\ngamma  delta epsilon zeta eta theta"), (3, ""), (4, None),
        (5, long), (6, long + " tail"), (7, "é" * 300), (8, "a"), (9, "   \n\t "), (10, f"one two three {shared} four"),
        (11, f"other start {shared} other end"), (None, "no id here at all"), (12, "x" * 500), (13, "naïve 日本語 🙂 <|endoftext|> don't"),
        (14, "trailing  "), (15, "tab\t \tmix \n\n end"), (1, "alpha beta gamma delta epsilon zeta eta theta"),
    ]
    return spark.createDataFrame([(i, t, "en", "src", -1, 7, "k", 0.5) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, vertex long, key string, toxicity_score double")
