import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, words string, id string, th string, key string, size long, score double, fp string, rep string, n long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} thing" for i in range(60_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog today.\nA second line of seven plain words here.", "en", "a"), (1, "The quick brown fox jumps over the lazy dog today.\nA second line of seven plain words here.", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog today.", "en", "a"), (3, "", "en", None), (4, None, None, None), (5, " \n\t ", "fr", "b"), (6, long, "en", "b"), (None, "A row without an id has some words.", "en", "b"),
        (None, None, None, None), (7, "été où ça\x00 Ünïcode 💡 " * 5, "fr", "c"), (8, "one", None, "c"), (9, "!!! ### $$$", "en", "c"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), 1, "w", "x", "y", "z", 5, 0.5, "f", "r", 3) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    """No documents."""
    return spark.createDataFrame([], DOCS)
