import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rec string, fp long, gone long, size long, score double, bucket int"

WORDS = "the of and to in that was for with on river stone house light green water people under morning evening between market".split()


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def doc(i, text, lang="en", source="s0"):
    """A row with columns whose names clash with those that operators use."""
    return (i, text, lang, source, None if text is None else len(text), "rec", 1, 2, 3, 0.5, 4)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    long = words(60_000, 1)
    near = words(300, 2)
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, long), doc(5, near), doc(6, near), doc(7, near + " tail"),
        doc(8, "word"), doc(8, "word"), doc(8, "word"), doc(9, "word"), doc(None, "no id here"), doc(None, "no id here"), doc(None, words(50, 5)),
        doc(10, words(40, 3), None, None), doc(11, words(40, 4), "de", "s1"), doc(12, "Ünïcödé 中文 🙂 text", "fr", "s1"), doc(12, "another text, same id", "fr", "s2"),
        doc(13, "!!! ### 123", "en", "s2"),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
