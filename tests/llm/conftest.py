import pytest

LONG = "word" * 3 + " " + "abc def " * 30_000 + "x" * 50_000
#: The same columns as documents and others whose names operators use themselves.
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp long, host string, n string, part string, p string, ids string, label string, place int"


def odd_rows():
    texts = [None, "", "   \n\t ", "one", "Same text twice here and there", "Same text twice here and there", "É İ ß 日本 \U0001f600 x", "a\x1cb \x85c", LONG, "same TEXT twice here and there"]
    rows = [(i, t, "en", "s1" if i % 2 else None, len(t or ""), 1.0, "k", 1, "h", "n", "p", "q", "i", "l", 3) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id", None, None, None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 13)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
