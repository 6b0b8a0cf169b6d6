import random

import pytest

from weftline.operators import tokenize
from weftline.operators.tokenize import Vocabulary, encode, encode_joined, encode_text
from weftline.sources.files import load_vocab

TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "run", "##ning", "é", "##é", "hello", "world", ",", "!", "x", "##x"]


@pytest.fixture(scope="module")
def vocabulary(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("v") / "vocab.txt"
    path.write_text("\n".join([*TOKENS, "", "x", ""]), encoding="utf-8")
    df = load_vocab(spark, str(path))
    found = {r["token"]: r["token_id"] for r in df.collect()}
    assert found["x"] == len(TOKENS) + 1 and "" not in found and found["un"] == 4
    return df, found


def ids_of(spark, vocabulary, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    return [r["ids"] for r in encode(df, Vocabulary.of(vocabulary[0]), "i", "text").orderBy("i").collect()]


def test_cases(spark, vocabulary):
    known = vocabulary[1]
    rows = ["", None, "Hello, world!", "unaffable", "unzz", "running", "a" * 201, "é" * 100, "é" * 101, "x " * 600, "x" * 150, "unaff xx! " * 300]
    got = ids_of(spark, vocabulary, rows)
    assert got[0] == got[1] == [2, 3]
    assert got[4] == [2, known["un"], 1, 3]  # pieces found before the failure stay
    assert got[6] == [2, 1, 3] and got[8] == [2, 1, 3] and len(got[7]) == 102
    assert len(got[9]) == 512 and got[9][-1] == 3 and len(got[11]) == 512
    assert got == [encode_text(t or "", known) for t in rows]


def test_against_the_sequential_form(spark, vocabulary):
    rnd = random.Random(2)
    rows = ["".join(rnd.choice(["un", "aff", "able", "run", "x", "é", " ", ",", "q", "hello"]) for _ in range(rnd.randint(0, 12))) for _ in range(150)]
    assert ids_of(spark, vocabulary, rows) == [encode_text(t, vocabulary[1]) for t in rows]


def test_both_ways_give_the_same_ids(spark, vocabulary, monkeypatch):
    rnd = random.Random(5)
    rows = [None, "", "é" * 101, "un" * 400, *("".join(rnd.choice(["un", "aff", "able", "UN", "x", "É", " ", "\t", ",", "q", "hello"]) for _ in range(rnd.randint(0, 30))) for _ in range(80))]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    show = lambda d: {r["i"]: r["ids"] for r in d.collect()}
    sent = show(encode(df, Vocabulary.of(vocabulary[0]), "i", "text", 20))
    assert sent == show(encode_joined(df, Vocabulary.of(vocabulary[0]), "i", "text", 20))
    monkeypatch.setattr(tokenize, "MOST_TOKENS", 3)
    assert Vocabulary.of(vocabulary[0]).held() is None and show(encode(df, Vocabulary.of(vocabulary[0]), "i", "text", 20)) == sent


def test_missing_vocabulary(spark):
    with pytest.raises(RuntimeError):
        load_vocab(spark, "/nowhere/vocab.txt")
