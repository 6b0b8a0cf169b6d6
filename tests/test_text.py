import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T

WHITE = " \t\n\x0b\f\r"
ALPHABET = list("aAbZ .,;)!?-_/ \t\n\x0b\f\r\xa0 \x85\x1cÉİßж日") + ["http://", "https://", "x.org/", "the", "and", "I"]


def texts(n=400, seed=3):
    rnd = random.Random(seed)
    return ["", " ", *("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n))]


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain_words(s):
    return [w for w in re.split("[ \t\n\x0b\f\r]+", s) if w]


def run(spark, rows, **columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string")
    return [r.asDict() for r in df.select("i", *[c.alias(k) for k, c in columns.items()]).orderBy("i").collect()]


@pytest.mark.parametrize("given, wanted", [("  Hello   World ", "hello world"), ("A\tB\nC", "a b c"), ("", ""), (" \r\n ", ""), ("É İ", "É İ"), ("a B", "a b"), (None, None)])
def test_sanitize_cases(spark, given, wanted):
    assert run(spark, [given], x=T.sanitize(F.col("s")))[0]["x"] == wanted


def test_sanitize_and_words_against_a_plain_model(spark):
    rows = texts()
    for s, r in zip(rows, run(spark, rows, x=T.sanitize(F.col("s")), w=T.words(F.col("s")))):
        assert r["x"] == " ".join(plain_words(low(s)))
        assert r["w"] == plain_words(s)


def test_basic_tokens_against_a_plain_model(spark):
    rows = texts()
    punctuation = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    for s, r in zip(rows, run(spark, rows, t=T.basic_tokens(F.col("s")))):
        out, word = [], ""
        for c in low(s):
            if c in WHITE or c in punctuation:
                out += [word] if word else []
                out += [c] if c in punctuation else []
                word = ""
            else:
                word += c
        assert r["t"] == out + ([word] if word else [])


def plain_urls(s):
    ok, out, i = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~:/?#[]@!$&'()*+,;=%"), [], 0
    while i < len(s):
        if s.startswith(("http://", "https://"), i):
            j = i
            while j < len(s) and s[j] in ok:
                j += 1
            u = s[i:j].rstrip(".,);")
            out += [u] if len(u.encode()) > 10 else []
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize("given, wanted", [("go to https://a.example/x.", ["https://a.example/x"]), ("http://a.b/cd), and (http://e.f/gh?x=1&y=2)", ["http://a.b/cd", "http://e.f/gh?x=1&y=2"]), ("HTTP://a.b/c", []), ("http://abc", []), ("http://abcd", ["http://abcd"]), ("none", [])])
def test_url_cases(spark, given, wanted):
    assert run(spark, [given], x=T.extract_urls(F.col("s")))[0]["x"] == wanted


def test_urls_against_a_plain_model(spark):
    rows = texts(600, 8)
    for s, r in zip(rows, run(spark, rows, u=T.extract_urls(F.col("s")))):
        assert r["u"] == plain_urls(s)


def plain_phrases(s):
    w = plain_words(s)
    kept = [x for x in w if x not in T.STOP_WORDS]
    out = [s] + ([" ".join(kept)] if kept and len(kept) < len(w) else [])
    if len(w) > 2:
        out += [" ".join(w[i : i + k]) for k in range(min(5, len(w) - 1), 0, -1) for i in range(len(w) - k + 1)]
    return out[:15]


def test_phrases_against_a_plain_model(spark):
    rnd = random.Random(1)
    rows = ["", "one", "the", "one two", "the and", "please, go"] + [" ".join(rnd.choice(["the", "open", "door", "please,", "i", "now"]) for _ in range(n)) for n in [1, 2, 3, 5, 6, 18, 30] * 5]
    for s, r in zip(rows, run(spark, rows, p=T.phrases(F.col("s")))):
        assert r["p"] == plain_phrases(s)


def test_stop_words_are_as_many_as_listed():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 106


def test_user_content(spark):
    df = spark.createDataFrame([("q", ""), ("q", None), ("q", "<c>")], "s string, c string")
    got = [r[0] for r in df.select(T.user_content(F.col("s"), F.col("c"))).collect()]
    assert got == ["q", "q", "Use the following context to answer the question:\n\n<context><c></context>\n\nQuestion: q"]


def test_phrases_of_long_texts_take_linear_time(spark):
    """Twenty times the words must not take hundreds of times as long."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"w{i}{k}" for i in range(n)),) for k in range(40)], "s string")
        began = time.perf_counter()
        df.select(F.xxhash64(T.phrases(F.col("s")))).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(10)
    assert seconds(10_000) < 20 * max(0.5, seconds(500))
