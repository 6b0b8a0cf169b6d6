import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from weftline.llm import pii, quality

ALPHABET = list("ab@.+-% 0123456789()\n") + ["x@y.zz", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", " at ", " dot ", "one ", "two ", "three ", "é", "а"]


def plain(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], ["email", "ip", "card", "phone"].index(x[2]), x[1]))


def test_base_spans_against_the_patterns():
    rnd = random.Random(8)
    for _ in range(4000):
        t = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25)))
        assert pii.detect(t) == plain(t), t
        base, added = pii.find_spans(t)
        assert base == plain(t)
        spots = [set(range(s, e)) for s, e, _ in added]
        assert all(0 <= s < e <= len(t) for s, e, _ in added)
        assert not any(x & set(range(s, e)) for x in spots for s, e, _ in base)
        assert sum(map(len, spots)) == len(set().union(*spots))


def test_transducers_keep_offsets():
    """Every character of the normalised text stands for a stretch that lies behind the one before it."""
    rnd = random.Random(9)
    for _ in range(1500):
        t = "".join(rnd.choice(ALPHABET + ["plus ", "[at]", "(dot)", "​", "＠", "５"]) for _ in range(rnd.randint(0, 20)))
        norm, starts, ends = pii.normalise(t)
        assert len(norm) == len(starts) == len(ends)
        assert all(a < b for a, b in zip(starts, ends)) and list(starts) == sorted(starts)
        for i, c in enumerate(norm):
            if ends[i] - starts[i] == 1 and t[starts[i]] == c:
                continue
            assert t[starts[i] : ends[i]] != c


DISGUISED = [
    ("write to john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"), ("jane at example dot co dot uk ok", "email", "jane at example dot co dot uk"),
    ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"), ("a bob[@]example[.]org.", "email", "bob[@]example[.]org"), ("mail bo​b@example.com", "email", None),
    ("call plus one five five five two three four five six seven now", "phone", "plus one five five five two three four five six seven"), ("tel ＋1 (555) 123-4567 x", "phone", "＋1 (555) 123-4567"),
    ("4OI2 8888 8888 1881", "card", "4OI2 8888 8888 1881"), ("10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"), ("ip 10 dot 1 dot 2 dot 3!", "ip", "10 dot 1 dot 2 dot 3"), ("ana arroba ejemplo punto es", "email", "ana arroba ejemplo punto es"),
    ("ring +1 five five five 123 4567 now", "phone", "+1 five five five 123 4567"), ("más uno dos tres cuatro cinco seis siete ocho nueve cero uno", "phone", "más uno dos tres cuatro cinco seis siete ocho nueve cero uno"),
    ("vier eins eins eins, eins eins eins eins, eins eins eins eins, eins eins eins eins", None, None),
]


@pytest.mark.parametrize("text, kind, part", DISGUISED)
def test_disguises(text, kind, part):
    base, added = pii.find_spans(text)
    if part is not None:
        assert [(k, text[s:e]) for s, e, k in added] == [(kind, part)] and base == []
        assert pii.redacted(text) == text.replace(part, f"[{kind.upper()}]")


PARTLY_DISGUISED = [
    ("mail jоhn@example.com now", "email", ["hn@example.com"], ["jо"]), ("john@example.cоm ok", "email", ["john@example.c"], ["оm"]),
    ("x john (dot) doe@example.com y", "email", ["doe@example.com"], ["john (dot) "]), ("john@mail.example (dot) com", "email", ["john@mail.example"], [" (dot) com"]),
    ("mail bo\u200bb@example.com", "email", ["b@example.com"], ["bo\u200b"]), ("jоhn@example.cоm", "email", ["hn@example.c"], ["jо", "оm"]),
]


@pytest.mark.parametrize("text, kind, base, added", PARTLY_DISGUISED)
def test_a_find_wider_than_a_base_span_is_covered_whole(text, kind, base, added):
    found = pii.find_spans(text)
    assert [[(k, text[s:e]) for s, e, k in spans] for spans in found] == [[(kind, x) for x in base], [(kind, x) for x in added]]
    s, e = min(x[0] for x in sum(found, [])), max(x[1] for x in sum(found, []))
    assert pii.redacted(text) == text[:s] + f"[{kind.upper()}]" + text[e:]


SPELLED_OUT = [
    ("vier eins eins eins, eins eins eins eins, eins eins eins eins, eins eins eins eins", "card", None),
    ("pay four two four two four two four two four two four two four two four two now", "card", "four two four two four two four two four two four two four two four two"),
    ("a cinq cinq cinq cinq cinq cinq cinq cinq cinq cinq cinq cinq quatre quatre quatre quatre b", "card", "cinq cinq cinq cinq cinq cinq cinq cinq cinq cinq cinq cinq quatre quatre quatre quatre"),
    ("call plus one one one five five one one one five five ok", "phone", "plus one one one five five one one one five five"),
    ("ip ten dot zero dot zero dot one ok", "ip", "ten dot zero dot zero dot one"), ("one dot one dot one dot one", "ip", None), ("plus one one.two two.one two three.one two three", "phone", None),
    ("on one nine two dot one six eight dot one dot twenty-five.", "ip", "one nine two dot one six eight dot one dot twenty-five"), ("10 dot zero.0 (dot) one", "ip", None),
    ("a hundred and seventy two dot sixteen dot two hundred fifty five dot 1", "ip", None), ("zehn punkt null punkt einhundertzwanzig punkt eins", "ip", None),
    ("diez punto cero punto treinta y uno punto uno", "ip", None), ("dix point zéro point quatre-vingt-dix point un", "ip", None),
]


@pytest.mark.parametrize("text, kind, part", SPELLED_OUT)
def test_spelled_digits_and_octets(text, kind, part):
    base, added = pii.find_spans(text)
    assert base == [] and [(k, text[s:e]) for s, e, k in added] == [(kind, part or text)]


@pytest.mark.parametrize("text", ["one dot two dot three", "four.one.one.one.one.one", "at one. Two. Three. Four of them", "one one one one one one one one one one one one one one one one"])
def test_spelled_numbers_that_are_no_data(text):
    assert pii.find_spans(text) == ([], [])


SPELLED_AT = [
    ("write jane at example.com now", "jane at example.com"), ("jane AT example.com", "jane AT example.com"), ("a jane arroba ejemplo.es.", "jane arroba ejemplo.es"),
    ("to john dot doe at example dot com ok", "john dot doe at example dot com"), ("to j dot r dot doe at mail.example.org ok", "j dot r dot doe at mail.example.org"),
    ("x ana punto ruiz arroba ejemplo punto es", "ana punto ruiz arroba ejemplo punto es"), ("jane at example punto com", "jane at example punto com"), ("jane at mail dot example.com", "jane at mail dot example.com"),
]


@pytest.mark.parametrize("text, part", SPELLED_AT)
def test_spelled_at_and_dots(text, part):
    base, added = pii.find_spans(text)
    assert base == [] and [(k, text[s:e]) for s, e, k in added] == [("email", part)]
    assert pii.redacted(text) == text.replace(part, "[EMAIL]")


def test_spelled_dots_before_a_plain_address():
    assert pii.redacted("to john dot doe@example.com ok") == "to [EMAIL] ok"


@pytest.mark.parametrize("text", ["look at example.com", "see us at www.example.com", "details at example.com/page", "at this point in time", "we arrived at noon.Then we left", "a dot here, and at noon. Then"])
def test_prose_with_at_stays(text):
    assert pii.find_spans(text) == ([], [])


@pytest.mark.parametrize("text", ["look at the point here and there at a dot", "one of two or three", "we met at noon dot", "Un un un un un un un un un un un un un un un un", "see (at) the (dot)", "a at b", "version 1.2.3", "é à ü"])
def test_plain_prose_stays(text):
    assert pii.find_spans(text) == ([], []) and pii.redacted(text) == text


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "+1" * 100_000, "1." * 100_000, "one " * 60_000, " at a" * 60_000, "(" * 200_000, "a dot " * 50_000):
        pii.find_spans(t)


def test_personal_data_of_odd_rows(spark, odd, nothing):
    found = pii.personal_data(odd).collect()
    assert len(found) == len(odd_rows()) and all(r["base"] == r["added"] == [] for r in found)
    assert pii.personal_data(nothing).count() == 0
    more = odd.withColumn("text", F.concat("text", F.lit(" a@b.cc")))
    out = pii.redact(more)
    assert out.columns == odd.columns and out.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    assert all((r["text"] is None and r["n_chars"] is None) or (r["text"].endswith("[EMAIL]") and r["n_chars"] == len(r["text"])) for r in out.collect())


def plain_counts(text):
    text = text or ""
    words, cur = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\f\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    spots = {i + k for i, g in enumerate(grams) if g in many for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(spots)


def test_counts_against_a_plain_model(spark, odd, nothing):
    rnd = random.Random(4)
    texts = [r[1] for r in odd_rows()] + ["".join(rnd.choice(["a ", "b ", "\n", "#", "é ", "a b c d e ", "\x0b", "\U0001f600 ", "\x1c"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.quality(df).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}
    assert quality.quality(odd).count() == len(odd_rows()) and quality.quality(nothing).count() == 0


def shrunk(rates):
    """Posterior mean rates of hosts [(fails, n)] under the prior by moments."""
    r = [f / n for f, n in rates]
    mean = sum(r) / len(r)
    var = sum((x - mean) ** 2 for x in r) / len(r)
    strength = min(1000.0, max(1.0, mean * (1 - mean) / var - 1)) if var else 1000.0
    return [(f + mean * strength) / (n + strength) for f, n in rates]


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(f"good{h}", good) for h in range(8) for _ in range(20)] + [("bad", "few")] * 60 + [("bad", good)] + [("rare", "few")] + [(None, "few"), (None, good)]
    df = spark.createDataFrame([(i, t, h, True) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, kept boolean")
    hosts = {(r["host"], r["rule"]): r for r in quality.judge_hosts(quality.judge_documents(df)).collect()}
    order = [f"good{h}" for h in range(8)] + ["bad", "rare"]
    wanted = shrunk([(0, 20)] * 8 + [(60, 61), (1, 1)])
    assert [hosts[h, "words"]["shrunk"] for h in order] == pytest.approx(wanted)
    assert hosts["bad", "words"]["host_failed"] and not hosts["good0", "words"]["host_failed"]
    out = {r["doc_id"]: r for r in quality.quality(df).collect()}
    last_bad = 8 * 20 + 60
    assert out[last_bad]["host_failed"] and not out[last_bad]["base_failed"] and not out[last_bad]["kept"]
    assert out[0]["kept"] and out[len(rows) - 1]["kept"] and out[len(rows) - 2]["base_failed"]


def test_sql(spark):
    texts = ["", None, "a b c d e f a b c d e", "x\nx\n\n \nx", "one two three four five six seven eight nine ten eleven"] * 3 + ["#|<> a"] * 4
    df = spark.createDataFrame([(i, t, f"h{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    con = duckdb.connect()
    pdf = df.toPandas()
    con.register("documents", pdf)
    show = lambda rows: sorted(map(str, rows))
    assert show(tuple(r) for r in quality.quality(df).collect()) == show(con.execute(quality.ORACLE).fetchall())
