import math
import random

import numpy as np
import pytest

from tests.llm.conftest import odd_rows
from weftline.llm import langid, toxicity
from weftline.llm.common import crc_of

PIECES = {p: i for i, p in enumerate(["▁a", "a", "b", "ab", "▁ab", "ba", "aba"])}


def segmentations(s, longest=3):
    if not s:
        yield []
    for n in range(1, min(longest, len(s)) + 1):
        if s[:n] in PIECES or n == 1:
            for rest in segmentations(s[n:]):
                yield [s[:n], *rest]


def test_forward_sums_all_segmentations():
    rnd = np.random.default_rng(0)
    logp = np.hstack([np.log(rnd.dirichlet(np.ones(len(PIECES)), 3)), np.full((3, 1), langid.FLOOR)])
    for word in ["a", "ab", "abab", "abcab", "bbab", "ccc"]:
        wanted = [math.log(sum(math.exp(sum(row[PIECES.get(p, -1)] for p in cut)) for cut in segmentations("▁" + word))) for row in logp]
        assert langid.forward(word, logp, PIECES, 3) == pytest.approx(wanted)
        assert langid.forward_many([word, word[::-1]], langid.scaled(logp, PIECES), langid.PieceIndex(PIECES))[0] == pytest.approx(wanted)


def test_words_together_equal_words_alone():
    """With the whole vocabulary, and words of letters of several scripts."""
    pieces, longest = langid.vocabulary(langid.default_vocabulary())
    rnd, rng = random.Random(2), np.random.default_rng(1)
    logp = np.hstack([np.log(rng.dirichlet(np.ones(len(pieces)), 2)), np.full((2, 1), langid.FLOOR)])
    index, table, own = langid.PieceIndex(pieces), langid.scaled(logp, pieces), sorted(p.strip(langid.MARK) for p in pieces)
    for n in (1, 2, 5, 12, 64):
        words = [("".join(rnd.choice(own) for _ in range(n)) + "日本éß\U00010400" * n)[:n] for _ in range(60)]
        assert langid.forward_many(words, table, index) == pytest.approx(np.array([langid.forward(w, logp, pieces, longest) for w in words]))


def test_estimate_is_expectation_maximisation():
    """One round against expected counts over all segmentations."""
    counts = {"ab": 3, "aba": 2, "b": 1}
    start = langid.estimate(counts, PIECES, 3, rounds=0)
    expected = np.full(len(PIECES), langid.SMOOTHING)
    for w, c in counts.items():
        cuts = [(cut, math.exp(sum(start[PIECES[p]] if p in PIECES else langid.FLOOR for p in cut))) for cut in segmentations("▁" + w)]
        total = sum(q for _, q in cuts)
        for cut, q in cuts:
            for p in cut:
                if p in PIECES:
                    expected[PIECES[p]] += c * q / total
    assert np.exp(langid.estimate(counts, PIECES, 3, rounds=1)) == pytest.approx(expected / expected.sum())


def test_long_words_are_learned_like_short_ones(monkeypatch):
    """Sums in logarithms against the linear ones, and a word of 80 letters that no linear product could hold."""
    counts = {"ab": 3, "aba": 2, "bbabaab": 4, "cab": 1}
    linear = langid.estimate(counts, PIECES, 3, rounds=3)
    monkeypatch.setattr(langid, "LONGEST_LINEAR", 1)
    assert langid.estimate(counts, PIECES, 3, rounds=3) == pytest.approx(linear)
    monkeypatch.undo()
    without = langid.estimate({"ab": 1}, PIECES, 3, rounds=2)
    for word, piece in (("ba" * 40, "ba"), ("b" * 3000, "b")):
        learned = langid.estimate({"ab": 1, word: 5}, PIECES, 3, rounds=2)
        assert learned[PIECES[piece]] > without[PIECES[piece]] + 1 and np.isfinite(learned).all()


def test_numeric_signs_are_no_letters(spark):
    assert langid.words("½ ² ① Ⅷ x²y 12 a_b É½é ´ 日本") == ["x", "y", "a", "b", "é", "é", "日本"]
    rows = [*language_rows(), (1000, "½ ²", None), (1001, "12 ① _", None)]
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (1000, 1001))


def language_rows(n=160):
    rnd = random.Random(3)
    kinds = {"xx": ["the", "and", "thing", "with", "other"], "yy": ["und", "der", "nicht", "schrift", "über"]}
    return [(i, " ".join(rnd.choice(kinds[k]) for _ in range(rnd.randint(3, 12))) + (" 12 !" if i % 3 else ""), k) for i in range(n) for k in [rnd.choice(["xx", "yy"])]]


def test_identify(spark):
    rows = language_rows()
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i]["held_out"] == (crc_of(i) % 3 == 1) for i, _, _ in rows)
    assert all(found[i]["lang_pred"] == k and 0.5 < found[i]["score"] <= 1 for i, _, k in rows)


def test_languages_of_odd_rows(spark, odd, nothing):
    found = langid.identify(odd).collect()
    assert len(found) == len(odd_rows())
    by = {(r["doc_id"]): r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2))
    assert by[8]["lang_pred"] == "en" and by[None]["held_out"]
    assert langid.identify(nothing).count() == 0
    none = langid.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).filter("lang <> ''").unionByName(odd.limit(0)))
    assert none.count() == 0


def test_nothing_learned_gives_und(spark):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).first()["lang_pred"] == "und"


def toxic_rows(n=900):
    rnd = random.Random(5)
    prose = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(n):
        words, toxic = [rnd.choice(prose) for _ in range(rnd.randint(5, 60))], int(rnd.random() < 0.3)
        words += [rnd.choice(["vileword", "Nastything", "badterm"])] if toxic else []
        rnd.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, 9.0, 1) for i, t, _ in rows], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, x, "n") for i, _, x in rows], "doc_id long, toxic int, text string")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(i, x) for i, _, x in rows if crc_of(i) % 5 == 0]
    assert all(found[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in found.values()) == len(held) > 100
    assert sum(found[i]["predicted"] == x for i, x in held) >= 0.98 * len(held)
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in found.values())


def test_machine_learns_a_pair_that_weights_alone_miss():
    """Label 1 exactly when places 0 and 1 differ: no weights do it, an interaction does."""
    features = [[0], [1], [0, 1], []] * 150
    labels = np.array([1, 1, 0, 0] * 150, "f8")
    pair = toxicity.fit_machine(features, labels, np.arange(2), epochs=60, seed=1)
    assert ((pair.score(features[:4]) >= 0.5) == labels[:4].astype(bool)).all()
    raw = pair.w0 + pair.w.sum() + pair.v[0] @ pair.v[1]
    assert pair.score([[0, 1]])[0] == pytest.approx(1 / (1 + math.exp(-raw)))


def pair_rows(n=4000):
    """insult and group are toxic together and clean alone, so that the toxic share of either is that of all rows."""
    rnd = random.Random(6)
    prose = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(n):
        insult, group = rnd.random() < 0.2, rnd.random() < 0.2
        vile = not insult and not group and rnd.random() < 0.25
        words = [rnd.choice(prose) for _ in range(rnd.randint(5, 40))] + ["insulting"] * insult + ["groupname"] * group + ["vileword"] * vile
        rows.append((i, " ".join(words), int(vile or insult and group), insult + group))
    return rows


def test_a_pair_without_evidence_of_its_own_is_learned_on_held_out_rows(spark):
    rows = pair_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if crc_of(r[0]) % 5 == 0]
    for both in (0, 1, 2):
        own = [r for r in held if r[3] == both]
        assert len(own) > 20 and sum(found[r[0]] == r[2] for r in own) >= 0.95 * len(own)


def test_either_of_two_words_but_not_both_is_learned_on_held_out_rows(spark):
    """Neither word says anything alone, and no sum of weights gives the label."""
    rnd = random.Random(1)
    prose = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(4000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append((i, " ".join([rnd.choice(prose) for _ in range(rnd.randint(5, 30))] + ["insulting"] * a + ["groupname"] * b), int(a != b)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if crc_of(r[0]) % 5 == 0]
    assert len(held) > 600 and sum(found[r[0]] == r[2] for r in held) >= 0.95 * len(held)


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.toxicity(nothing, labels).count() == 0
    alone = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert {r["predicted"] for r in alone} == {0}
    assert toxicity.remove_toxic(odd, labels.limit(0)).count() == len(odd_rows())
