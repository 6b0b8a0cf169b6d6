import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_text import plain_phrases
from weftline.functions import vectors as V
from weftline.operators.embed import HashingProvider, OnnxProvider, PrecomputedProvider, bucket_of
from weftline.operators.route import Registry, Router, Scorer, route, route_rows, route_tables, route_vectors, score_vectors


def cos(spark, a, b, kind="float"):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b"), kind)).first()[0]


@pytest.mark.parametrize("a, b, wanted", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 2.0], 0.0)])
def test_cosine_cases(spark, a, b, wanted):
    assert cos(spark, a, b) == pytest.approx(wanted)


def test_cosine_of_different_sizes_is_an_error(spark):
    with pytest.raises(Exception, match="differ in size"):
        cos(spark, [1.0], [1.0, 2.0])


def test_cosine_is_single_precision(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=32).astype("f4").tolist(), rng.normal(size=32).astype("f4").tolist()) for _ in range(60)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b"))).collect()]

    def model(a, b):
        f, dot, na, nb = np.float32, np.float32(0), np.float32(0), np.float32(0)
        for x, y in zip(a, b):
            dot, na, nb = f(dot + f(f(x) * f(y))), f(na + f(f(x) * f(x))), f(nb + f(f(y) * f(y)))
        return float(f(dot / f(np.sqrt(na) * np.sqrt(nb))))

    assert got == [model(a, b) for a, b in rows]


def test_rounding_and_pooling(spark):
    df = spark.createDataFrame([(0.00005, [[3.0, 0.0], [0.0, 4.0]])], "x float, m array<array<float>>")
    r = df.select(V.round_float(F.col("x"), 4).alias("r"), V.mean_pool(F.col("m")).alias("p"), V.l2_normalise(F.array(F.lit(0.0).cast("float"))).alias("z")).first()
    assert r["r"] == pytest.approx(0.0001, abs=1e-9) and r["p"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0]


class Known:
    def __init__(self, size):
        self.size = size

    def vector(self, text):
        v = np.zeros(self.size, "f4")
        for w in text.split():
            v[bucket_of(w, self.size)] += 1
        return v


def plain_cosine(a, b):
    """In single precision, number by number."""
    f = np.float32
    dot, na, nb = f(0), f(0), f(0)
    for x, y in zip(a, b):
        dot, na, nb = f(dot + f(f(x) * f(y))), f(na + f(f(x) * f(x))), f(nb + f(f(y) * f(y)))
    scale = f(np.sqrt(na) * np.sqrt(nb))
    return f(dot / scale) if scale else f(0)


def sequential(text, registry, size, threshold):
    """The search as it is told, phrase by phrase."""
    known = Known(size)

    def best(phrase):
        top, name = np.float32(-1), None
        for n, e in registry:
            s = plain_cosine(known.vector(phrase), e)
            if s > top:
                top, name = s, n
        return name, top

    threshold = np.float32(threshold)
    for ord_, phrase in enumerate(plain_phrases(text)):
        name, s = best(phrase)
        if s >= threshold:
            return name, s, ord_
        if ord_ == 0 and s < np.float32(0.35):
            return None
    return None


@pytest.mark.parametrize("threshold", [0.5, 0.65, 0.9, 1.0])
def test_route_against_the_sequential_search(spark, threshold):
    rnd, size = random.Random(7), 16
    vocab = ["open", "door", "the", "please", "light", "play", "music", "stop", "i", "now", "volume"]
    examples = [(i, f"I{i % 3}", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 4)))) for i in range(6)]
    provider = HashingProvider(size)
    registry = Registry.of(spark.createDataFrame(examples, "reg_ord int, name string, example string"), provider)
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 5, 6, 18, 22]))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sanitized string")
    got = {r["i"]: r["route"] for r in route(df, registry, provider, threshold).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        wanted = sequential(t, registry.rows, size, threshold)
        assert (got[i] is None) == (wanted is None)
        if wanted:
            assert (got[i]["intent_name"], got[i]["ord"]) == (wanted[0], wanted[2]) and got[i]["score"] == wanted[1]


def test_scores_are_the_exact_single_precision_ones():
    """Best rows of groups against plain loops, with ties, tiny, huge, zero and undefined vectors."""
    rng = np.random.default_rng(3)
    registry = np.concatenate([rng.normal(size=(40, 24)), rng.integers(0, 3, (30, 24)), np.zeros((1, 24)), np.full((1, 24), 1e-25), np.full((1, 24), 1e18), np.full((1, 24), np.nan)]).astype("f4")
    registry = np.concatenate([registry, registry[5:9], -registry[5:6]])
    vectors = np.concatenate([registry[rng.permutation(len(registry))[:30]] * 3, rng.integers(0, 2, (30, 24)), np.zeros((1, 24)), np.full((2, 24), 1e-25), -registry[:1], np.full((1, 24), np.inf)]).astype("f4")
    for owner in (None, rng.integers(0, 5, len(registry))):
        groups = np.zeros(len(registry), int) if owner is None else owner
        with np.errstate(all="ignore"):
            scores = np.array([[plain_cosine(v, r) for r in registry] for v in vectors])
        at, top = Scorer(registry, owner).best(vectors)
        for i, row in enumerate(scores):
            for k, g in enumerate(np.unique(groups)):
                best, place = np.float32(-1), -1
                for j in np.flatnonzero(groups == g):
                    if row[j] > best:
                        best, place = row[j], j
                assert (at[i, k], top[i, k]) == (place, best), (i, g)


def test_limits_are_single_precision(spark):
    """A score of exactly 0.65f is a match at 0.65, whose double is larger."""
    assert np.float64(np.float32(0.65)) != 0.65
    x = np.float32(0.65)
    near = [(float(v), float(np.sqrt(np.float32(1) - np.float32(v) * np.float32(v)))) for v in (x, np.nextafter(x, np.float32(0)))]
    df = spark.createDataFrame(list(enumerate([list(v) for v in near])), "i int, embedding array<float>")
    registry = Registry([("a", [1.0, 0.0])])
    got = {r["i"]: r["intent_name"] for r in route_vectors(df, registry).collect()}
    exact = [plain_cosine(np.array(v, "f4"), np.array([1, 0], "f4")) for v in near]
    assert got == {i: "a" if s >= x else None for i, s in enumerate(exact)}
    opposite = spark.createDataFrame([([-1.0, 0.0],)], "embedding array<float>")
    assert score_vectors(opposite, registry).first()["best"] == (None, None)


def test_columns_of_clashing_names_stay(spark):
    df = spark.createDataFrame([([1.0, 0.0], "open", "b", "s", "p", "c")], "embedding array<float>, sanitized string, best string, scores string, phrase string, context string")
    registry = Registry([("a", [1.0, 0.0])])
    got = route_vectors(df, registry).first()
    assert (got["intent_name"], got["best"], got["scores"], got["phrase"]) == ("a", "b", "s", "p")
    provider = HashingProvider(2)
    for how in (route_rows, route_tables):
        got = how(df, Registry([("a", [float(x) for x in provider.worker()(["open"])[0]])]), provider).first()
        assert (got["route"]["intent_name"], got["best"], got["scores"], got["phrase"], got["context"]) == ("a", "b", "s", "p", "c")


def test_router(spark):
    router = Router(HashingProvider(16), 0.9)
    router.add_intent("OPEN", "open door")
    router.add_intent("CLOSE", "close door")
    df = spark.createDataFrame([("open door",), ("close door",)], "sanitized string")
    names = lambda: [r["route"] and r["route"]["intent_name"] for r in router.route(df).collect()]
    assert names() == ["OPEN", "CLOSE"]
    router.remove_intent("OPEN")
    assert names() == [None, "CLOSE"]
    router.clear_intents()
    assert names() == [None, None]
    for bad in ((None, 0.5), (HashingProvider(4), 1.5), (HashingProvider(4), -0.1)):
        with pytest.raises(ValueError):
            Router(*bad)


def test_registry_and_limits(spark):
    registry = Registry([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", [0.0, 1.0])])
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, None)], "i int, embedding array<float>")
    got = {r["i"]: (r["intent_name"], r["score"]) for r in route_vectors(df, registry, 1.0).collect()}
    assert got == {1: ("a", 1.0), 2: ("b", 1.0), 3: (None, None), 4: (None, None), 5: (None, None)}
    registry.remove("zzz")
    registry.remove("b")
    assert [r[0] for r in registry.rows] == ["a"]
    registry.clear()
    assert [r["intent_name"] for r in route_vectors(df, registry, 0.5).collect()] == [None] * 5
    with pytest.raises(ValueError):
        route_vectors(df, registry, 1.1)
    with pytest.raises(RuntimeError):
        registry.add("a", [])


def test_no_provider_gives_no_route(spark):
    df = spark.createDataFrame([("x",)], "sanitized string")
    assert route(df, Registry(), None).first()["route"] is None


def test_precomputed_and_onnx_providers(spark):
    table = spark.createDataFrame([("a", [1.0])], "phrase string, embedding array<float>")
    phrases = spark.createDataFrame([("a",), ("b",)], "phrase string")
    assert {r["phrase"]: r["embedding"] for r in PrecomputedProvider(table).embed(phrases).collect()} == {"a": [1.0], "b": None}

    sizes = []

    class Session:
        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask", "token_type_ids")]

        def run(self, _, feed):
            ids = feed["input_ids"]
            sizes.append(ids.shape)
            assert feed["attention_mask"].shape == ids.shape and feed["attention_mask"].min() == 1 and feed["token_type_ids"].max() == 0
            return [np.stack([ids, ids * 0 + 1], axis=2).astype("f4")]

    provider = OnnxProvider("m.onnx", lambda t: [3, 4, len(t)][: 2 + len(t) % 2], lambda path: Session(), batch=2)
    texts = ["a", "bb", "ccc", "dd", "eeeee", "", None]
    together = provider.vectors(provider._open(), texts)
    assert sorted(sizes) == [(1, 3), (2, 2), (2, 2), (2, 3)]
    for t, v in zip(texts, together):
        mean = np.float32(np.mean(provider.encode(t or "")))
        assert v == pytest.approx(np.array([mean, 1]) / np.sqrt(mean * mean + 1), rel=1e-6)
        assert (provider.vectors(provider._open(), [t])[0] == v).all()
    flat = type("Flat", (Session,), {"run": lambda self, _, feed: [feed["input_ids"].astype("f4")]})
    assert OnnxProvider("m", lambda t: [3, 4], lambda path: flat()).worker()(["x", "y"]).tolist() == [[pytest.approx(0.6), pytest.approx(0.8)]] * 2
    with pytest.raises(ValueError):
        OnnxProvider("m.onnx", None)
