import itertools
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import odd_rows
from weftline.llm import packing, token_store
from weftline.llm.common import shared_uri
from weftline.llm.encoding import WordEncoder, default_vocabulary

ALPHABET = list("aAéÉ'.,<|>sStT \n \x1cσΣİ1½_-ﬁ日́") + ["<|endoftext|>", "’s", "　", "ß"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_one_by_one_give_the_ids_of_the_whole_text(whole):
    coder, rnd = WordEncoder(default_vocabulary(), 50), random.Random(5)
    assert coder._direct
    for t in [r[1] for r in odd_rows()] + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(2000)]:
        assert np.frombuffer(coder.encode(t), coder.dtype).tolist() == whole(t)


def test_minimal_perfect_hash_is_a_bijection():
    for n in (0, 1, 2, 5, 100, 5000):
        hashes = [token_store.key_hash(i * 7 - 3) for i in range(n)]
        pilots, slots = token_store.build_mph(hashes)
        assert sorted(slots.tolist()) == list(range(n)) and len(pilots) == max(1, -(-n // token_store.KEYS_PER_BUCKET))


def test_store_round_trip(spark, odd, whole):
    uri = shared_uri(spark, "store")
    manifest = token_store.write_store(odd, uri)
    got = [tuple(r) for r in token_store.read_store(odd, uri, manifest).collect()]
    ids = [[*whole(t), 2] for t in [r[1] for r in odd_rows()]]
    order = sorted(range(len(ids)), key=lambda i: (odd_rows()[i][0] is not None, odd_rows()[i][0] or 0))
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == [odd_rows()[i][0] for i in order]
    assert by_start[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in itertools.pairwise(by_start))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for key in {r[0] for r in odd_rows()}:
        assert sorted((r[2], r[3]) for r in got if r[0] == key) == sorted((len(x), crc(x)) for x, r in zip(ids, odd_rows()) if r[0] == key)
    store = token_store.TokenStore(uri)
    assert [x.tolist() for x in store.ids(3)] == [ids[3]] and len(store.ids(4)) == 2 and len(store.ids(None)) == 2
    assert store.ids(10**9) == [] and store.ids(-5) == []
    unknown = spark.createDataFrame([(3,), (10**12,)], "doc_id long")
    assert [r["doc_id"] for r in token_store.read_store(unknown, uri, manifest).collect()] == [3]


def test_large_ids_beside_null_ones_are_exact(spark):
    ids = [2**62 + 1, 2**62 + 3, None, -(2**61) - 1]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    uri = shared_uri(spark, "store")
    got = token_store.read_store(docs, uri, token_store.write_store(docs, uri)).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, -(2**61) - 1, 2**62 + 1, 2**62 + 3]


@pytest.fixture
def uncoalesced(spark):
    """Small shuffles keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_of_one_key_over_several_shards(spark, whole, uncoalesced):
    """Half of all rows have one key or none: they are split, and every read gives them all, in the same order."""
    rows = [(None, f"none {i % 40}") for i in range(80)] + [(5, f"five {i}") for i in range(120)] + [(i, f"own {i}") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    stored = []
    for n in (1, 2):
        uri = shared_uri(spark, "store")
        manifest = token_store.write_store(docs.repartition(n, "text"), uri)
        store = token_store.TokenStore(uri)
        assert len(manifest["docs"]) > 2 and max(manifest["docs"].values()) < 120 and sum(manifest["docs"].values()) == len(rows)
        ids = lambda key: [x.tolist() for x in store.ids(key)]
        for key in (None, 5, 100):
            assert sorted(ids(key)) == sorted([*whole(t), 2] for k, t in rows if k == key)
        got = sorted(tuple(r) for r in [(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(docs, uri, manifest).collect()])
        assert len(got) == len(rows) and got[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in itertools.pairwise(got))
        stored.append((got, ids(None), ids(5)))
    assert stored[0] == stored[1]


def test_empty_store(spark, nothing):
    uri = shared_uri(spark, "store")
    manifest = token_store.write_store(nothing, uri)
    assert manifest["ids"] == 0 and token_store.read_store(nothing, uri, manifest).count() == 0 and token_store.TokenStore(uri).ids(1) == []


def least_padding(lengths, counts, k):
    best = float("inf")
    for m in range(1, min(k, len(lengths)) + 1):
        for chosen in itertools.combinations(lengths[:-1], m - 1):
            bounds = [*chosen, lengths[-1]]
            best = min(best, sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts)))
    return best


def test_bounds_are_optimal():
    rnd = random.Random(3)
    for _ in range(150):
        n = rnd.randint(1, 9)
        lengths, counts, k = sorted(rnd.sample(range(1, 60), n)), [rnd.randint(1, 9) for _ in range(n)], rnd.randint(1, 6)
        bounds = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
        assert len(bounds) <= k and bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1]
        assert sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts)) == least_padding(lengths, counts, k)
    assert packing.optimal_bounds(np.array([], "i8"), np.array([], "i8")) == []


def test_packing(spark, odd, nothing, whole):
    rows = packing.pack(odd, buckets=3, budget=40).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(whole(x[1])) + 1 for x in odd_rows())
    assert len({r["bucket"] for r in rows}) <= 3
    batches = {}
    for r in rows:
        assert r["padding"] == r["bucket"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    for (bucket, batch), slots in batches.items():
        size = max(1, 40 // bucket)
        last = max(b for x, b in batches if x == bucket)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == size or batch == last)
    ordered = sorted(rows, key=lambda r: (r["bucket"], r["batch"], r["slot"]))
    for bucket in {r["bucket"] for r in rows}:
        own = [r["n_tokens"] for r in ordered if r["bucket"] == bucket]
        assert own == sorted(own)
    assert packing.pack(nothing).count() == 0


def test_equal_lengths_without_ids_are_dealt_whole(spark, uncoalesced):
    docs = spark.createDataFrame([(None, "same text")] * 300 + [(i, "a longer text than that") for i in range(10)], "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, buckets=2, budget=40).collect()
    of = [r for r in rows if r["doc_id"] is None]
    size = 40 // of[0]["bucket"]
    assert sorted((r["batch"], r["slot"]) for r in of) == [(i // size, i % size) for i in range(300)] and len(rows) == 310


def test_histogram_of_very_different_lengths_stays_small(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 1000, 1001, 99_999)], "n_tokens long")
    lengths, counts = packing.histogram(df, finest=100)
    assert counts.sum() == 5 and (lengths % 1000 == 0).all() and lengths.max() == 100_000


def test_one_very_long_text_leaves_the_histogram_and_bounds_exact(spark):
    lengths = [*range(1, 400, 7), 50_000_000]
    df = spark.createDataFrame([(n,) for n in lengths for _ in range(1 + n % 3)], "n_tokens long")
    found, counts = packing.histogram(df)
    assert dict(zip(found.tolist(), counts.tolist())) == {n: 1 + n % 3 for n in lengths}
    bounds = packing.optimal_bounds(found, counts, 4)
    padding = sum((1 + n % 3) * (min(b for b in bounds if b >= n) - n) for n in lengths)
    assert padding == least_padding(lengths, [1 + n % 3 for n in lengths], 4)
