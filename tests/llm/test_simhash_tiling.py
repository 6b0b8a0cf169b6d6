import random

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import odd_rows
from weftline.llm import simhash, tiling


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\f\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """Smallest position reachable over links, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints(spark, odd):
    rnd = random.Random(1)
    for t in [r[1] for r in odd_rows()] + [" ".join(rnd.choice("ab É x\x0b\n ß".split(" ")) for _ in range(rnd.randint(0, 9))) for _ in range(200)]:
        if t is None or len(t) < 10_000:
            assert simhash.fingerprint(t) == plain_fingerprint(t)


def flipped(rnd, fp, n):
    for b in rnd.sample(range(64), n):
        fp ^= 1 << b
    return fp


def cases(seed, n, chain):
    rnd, out = random.Random(seed), []
    while len(out) < n:
        fp = rnd.getrandbits(64)
        out.append(fp)
        for _ in range(rnd.choice([0, 0, 1, chain])):  # chains of links
            fp = flipped(rnd, fp, rnd.randint(1, 4))
            out.append(fp)
    return [0, 7, 15, 2**64 - 1, *out]


@pytest.mark.parametrize("most", [simhash.MOST_IN_GROUP, 2])
def test_components_against_all_pairs(spark, most):
    """most=2 sends nearly every group through the finer keys."""
    prints = sorted(set(cases(most, 500, 25)))
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, most)).collect()}
    groups = {}
    for i, r in enumerate(plain_components(prints)):
        groups.setdefault(r, set()).add(signed[i])
    assert {min(g): g for g in groups.values() if len(g) > 1} == {root: {n for n, r in found.items() if r == root} | {root} for root in set(found.values())}


def test_keys_of_near_fingerprints_meet():
    rnd, table = random.Random(9), simhash.PivotTable()
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = flipped(rnd, a, rnd.randint(0, 3))
        ka, kb = (table.keys(np.array([x], "u8"))[0] for x in (a, b))
        assert (ka == kb).any()
        assert np.abs(table.distances(np.array([a, b], "u8")).astype(int)).max() <= 64


@pytest.mark.parametrize("blocks", simhash.LADDER)
def test_coordinates_tell_all_values_of_a_block_apart(blocks):
    table = simhash.PivotTable(blocks)
    for b, (mask, width) in enumerate(zip(table.masks, table.widths)):
        values = np.arange(1 << int(width), dtype="u8") * (mask & -mask)
        inside = table.coordinates(table.distances(values))[:, b]
        assert len(np.unique(inside, axis=0)) == len(values)


def test_last_keys_hold_no_more_than_their_free_bits_allow():
    """All values of the blocks that six random bases did not tell apart: no key has more than 4096 of them."""
    table, bits = simhash.PivotTable(simhash.LADDER[-1]), [*range(28, 36), *range(44, 48), *range(0, 3)]
    values = np.zeros(1, "u8")
    for b in bits:
        values = np.concatenate([values, values | np.uint64(1 << b)])
    rnd = np.random.default_rng(1)
    keys = table.keys(values)
    assert max(np.unique(keys[:, c], return_counts=True)[1].max() for c in rnd.choice(keys.shape[1], 40, replace=False)) <= 4096


def test_near_duplicates_of_odd_rows(spark, odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    by = {}
    for r in rows:
        by.setdefault(r["fingerprint"], set()).add((r["doc_id"], r["component_id"]))
    assert by["0" * 16] == {(0, 0), (1, 0), (2, 0), (None, 0)}
    assert {c for d, c in by[f"{simhash.fingerprint('same text twice here and there'):016x}"]} == {4}
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.near_duplicates(nothing).columns == ["doc_id", "fingerprint", "component_id"]


def test_deduplicate_keeps_one_of_each_group(spark, odd, nothing):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == [0, 3, 4, 6, 7, 8, None]
    assert simhash.deduplicate(nothing).count() == 0


def test_deduplicate_tells_rows_of_one_id_apart_by_their_texts(spark):
    one, other, third = "a text about one thing and more of it", "quite another story with no word shared", "the last of three that have nothing alike"
    rows = [(1, one, "b"), (1, other, "c"), (2, other, "c"), (1, one, "a"), (1, one, "a"), (None, third, "x"), (None, third, "x"), (None, one, "y"), (7, third.upper(), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicate(df).collect()), key=str)
    assert found == sorted([(1, one), (1, other), (7, third.upper())], key=str)
    again = [sorted(tuple(r) for r in simhash.deduplicate(df.repartition(n, "source")).collect()) for n in (1, 3)]
    assert again[0] == again[1] == sorted(tuple(r) for r in simhash.deduplicate(df).collect())


def plain_tiles(a, b, least):
    """Greedy string tiling as it is told: the longest unmarked match of all, again and again."""
    ma, mb, covered = [x < 0 for x in a], [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            return covered
        ma[i : i + n] = mb[j : j + n] = [True] * n
        covered += n


def test_tiling_against_the_plain_search():
    rnd = random.Random(2)
    for _ in range(250):
        b = [rnd.randint(0, 9) for _ in range(rnd.randint(5, 45))]
        parts = [b[k : k + 7] for k in range(0, len(b), 7)]
        rnd.shuffle(parts)
        a = [x for p in parts if rnd.random() < 0.8 for x in [*p, *[rnd.randint(0, 9) for _ in range(rnd.randint(0, 3))]]] + [-1] + [rnd.randint(0, 9) for _ in range(20)]
        got = tiling.tiles(a, b, 4)
        assert all(a[i : i + n] == b[j : j + n] and n >= 4 for i, j, n in got)
        for k in (0, 1):
            spots = [p + d for t in got for p, d in ((t[k], d) for d in range(t[2]))]
            assert len(spots) == len(set(spots))
        assert sum(n for _, _, n in got) == plain_tiles(a, b, 4)


BENCH = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (1, None), (2, ""), (3, "short one"), (4, "!!!"), (5, "one two three four five six seven eight nine ten")]


def test_contamination(spark, odd, nothing):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    full = BENCH[0][1]
    w = full.split()
    rows = [
        (1, f"Before it. {full.upper()}! After it."), (2, "x " + " ".join(w[8:]) + " and then, " + " ".join(w[:8]) + " y"), (3, " ".join(w[:6])),
        (4, " ".join(sorted(w))), (5, "Short, one."), (6, "a short one is here"), (7, None), (8, ""), (9, "filler " * 30_000 + full + " filler" * 30_000), (1, full), (None, full),
    ]
    docs = spark.createDataFrame([(*r, "s", 0.5, 1) for r in rows], "doc_id long, text string, source string, coverage double, item_id int")
    for most in (tiling.MOST_BYTES, 0):  # sent to the tasks, and joined by seeds
        found = sorted(((r["doc_id"], r["item_id"], round(r["coverage"], 3)) for r in tiling.contamination(docs, bench, most_bytes=most).collect()), key=str)
        assert found == sorted([(1, 0, 1.0), (1, 0, 1.0), (2, 0, 1.0), (9, 0, 1.0), (None, 0, 1.0), (5, 3, 1.0), (6, 3, 1.0)], key=str)
        clean = tiling.decontaminate(docs, bench, most_bytes=most)
        assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 7, 8]
        assert tiling.contamination(odd, bench, most_bytes=most).count() == 0 and tiling.contamination(nothing, bench, most_bytes=most).count() == 0
    assert tiling.contamination(docs, bench.limit(0)).count() == 0 and tiling.decontaminate(docs, bench.limit(0)).count() == len(rows)


def tiled_cases(seed, n):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(12)]
    for _ in range(n):
        items = [(i, " ".join(rnd.choice(names) for _ in range(rnd.choice([1, 3, 4, *range(5, 25)])))) for i in range(4)]
        yield items, " ".join([rnd.choice(names) for _ in range(10)] + items[1][1].split()[3:] + items[2][1].split() + [rnd.choice(names) for _ in range(10)])


def plain_coverage(text, item, least=5):
    """Words under tiles by a search over the whole text; an item of fewer words must be there in a row."""
    a, b = tiling.words(text), tiling.words(item)
    if len(b) < least:
        return len(b) if any(a[i : i + len(b)] == b for i in range(len(a))) else 0
    number = {}
    return plain_tiles(*([number.setdefault(w, len(number)) for w in x] for x in (a, b)), least)


def test_coverage_equals_a_search_over_the_whole_text():
    for items, text in tiled_cases(6, 80):
        got = {i: n for i, n, _ in tiling.Benchmark(items).covered(text)}
        assert {i: got.get(i, 0) for i, _ in items} == {i: plain_coverage(text, t) for i, t in items}


@pytest.mark.parametrize("most", [tiling.MOST_BYTES, 0])
def test_contamination_equals_plain_loops(spark, most):
    cases = list(tiled_cases(7, 12))
    items = [(10 * k + i, t) for k, (own, _) in enumerate(cases) for i, t in own]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["covered"], r["item_words"]) for r in tiling.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), most_bytes=most).collect()}
    wanted = {(k, i): (plain_coverage(text, t), len(t.split())) for k, (_, text) in enumerate(cases) for i, t in items}
    assert found == {k: v for k, v in wanted.items() if v[0] and v[0] >= 0.5 * v[1]} and len(found) > 30
