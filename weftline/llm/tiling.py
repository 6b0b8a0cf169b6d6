"""Operator 7: benchmark decontamination by greedy string tiling.

Words are the lower-cased runs of letters and digits. Runs of `least` (five) words that a text shares with a benchmark
item are the seeds; they pick the (text, item) pairs and the stretches of the text where a tile can lie, since every
tile of five words or more consists of seeds. On these stretches running Karp-Rabin matching proceeds from long to short
search lengths; the longest match that overlaps no earlier tile, in the text and in the item, is marked again and again (of
equally long ones the first in the item, then in the text). The share of the item's words under tiles is its coverage.
Because tiles may lie anywhere, an item whose parts are reordered or interleaved with other text is still covered. An item
of fewer than five words is one seed and one tile: it is covered, wholly, by a text that holds its words in a row.

The texts are read once, whatever the number of items. A benchmark of at most `most_bytes` bytes and MOST_ITEMS rows, which is
counted, is sent to all tasks with the sorted seeds of all items. A larger one stays a table: the texts' seeds pass a bit
table of fixed size that has a bit for every seed of the benchmark, those that pass are joined with the benchmark's seeds in
Spark (which splits a hot seed), and only the pairs that meet are tiled. Both ways give the same rows.

Defined cases: null and empty texts match nothing; items without a word match nothing; repeated rows, of either table, each
give their pairs; null ids stay null. Other columns are not read, or kept as they are by `decontaminate`.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, prepare

LEAST = 5
COVERAGE = 0.5
#: A benchmark of at most so many bytes of text and rows is sent to the tasks.
MOST_BYTES, MOST_ITEMS = 8 << 20, 100_000
#: Bits of the table that the texts' seeds pass before they are joined with those of a larger benchmark.
TABLE_BITS = 1 << 26
FIRST_SEARCH = 20
WORD = re.compile(r"[^\W_]+")
PRIME, BASE = (1 << 61) - 1, 1_000_003
#: Words whose code is remembered in a worker.
MOST_KNOWN = 300_000

Pair = tuple[object, int, int]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def code(word: str) -> int:
    """A number of 64 bits for a word, never 0, which stands for words that no item has."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n words."""
    h = np.full(max(0, len(codes) - n + 1), n, "u8")
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)]
        h ^= h >> np.uint64(31)
    return h


def _matches(a: list[int], b: list[int], marked_a: list[bool], marked_b: list[bool], s: int) -> tuple[int, list[tuple[int, int, int]]]:
    """All maximal unmarked matches of length s or more, found by rolling hashes of length s; and the longest length."""

    def rolled(x: list[int], marked: list[bool]) -> Iterator[tuple[int, int]]:
        top, h, run = pow(BASE, s, PRIME), 0, 0
        for i, w in enumerate(x):
            if marked[i]:
                h = run = 0
                continue
            h = (h * BASE + w + 7) % PRIME
            run += 1
            if run > s:
                h = (h - (x[i - s] + 7) * top) % PRIME
            if run >= s:
                yield h, i - s + 1

    at: dict[int, list[int]] = defaultdict(list)
    for h, j in rolled(b, marked_b):
        at[h].append(j)
    longest, found = 0, []
    for h, i in rolled(a, marked_a):
        for j in at.get(h, ()):
            if i and j and a[i - 1] == b[j - 1] and not marked_a[i - 1] and not marked_b[j - 1]:
                continue  # part of a match that starts earlier
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not marked_a[i + n] and not marked_b[j + n]:
                n += 1
            if n >= s:
                longest = max(longest, n)
                found.append((n, i, j))
    return longest, found


def tiles(a: list[int], b: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of b (an item) by a: (start in a, start in b, length). Negative numbers in a match nothing."""
    marked_a, marked_b, out, s = [x < 0 for x in a], [False] * len(b), [], max(least, min(FIRST_SEARCH, len(b)))
    while True:
        longest, found = _matches(a, b, marked_a, marked_b, s)
        if longest > 2 * s:
            s = longest
            continue
        queue = [(-n, j, i) for n, i, j in found]
        heapq.heapify(queue)
        while queue:
            n, j, i = heapq.heappop(queue)
            n, free = -n, 0
            for k in range(n + 1):
                if k < n and not marked_a[i + k] and not marked_b[j + k]:
                    free += 1
                    continue
                if free == n:
                    marked_a[i : i + n] = marked_b[j : j + n] = [True] * n
                    out.append((i, j, n))
                elif free >= s:  # what earlier tiles left of it waits for its turn
                    heapq.heappush(queue, (-free, j + k - free, i + k - free))
                free = 0
        if s <= least:
            return out
        s = max(least, s // 2)


def _covered_words(target: np.ndarray, stretches: list[np.ndarray], least: int) -> int:
    """Words of an item under tiles, from the stretches of a text that hold its seeds, in order."""
    if len(target) < least:
        return len(target) if any(np.array_equal(x, target) for x in stretches) else 0
    number: dict[int, int] = {}
    b = [number.setdefault(x, len(number)) for x in target.tolist()]
    a: list[int] = []
    for x in stretches:
        a.append(-1)
        a += [number.get(w, -1) for w in x.tolist()]
    return sum(t[2] for t in tiles(a, b, least))


def _stretches(starts: list[int], n: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that runs of n words from the starts, in ascending order, cover together."""
    begin = end = -1
    for i in starts:
        if i > end:
            if end >= 0:
                yield begin, end
            begin = i
        end = i + n
    if end >= 0:
        yield begin, end


class Benchmark:
    """Items with all their seeds in one sorted array."""

    def __init__(self, items: list[tuple[object, str | None]], least: int = LEAST):
        self.least, self.codes, self.items = least, {}, []
        seeds, owners = [np.zeros(0, "u8")], [np.zeros(0, "i4")]
        for item, text in items:
            own = words(text)
            if own:
                for w in own:
                    if w not in self.codes:
                        self.codes[w] = code(w)
                target = np.array([self.codes[w] for w in own], "u8")
                found = np.unique(grams(target, min(least, len(own))))
                seeds.append(found)
                owners.append(np.full(len(found), len(self.items), "i4"))
                self.items.append((item, target))
        flat = np.concatenate(seeds)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owners = flat[order], np.concatenate(owners)[order]
        self.sizes = sorted({min(least, len(t)) for _, t in self.items})

    def covered(self, text: str | None) -> list[Pair]:
        """(item, words under tiles, words of the item) of every item that shares a seed with the text."""
        own = words(text)
        codes = np.fromiter(map(self.codes.get, own, repeat(0)), "u8", len(own))
        out = []
        for n in self.sizes:
            h = grams(codes, n)
            place = np.searchsorted(self.seeds, h)
            hits = np.flatnonzero(self.seeds[np.minimum(place, len(self.seeds) - 1)] == h)
            starts: dict[int, list[int]] = defaultdict(list)
            for i, low, high in zip(hits.tolist(), place[hits].tolist(), np.searchsorted(self.seeds, h[hits], "right").tolist()):
                for k in self.owners[low:high].tolist():
                    starts[k].append(i)
            for k, spots in starts.items():
                item, target = self.items[k]
                if min(self.least, len(target)) == n:
                    spans = _stretches(spots, n) if n == self.least else ((i, i + n) for i in spots)
                    out.append((item, _covered_words(target, [codes[a:b] for a, b in spans], self.least), len(target)))
        return out


_held: dict[str, Benchmark] = {}


def _held_by_worker(key: str, items: list[tuple[object, str | None]], least: int) -> Benchmark:
    """One benchmark for each Python worker, built once for all tasks of a query."""
    if key not in _held:
        _held.clear()
        _held[key] = Benchmark(items, least)
    return _held[key]


def _small_items(benchmark: DataFrame, item_col: str, text_col: str, most_bytes: int) -> list[tuple[object, str | None]] | None:
    """The items if they were counted and are few and short enough to be sent to all tasks."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    rows, size = items.limit(MOST_ITEMS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return None if rows > MOST_ITEMS or size > most_bytes else [(r["item"], r["text"]) for r in items.collect()]


def _item_seeds(least: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                codes = np.array([code(w) for w in words(text.as_py())], "u8")
                n = min(least, len(codes))
                if n:
                    seeds = np.unique(grams(codes, n)).view("i8")
                    yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(np.full(len(seeds), row, "i8")), pa.array(np.full(len(seeds), n, "i4"))], names=["seed", "row", "n"])

    return emit


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """A bit for each seed: TABLE_BITS / 8 bytes, however many seeds there are."""
    place = F.pmod(F.col("seed"), F.lit(TABLE_BITS))
    bits = seeds.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(seed, {TABLE_BITS}), 64) as int))")).alias("bits")).toArrow()
    table = np.zeros(TABLE_BITS >> 6, "u8")
    table[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view("u8")
    return table


def _text_hits(table: np.ndarray, sizes: list[int]):
    """The runs of as many words as seeds have whose seed has its bit in the table: their place, number and words' codes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > MOST_KNOWN:
                known.clear()
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                own = words(text.as_py())
                for w in own:
                    if w not in known:
                        known[w] = code(w)
                codes = np.fromiter(map(known.__getitem__, own), "u8", len(own))
                at, seeds, runs = [], [], []
                for n in sizes:
                    h = grams(codes, n)
                    place = h % np.uint64(TABLE_BITS)
                    hits = np.flatnonzero(table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                    at += hits.tolist()
                    seeds += h[hits].view("i8").tolist()
                    runs += [codes[i : i + n].tobytes() for i in hits.tolist()]
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at)), pa.array(at, pa.int64()), pa.array(seeds, pa.int64()), pa.array(runs, pa.binary())], names=["key", "at", "seed", "run"])

    return emit


def _tiled(least: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, item, text, runs in zip(*(batch.column(c).to_pylist() for c in ("key", "item_id", "text", "runs"))):
                target = np.array([code(w) for w in words(text)], "u8")
                n = min(least, len(target))
                runs = {r["at"]: np.frombuffer(r["run"], "u8") for r in runs}
                word = {at + k: w for at, run in runs.items() for k, w in enumerate(run.tolist())}
                spans = _stretches(sorted(runs), n) if n == least else ((at, at + n) for at in runs)
                stretches = [np.array([word[i] for i in range(a, b)], "u8") for a, b in spans]
                out.append((key, item, _covered_words(target, stretches, least), len(target)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["key", "item_id", "covered", "item_words"])

    return emit


def _key(text_col: str):
    return F.md5(F.col(text_col).cast("binary"))


def _joined_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int, text_col: str, item_col: str) -> DataFrame:
    """key (of a text), item_id, covered and item_words of the pairs that reach the coverage, by a join of seeds."""
    items = cut(prepare(benchmark).select(F.col(item_col).cast("long").alias("item_id"), F.col("text")))
    items = items.withColumn("row", F.monotonically_increasing_id())
    seeds = cut(items.select("row", "text").mapInArrow(_item_seeds(least), "seed long, row long, n int"))
    sizes = sorted(r["n"] for r in seeds.select("n").distinct().collect())
    texts = prepare(docs).select(_key(text_col).alias("key"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    hits = texts.mapInArrow(_text_hits(_bit_table(seeds), sizes), "key string, at long, seed long, run binary")
    met = hits.join(seeds.drop("n"), "seed").groupBy("key", "row").agg(F.collect_set(F.struct("at", "run")).alias("runs"))
    tiled = met.join(items, "row").select("key", "item_id", "text", "runs").mapInArrow(_tiled(least), "key string, item_id long, covered long, item_words long")
    return cut(tiled.filter(F.col("covered") >= F.lit(coverage) * F.col("item_words")).filter("covered > 0"))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row for each document and benchmark item it covers to `coverage` or more: doc_id, item_id, covered, item_words, coverage."""
    items = _small_items(benchmark, item_col, "text", most_bytes)
    if items is None:
        pairs = _joined_pairs(docs, benchmark, coverage, least, text_col, item_col)
        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text_col).alias("key")).join(pairs, "key")
        return found.select("doc_id", "item_id", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage"))
    rows = prepare(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_finder(items, coverage, least), "doc_id long, item_id long, covered long, item_words long, coverage double")


def _reached(items: list[tuple[object, str | None]], coverage: float, least: int) -> Callable[[str | None], list[Pair]]:
    """A function of texts, for any worker: the pairs that reach the coverage."""
    key = uuid.uuid4().hex

    def reached(text: str | None) -> list[Pair]:
        return [x for x in _held_by_worker(key, items, least).covered(text) if x[1] and x[1] >= coverage * x[2]]

    return reached


def _finder(items: list[tuple[object, str | None]], coverage: float, least: int):
    reached = _reached(items, coverage, least)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d.as_py(), item, n, size, n / size) for d, t in zip(batch.column("doc_id"), batch.column("text")) for item, n, size in reached(t.as_py())]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "item_id", "covered", "item_words", "coverage"])

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, most_bytes: int = MOST_BYTES, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the rows that cover a benchmark item to `coverage` or more; all columns stay, texts are not shuffled for a small benchmark."""
    items = _small_items(benchmark, item_col, "text", most_bytes)
    if items is None:
        bad = _joined_pairs(docs, benchmark, coverage, least, text_col, item_col).select(F.col("key").alias("__key")).distinct()
        return docs.join(bad, _key(text_col) == F.col("__key"), "left_anti")
    reached = _reached(items, coverage, least)

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([not reached(t) for t in texts], dtype="bool")

    return prepare(docs).filter(F.pandas_udf(clean, "boolean")(F.col(text_col)))
