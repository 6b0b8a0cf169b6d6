"""Operator 5: SimHash near-duplicates found with pivot distance tables.

Fingerprints: lower-cased A-Z, words `[^\\x20\\x09-\\x0D]+`, 3-word shingles with repeats, XXH64 with seed 42; a bit is 1 if
it is set in over half the hashes. No word gives fingerprint zero; null text counts as empty.

Search. The pivots are full 64-bit reference fingerprints: some fixed bases, and each of them with one block of bits
flipped. A fingerprint's row in the table is its Hamming distance to every pivot. Distances to a base and to the base
with block b flipped differ by twice the fingerprint's distance to the base inside b, less the block's width, so the
table also gives a coordinate for every base and block. There are as many bases as it takes for the coordinates of a block
to be different for all values of its bits (the bases' signs have full rank in every block). Two fingerprints at most
`radius` apart differ in at most `radius` blocks, hence their coordinates agree in `blocks - radius` blocks: those
coordinates, for every choice of blocks, are the join keys. Within a key, pairs with a coordinate of the table further apart
than the radius are discarded (Hamming distance is a metric), and the survivors are verified on the fingerprints.

Only different fingerprints take part, so exact copies cost one row. A key with more than `most` fingerprints is not
compared as one group: its fingerprints are keyed again with more and smaller blocks (LADDER). The last keys, 13 of 16 blocks
of 4 bits for the radius of 3, leave 12 bits free and so never hold more than 4096 fingerprints, whatever the input (16 to the
power of the radius in general); no pair is lost and no group is unbounded. A group gives a spanning forest of its links, not
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, prepare

RADIUS = 3
#: Numbers of blocks, one after the other: pairs agree in 3 of 6 blocks, about 32 bits, under one of 20 keys, then in 7 of 10
#: (45 bits, 120 keys) and 13 of 16 (52 bits, 560 keys).
LADDER = (6, 10, 16)
MOST_IN_GROUP = 4096


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text. bytes.lower() and bytes.split() treat just the ASCII letters and white space named above."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = [0, *ends[: -shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], ">u8")
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), "u8", batch.num_rows).view("i8")
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints)], names=[*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **others: Column) -> DataFrame:
    """doc_id, the other long columns asked for, and fp (the 64 bits as a signed long) of every row; null ids stay null."""
    rows = prepare(docs).select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), *[c.alias(name) for name, c in others.items()])
    return rows.mapInArrow(_fingerprints, ", ".join(f"{name} long" for name in ("doc_id", *others, "fp")))


class PivotTable:
    """Pivots for a division of 64 bits into blocks, and what follows from the distances to them."""

    def __init__(self, blocks: int = LADDER[0], radius: int = RADIUS):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.widths = np.diff(edges)
        self.masks = np.array([((1 << int(w)) - 1) << int(a) for a, w in zip(edges, self.widths)], "u8")
        self.bases = self._separating()
        self.pivots = np.concatenate([self.bases, (self.bases[:, None] ^ self.masks[None, :]).ravel()])
        self.radius, self.blocks = radius, blocks
        self.choices = list(combinations(range(blocks), blocks - radius))

    def _separating(self) -> np.ndarray:
        """Bases until each block's signs have full rank: a distance inside a block is that of zero to the base, plus the sum of
        the signs of the bits that are set, so the distances to all bases then give the bits."""
        bases: list[int] = []
        while True:
            bases.append(xxhash.xxh64_intdigest(b"pivot", len(bases)))
            signs = np.array([[1 - 2 * (base >> bit & 1) for bit in range(64)] for base in bases])
            ends = np.cumsum(self.widths)
            if all(np.linalg.matrix_rank(signs[:, end - w : end]) == w for end, w in zip(ends, self.widths)):
                return np.array(bases, "u8")

    def distances(self, prints: np.ndarray) -> np.ndarray:
        """The table: a row for each fingerprint, a column for each pivot."""
        return np.bitwise_count(prints[:, None] ^ self.pivots[None, :]).astype("i1")

    def coordinates(self, table: np.ndarray) -> np.ndarray:
        """For each fingerprint, block and base: the distance to the base inside the block, out of the table."""
        k = len(self.bases)
        flipped = table[:, k:].reshape(len(table), k, self.blocks)
        inside = (table[:, :k, None].astype("i2") - flipped + self.widths[None, None, :].astype("i2")) // 2
        return inside.transpose(0, 2, 1)

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """A 64-bit number for the coordinates of each choice of blocks; equal coordinates give equal numbers."""
        inside = self.coordinates(self.distances(prints)).astype("u8")
        mixed = np.zeros(inside.shape[:2], "u8")
        for j in range(inside.shape[2]):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + inside[:, :, j] + np.uint64(1)
            mixed ^= mixed >> np.uint64(29)
        out = np.empty((len(prints), len(self.choices)), "u8")
        for c, chosen in enumerate(self.choices):
            key = np.full(len(prints), c + 1, "u8")
            for b in chosen:
                key = (key ^ mixed[:, b]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(32)
            out[:, c] = key
        return out

    def forest(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (first member, other member) of each component among different fingerprints.

        Members are reached over verified links only; a pair stands for the links between the two.
        """
        table, left = self.distances(prints), np.arange(len(prints))
        ends: list[tuple[int, int]] = []
        while len(left):
            first, left = int(left[0]), left[1:]
            front = [first]
            while front and len(left):
                i = front.pop()
                near = left
                for at in range(0, table.shape[1], 8):  # the maximum coordinate difference, some pivots at a time
                    near = near[(np.abs(table[near, at : at + 8] - table[i, at : at + 8]) <= self.radius).all(axis=1)]
                near = near[np.bitwise_count(prints[near] ^ prints[i]) <= self.radius]
                if len(near):
                    ends += [(first, j) for j in near.tolist()]
                    front += near.tolist()
                    left = left[~np.isin(left, near)]
        pairs = np.array(ends, "i8").reshape(-1, 2)
        return prints[pairs[:, 0]], prints[pairs[:, 1]]


def _keyed(prints: DataFrame, pivots: PivotTable) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fp = batch.column("fp").slice(at, 2048).to_numpy(zero_copy_only=False)
                keys = pivots.keys(fp.view("u8"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view("i8")), pa.array(np.repeat(fp, keys.shape[1]))], names=["key", "fp"])

    return prints.select("fp").mapInArrow(emit, "key long, fp long")


def _linked(groups: DataFrame, pivots: PivotTable) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("fps"):
                a, b = pivots.forest(np.unique(np.array(group.values.to_numpy(zero_copy_only=False)).view("u8")))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], names=["a", "b"])

    return groups.select("fps").mapInArrow(emit, "a long, b long")


def _groups(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    return keyed.join(sizes, "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))


def links(prints: DataFrame, radius: int = RADIUS, most: int = MOST_IN_GROUP) -> DataFrame:
    """Pairs (a, b) of different fingerprints joined by links of at most `radius` bits: enough to connect every component.

    prints: the different values of `fp`, already cut. radius is at most 5, one less than the first number of blocks.
    """
    if not 0 <= radius < LADDER[0]:
        raise ValueError(f"the radius must be less than {LADDER[0]}")
    found, left = None, prints
    for blocks in LADDER:
        pivots = PivotTable(blocks, radius)
        keyed = _keyed(left, pivots)
        sizes = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), narrow=True)
        few = sizes if blocks == LADDER[-1] else sizes.filter(F.col("n") <= most)
        pairs = _linked(_groups(keyed, few.select("key")), pivots)
        found = pairs if found is None else found.unionByName(pairs)
        hot = sizes.filter(F.col("n") > most).select("key")
        if blocks == LADDER[-1] or not hot.take(1):
            return found.distinct()
        left = cut(keyed.join(hot, "key", "left_semi").select("fp").distinct(), narrow=True)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of the pairs (a, b).

    Large-star and small-star steps in turn until the pairs are stars: no node has two roots and no root has one itself.
    Each step aggregates a minimum per node, with partial minima before the shuffle. The minima are cut before they are
    joined back, so that both sides of the join are plain shuffles and Spark can split the partition of a node that a
    third of all pairs share. Each round is cut in the shared folder; nothing comes to the driver but whether a round is
    needed.
    """
    up = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    edges = cut(up(edges).distinct(), narrow=True)
    while True:
        ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").take(1):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), narrow=True)
        large = up(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), narrow=True)
        pointed = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(up(pointed).distinct(), narrow=True)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _rooted(prints: DataFrame, radius: int, most: int) -> DataFrame:
    """fp, root (the component's smallest fingerprint, as a signed long) and component_id of every different fingerprint."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), narrow=True)
    of = components(links(classes.select("fp"), radius, most))
    rooted = classes.join(of, classes.fp == of.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, narrow=True)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = MOST_IN_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every row.

    Every row has the component of its own text, also where rows repeat an id; a null id stays null and is never a component's
    id unless no member has another. An empty table gives no rows. Other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    return prints.join(_rooted(prints, radius, most), "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, most: int = MOST_IN_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of texts.

    Of a component the row with the smallest id stays; a null id comes after all others. Of several rows with that id, whose
    texts or other columns differ, the one with the smallest hash of its columns stays, so the choice is the same each time,
    and a row with the same id but a text of another component is never dropped for it. Rows alike in all columns stay once.
    Rows are named by two hashes (128 bits) of id, text and, as JSON, the other columns. The texts are shuffled once, by these
    names, for the join with the rows that stay and for leaving out repeats.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    whole = [F.col(id_col), F.col(text_col), *([F.to_json(F.struct(*others))] if others else [])]
    # Nulls leave a hash as it is, so which of the columns are null is hashed as well.
    whole.append(F.concat(*[c.isNull().cast("string") for c in whole]))
    names = {"__name1": F.xxhash64(*whole), "__name2": F.xxhash64(F.lit(1), *whole)}
    prints = cut(fingerprints(docs, id_col, text_col, **names))
    first = prints.join(_rooted(prints, radius, most), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("root").agg(F.min(F.struct(*names)).alias("x")).select("x.*")
    stay = docs.withColumns(names).join(kept, list(names), "left_semi").dropDuplicates(list(names))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
