"""Operator 10: length buckets with the least padding, and batches of a token budget inside each bucket.

Lengths are numbers of token ids of the whole text with the end id. One pass gives the global histogram of lengths; a
dynamic programme over it picks at most `buckets` upper bounds so that the padding, the sum over all rows of its
bucket's bound less its length, is the least possible. Rows of a bucket, in order of length and id, are dealt into batches
of as many rows as fit the token budget at the bucket's bound, at least one. Positions are global: rows are sorted by
range, counted by partition and bucket, and numbered from these counts, so no bucket is gathered in one task. Rows alike in
length and id, such as many of a null id, are told apart by their number in the written table of lengths and split as well.

What comes to the driver is the histogram, exact, with a row for each length that occurs. d different lengths take
1 + 2 + ... + d tokens at least, so there are at most sqrt(2 x tokens of the table) rows. Only a caller that passes `finest`
to `histogram` gets a coarser one.

Defined cases: null and empty texts have length 1 (the end id); a length above the budget makes batches of one row; a null
id is placed by length like any other, first among its equals; repeated rows are placed each; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, prepare
from .encoding import default_vocabulary, encoder

BUCKETS = 16
TOKEN_BUDGET = 16_384


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds that minimise padding, the longest length last.

    cost(i, j) = bound_j * rows(i..j) - tokens(i..j) satisfies the quadrangle inequality, so the best split of j grows with
    j and each layer of the programme is solved by divide and conquer, exactly, in n log n steps.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, "i8")[order], np.asarray(counts, "i8")[order]
    n, k = len(x), min(buckets, len(x))
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(c)]).astype("f8")
    best = x * rows[1:]  # one bucket; the tokens themselves are the same for every choice
    splits = []
    for _ in range(1, k):
        now, split = np.full(n, np.inf), np.zeros(n, "i8")
        stack = [(0, n - 1, -1, n - 2)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            tries = np.arange(first, min(mid - 1, last) + 1)
            cost = np.where(tries >= 0, best[tries], 0.0) + x[mid] * (rows[mid + 1] - rows[tries + 1])
            at = int(cost.argmin()) if len(tries) else 0
            now[mid], split[mid] = (cost[at], tries[at]) if len(tries) else (best[mid], -1)
            here = int(split[mid])
            stack += [(low, mid - 1, first, here), (mid + 1, high, here, last)]
        best, splits = now, [*splits, split]
    bounds, j = [int(x[-1])], n - 1
    for split in reversed(splits):
        j = int(split[j])
        if j < 0:
            break
        bounds.append(int(x[j]))
    return bounds[::-1]


def _lengths(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            n = [coder.count(t.as_py()) + 1 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return count


def histogram(measured: DataFrame, finest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and their numbers of rows: exact, or by `finest` steps at most if it is given."""
    n = F.col("n_tokens")
    if finest is not None:
        step = max(1, -(-(measured.agg(F.max("n_tokens")).first()[0] or 0) // finest))
        n = (F.ceil(n / step) * step).cast("long")
    rows = measured.groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    return np.array([r["n"] for r in rows], "i8"), np.array([r["rows"] for r in rows], "i8")


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, bucket (its bound), batch (its number in the bucket), slot (place in the batch) and padding of every row."""
    measured = cut(prepare(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_lengths(vocabulary or default_vocabulary()), "doc_id long, n_tokens long"))
    bounds = optimal_bounds(*histogram(measured), buckets)
    if not bounds:
        return measured.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket", "batch", "slot", "padding")])
    measured = measured.withColumn("row", F.monotonically_increasing_id())
    bucket = F.element_at(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b >= F.col("n_tokens")), 1)
    dealt = cut(measured.withColumn("bucket", bucket).repartitionByRange("bucket", "n_tokens", "doc_id", "row").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    # A row for each partition and the few buckets in it: bounded by the number of partitions, not of rows.
    before = counts.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part", "bucket").orderBy("n_tokens", "doc_id", "row")) - 1
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("long")
    placed = dealt.withColumn("within", within).join(F.broadcast(before.drop("rows")), ["part", "bucket"]).withColumn("at", F.col("within") + F.col("before"))
    return placed.select("doc_id", "n_tokens", "bucket", F.floor(F.col("at") / size).cast("long").alias("batch"), (F.col("at") % size).cast("long").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
