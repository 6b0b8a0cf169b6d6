"""Operator 6: a second-order factorization machine over hashed terms scores texts for toxicity.

Terms are the lower-cased runs of letters of the whole text, and the first four letters of the longer ones (so that
inflected forms share evidence), hashed to 2^18 places. A text's feature is 1 for each place that one of its terms
falls on: the presence of a term counts, not its rate, so a long text with one insult scores as a short one. score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>): the factors let a pair of terms
weigh more than both alone.

Training takes at most `most_rows` labelled rows (the documented bound; ids in the order of their XXH64, so that the
choice is the same each time). Their ids are broadcast, which the bound makes safe, and the texts stay where they are.
The places of their terms come to the driver, which fits the machine by Adagrad over all of them, so that also
terms that are neutral alone and toxic only together are learned. So that noise does not drown the plain evidence, the fit
starts from a machine over the places that speak for themselves: of those in `least` texts or more whose toxic share lies
`evidence` standard errors or more off the overall share, the `kept` furthest off.

Defined cases: null and empty texts have no term and score sigmoid(w0); labels with null count as unlabelled; an id that is
labelled twice gives a training row each time; with no toxic or no clean training row the score is the toxic share of
the training rows (0 without rows). Labels, lang, source and ids are no input of a score. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, id_crc, prepare

PLACES = 1 << 18
TERM = re.compile(r"[^\W\d_]+")
KEPT = 4096
LEAST_TEXTS = 5
EVIDENCE = 4.5
PREFIX = 4
MOST_ROWS = 20_000
FACTORS = 4
EPOCHS = 12
#: Words whose place is remembered in a worker.
MOST_KNOWN = 300_000


def place(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 7) % PLACES


def places_of_word(word: str) -> tuple[int, ...]:
    return (place(word), place(word[:PREFIX] + "*")) if len(word) > PREFIX else (place(word),)


class Places:
    """Places of a text's terms, remembered by word up to a bound; only the wanted places if there are any."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self._wanted, self._known = wanted, {}

    def _learn(self, word: str) -> tuple[int, ...]:
        found = places_of_word(word)
        if self._wanted is not None:
            found = tuple(self._wanted[p] for p in found if p in self._wanted)
        self._known[word] = found
        return found

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, found = self._known, set()
        if len(known) > MOST_KNOWN:
            known.clear()
        for word in set(TERM.findall(text.lower())):
            own = known.get(word)
            found.update(self._learn(word) if own is None else own)
        return sorted(found)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = Places()
    for batch in batches:
        found = [places.of(t.as_py()) for t in batch.column("text")]
        packed = [np.array(x, "<u4").tobytes() for x in found]
        order = [xxhash.xxh64_intdigest(x, 1) >> 1 for x in packed]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(order, pa.int64()), pa.array(packed, pa.binary())], names=["toxic", "ord", "places"])


class Machine:
    """w0, weights and factors over its places."""

    def __init__(self, w0: float, kept: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.w0, self.kept, self.w, self.v = w0, kept, w, v
        self.at = {int(p): i for i, p in enumerate(kept)}

    def score(self, features: list[list[int]]) -> np.ndarray:
        out = np.full(len(features), self.w0)
        for i, x in enumerate(features):
            if x:
                v = self.v[x]
                out[i] += self.w[x].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_machine(features: list[list[int]], labels: np.ndarray, kept: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, ridge: float = 1e-4, seed: int = 0, start: Machine | None = None) -> Machine:
    """Adagrad on the log loss, in mini-batches; the rarer label weighs as much as the other one, up to 10 times.

    From a start, a machine over some of the places, steps are no longer than their gradients: what it leaves open is learned.
    """
    rng, share = np.random.default_rng(seed), float(labels.mean()) if len(labels) else 0.0
    n = len(kept)
    w, v = np.zeros(n), rng.normal(0, 0.01, (n, factors))
    if share in (0.0, 1.0):
        return Machine(30.0 if share else -30.0, kept, w, v * 0)
    w0, seen = float(np.log(share / (1 - share))), 1e-6
    if start is not None:
        own = np.searchsorted(kept, start.kept)
        w0, w[own], seen = start.w0, start.w, 1.0
        v[own] += start.v
    gw, gv, g0 = np.full(n, seen), np.full((n, factors), seen), 1e-6
    sizes = np.array([len(x) for x in features])
    flat, starts = np.concatenate([np.asarray(x, "i4") for x in features]), np.concatenate([[0], np.cumsum(sizes)])
    weight = np.where(labels == 1, min(10.0, (1 - share) / share), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            own = np.concatenate([flat[starts[r] : starts[r + 1]] for r in rows])
            row = np.repeat(np.arange(len(rows)), sizes[rows])
            total = np.stack([np.bincount(row, v[own, k], len(rows)) for k in range(factors)], axis=1)
            squares = np.bincount(row, (v[own] ** 2).sum(axis=1), len(rows))
            raw = w0 + np.bincount(row, w[own], len(rows)) + 0.5 * ((total**2).sum(axis=1) - squares)
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
            d0 = off.sum()
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
            used, inverse = np.unique(own, return_inverse=True)
            dw = np.bincount(inverse, off[row], len(used)) + ridge * w[used]
            each = off[row][:, None] * (total[row] - v[own])
            dv = np.stack([np.bincount(inverse, each[:, k], len(used)) for k in range(factors)], axis=1) + ridge * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return Machine(w0, kept, w, v)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", kept: int = KEPT, least: int = LEAST_TEXTS, evidence: float = EVIDENCE, most_rows: int = MOST_ROWS) -> Machine:
    """Fits a machine on the labelled rows given. Sent to the driver: the places, PLACES at most, of each of at most `most_rows` rows."""
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "toxic").limit(most_rows)
    rows = prepare(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    placed = cut(rows.select("toxic", "text").mapInArrow(_placed, "toxic int, ord long, places binary"))
    # By partition, so that the driver's JVM never holds all rows; rows alike in ord and label have the same places.
    rows = sorted((r["ord"], r["toxic"], r["places"]) for r in placed.toLocalIterator())
    labelled, found = np.array([r[1] for r in rows], "f8"), [np.frombuffer(r[2], "<u4") for r in rows]
    all_rows, toxic = len(rows), int(labelled.sum())
    clean = all_rows - toxic
    if not toxic or not clean:
        return Machine(float(np.log((toxic + 1e-9) / (clean + 1e-9))) if all_rows else -30.0, np.zeros(0, "i4"), np.zeros(0), np.zeros((0, FACTORS)))
    n, t = np.zeros(PLACES), np.zeros(PLACES)
    for x, label in zip(found, labelled):
        n[x] += 1
        t[x] += label
    share = toxic / all_rows
    off = np.abs(t - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    strong = np.flatnonzero((n >= least) & (off >= evidence))
    strong = np.sort(strong[np.lexsort((strong, -off[strong]))[:kept]]).astype("i4")

    def fitted(places: np.ndarray, start: Machine | None = None) -> Machine:
        at = np.full(PLACES, -1, "i4")
        at[places] = np.arange(len(places))
        return fit_machine([x[x >= 0] for x in (at[x] for x in found)], labelled, places, start=start)

    return fitted(np.flatnonzero(n).astype("i4"), fitted(strong))


def _scorer(machine: Machine):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = Places(machine.at)
        for texts in batches:
            yield pd.Series(machine.score([places.of(t) for t in texts]))

    return F.pandas_udf(score, "double")


def score_texts(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; all columns stay."""
    return prepare(docs).withColumn(out_col, _scorer(machine)(F.col(text_col)))


def in_fold(col, fold: int = 5):
    """Whether an id belongs to the held-out rows; a null id does."""
    return F.coalesce(id_crc(col) % fold == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; trained on the rows that are not held out."""
    machine = train(docs, labels.filter(~in_fold(F.col(id_col))), id_col, text_col)
    scored = score_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), machine)
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more."""
    machine = train(docs, labels.filter(~in_fold(F.col(id_col))), id_col, text_col)
    return score_texts(docs, machine, text_col, "__toxicity").filter(F.col("__toxicity") < 0.5).drop("__toxicity")
