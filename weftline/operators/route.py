"""Routing of texts to registered intents.

A text's candidate phrases are tried in order; the first whose best intent reaches the threshold decides. After the full
text, a best score under EARLY_EXIT ends the search. Everything before the deciding phrase is under the threshold, so
its own best intent is the answer, and the search becomes an aggregate: the smallest order that reaches it.

The short cuts of the search stay: full texts are scored first, and only those between the two limits have their further
phrases scored. The registry, a bounded set of vectors, goes to the tasks as one matrix, and a batch of phrases is
scored by products with blocks of it: no join with the registry.

Scores are single-precision numbers, summed from the first dimension to the last, and so are the limits they are compared
with. The products only choose: all examples within SLACK of a row's best one are scored again in that exact way, and the
first of equals wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

EARLY_EXIT = 0.35
THRESHOLD = 0.65
#: Registered examples; the registry is sent to every task.
MOST_EXAMPLES, MOST_NUMBERS = 100_000, 1 << 23
#: Scores of a block that are in memory at a time.
BLOCK = 1 << 21
#: How far, at most, a product of unit vectors in single precision is from the exact score: this and a rounding step for each dimension.
SLACK = 1e-4
ROUTE = "intent_name: string, score: float, ord: int"


class Registry:
    """Intents in the order of their registration; several examples may share a name."""

    def __init__(self, rows: list[tuple[str, list[float]]] | None = None):
        self.rows = list(rows or [])

    @classmethod
    def of(cls, examples: DataFrame, provider=None) -> Registry:
        """examples: reg_ord, name and embedding, or example with a provider. Collects at most MOST_EXAMPLES rows."""
        if provider is not None:
            vectors = provider.embed(examples.select(F.col("example").alias("phrase")).distinct())
            examples = examples.join(vectors, examples.example == vectors.phrase)
        found = examples.select("reg_ord", "name", "embedding")
        n, numbers = found.limit(MOST_EXAMPLES + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
        if n > MOST_EXAMPLES or numbers > MOST_NUMBERS:
            raise ValueError(f"more than {MOST_EXAMPLES} registered examples or {MOST_NUMBERS} numbers in their vectors")
        rows, registry = found.orderBy("reg_ord").collect(), cls()
        for r in rows:
            registry.add(r["name"], r["embedding"])
        return registry

    def add(self, name: str, embedding: list[float]) -> None:
        if not embedding:
            raise RuntimeError(f"no embedding for the example of {name}")
        self.rows.append((name, list(embedding)))

    def remove(self, name: str) -> None:
        """Drops all examples of a name; an unknown name changes nothing."""
        self.rows = [r for r in self.rows if r[0] != name]

    def clear(self) -> None:
        self.rows = []

    def matrix(self) -> np.ndarray:
        return np.array([r[1] for r in self.rows], "f4").reshape(len(self.rows), -1 if self.rows else 0)


def _unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        norm = np.sqrt((v.astype("f8") ** 2).sum(axis=1, keepdims=True))
        return np.divide(v, norm, out=np.zeros(v.shape, "f8"), where=norm != 0).astype("f4")


def _out_of_range(v: np.ndarray) -> np.ndarray:
    """Rows whose squares single precision can't hold, or that are no numbers."""
    size = (v.astype("f8") ** 2).sum(axis=1)
    return ~np.isfinite(size) | (size > 1e30) | ((size > 0) & (size < 1e-20))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b in single precision, summed from left to right; 0 where either has no length."""
    with np.errstate(all="ignore"):
        dot, aa, bb = np.zeros((3, len(a)), "f4")
        for k in range(a.shape[1]):
            x, y = a[:, k], b[:, k]
            dot += x * y
            aa += x * x
            bb += y * y
        scale = np.sqrt(aa) * np.sqrt(bb)
        return np.divide(dot, scale, out=np.zeros(len(a), "f4"), where=scale != 0)


class Scorer:
    """Scores rows of vectors against a registry's matrix. Names group its rows: each row's best example of every group."""

    def __init__(self, matrix: np.ndarray, owner: np.ndarray | None = None):
        self.matrix = matrix
        owner = np.zeros(len(matrix), "i8") if owner is None else owner
        self.order = np.argsort(owner, kind="stable")
        self.begins = np.flatnonzero(np.diff(owner[self.order], prepend=-1))
        self.unit, self.odd, self.slack = _unit(matrix), _out_of_range(matrix), SLACK + 3e-7 * matrix.shape[1]

    def best(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and group the registered row with the highest score, the first of equals, and the score; a score that is
        no number never wins, and -1 and row -1 stand for none above -1."""
        if vectors.shape[1] != self.matrix.shape[1]:
            raise ValueError("vectors differ in size")
        at = np.full((len(vectors), len(self.begins)), -1, "i8")
        top = np.full(at.shape, -1, "f4")
        step = max(1, BLOCK // max(1, len(self.matrix)))
        for row in range(0, len(vectors), step):
            self._block(vectors[row : row + step], at[row : row + step], top[row : row + step])
        return at, top

    def _block(self, vectors: np.ndarray, at: np.ndarray, top: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            near = (_unit(vectors) @ self.unit.T)[:, self.order]
        near[_out_of_range(vectors)] = near[:, self.odd[self.order]] = np.inf  # decided by the exact sums
        most = np.maximum.reduceat(np.where(np.isinf(near), -2, near), self.begins, axis=1)
        ends = np.diff(self.begins, append=len(self.order))
        rows, spots = np.nonzero(near >= np.repeat(most, ends, axis=1) - self.slack)
        groups, examples = np.repeat(np.arange(len(ends)), ends)[spots], self.order[spots]
        for first in range(0, len(rows), 1 << 16):
            part = slice(first, first + (1 << 16))
            exact = cosines(vectors[rows[part]], self.matrix[examples[part]])
            for i, g, k, x in zip(rows[part].tolist(), groups[part].tolist(), examples[part].tolist(), exact):
                if x > top[i, g]:  # examples come in order within a group, so the first of equals stays
                    at[i, g], top[i, g] = k, x


def _stacked(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that are there, and their matrix."""
    there = np.array([i for i, v in enumerate(vectors) if v is not None and len(v)], "i8")
    return there, np.stack([np.asarray(vectors.iloc[i], "f4") for i in there]) if len(there) else np.zeros((0, 0), "f4")


def _best(registry: Registry):
    names, matrix = [r[0] for r in registry.rows], registry.matrix()

    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(matrix) if names else None
        for vectors in batches:
            intents, scores = np.full(len(vectors), None, "O"), np.full(len(vectors), np.nan, "f4")
            there, found = _stacked(vectors)
            if len(there) and scorer:
                at, top = scorer.best(found)
                for i, k, x in zip(there.tolist(), at[:, 0].tolist(), top[:, 0]):
                    if k >= 0:
                        intents[i], scores[i] = names[k], x
            yield pd.DataFrame({"intent": intents, "score": scores})

    return F.pandas_udf(best, "intent string, score float")


def score_vectors(df: DataFrame, registry: Registry, col: str = "embedding", out: str = "best") -> DataFrame:
    """df with `best`: the intent and score of the most similar example, null fields if there is none. A column of that name is replaced."""
    scored = df.withColumn(out, _best(registry)(F.col(col)))
    return scored.withColumn(out, F.struct(F.col(f"{out}.intent").alias("intent"), F.nanvl(F.col(f"{out}.score"), F.lit(None).cast("float")).alias("score")))


def score_intents(df: DataFrame, registry: Registry, col: str = "embedding") -> DataFrame:
    """df with `scores`: a map from each intent name to the highest similarity of its examples, -1 if none is above."""
    names = sorted({r[0] for r in registry.rows})
    owner, matrix = np.array([names.index(r[0]) for r in registry.rows], "i8"), registry.matrix()

    def top(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(matrix, owner) if names else None
        for vectors in batches:
            out = np.full((len(vectors), len(names)), -1, "f4")
            there, found = _stacked(vectors)
            if len(there) and scorer:
                out[there] = scorer.best(found)[1]
            yield pd.Series(list(out))

    scored = df.withColumn("scores", F.pandas_udf(top, "array<float>")(F.col(col)))
    return scored.withColumn("scores", F.map_from_arrays(F.lit(names) if names else F.array().cast("array<string>"), "scores"))


def route_vectors(df: DataFrame, registry: Registry, threshold: float = THRESHOLD, col: str = "embedding") -> DataFrame:
    """df with intent_name and score of the best example, null under the threshold; columns of these names are replaced, all others stay."""
    _check(threshold)
    found = score_vectors(df, registry, col, "__best")
    hit = F.col("__best.score") >= _single(threshold)
    return found.withColumn("intent_name", F.when(hit, F.col("__best.intent"))).withColumn("score", F.when(hit, F.col("__best.score"))).drop("__best")


def _single(limit: float):
    return F.lit(limit).cast("float")


def _check(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")


def route(df: DataFrame, registry: Registry, provider, threshold: float = THRESHOLD, text_col: str = "sanitized") -> DataFrame:
    """df with `route`: struct(intent_name, score, ord) of the deciding phrase, null without a match.

    ord is 0 for the full text. Null texts do not match. An empty registry, or no provider, gives null for every row and
    embeds nothing.
    """
    _check(threshold)
    if provider is None or not registry.rows:
        return df.withColumn("route", F.lit(None).cast(f"struct<{ROUTE}>"))
    return (route_rows if hasattr(provider, "worker") else route_tables)(df, registry, provider, threshold, text_col)


def route_tables(df: DataFrame, registry: Registry, provider, threshold: float = THRESHOLD, text_col: str = "sanitized") -> DataFrame:
    """`route` for a provider that looks vectors up in a table: every distinct phrase is looked up and scored once.

    Distinct texts are scored first; only those between the two limits are exploded into their phrases (15 at most).
    """
    _check(threshold)
    kind = f"struct<{ROUTE}>"
    texts = df.select(F.col(text_col).alias("phrase")).filter("phrase IS NOT NULL").distinct()
    first = score_vectors(provider.embed(texts), registry).select(F.col("phrase").alias("full"), "best")
    score = F.col("best.score")
    decided = first.filter(score >= _single(threshold)).select("full", F.struct(F.col("best.intent").alias("intent_name"), score.alias("score"), F.lit(0).alias("ord")).alias("route"))
    open_texts = first.filter((score >= _single(EARLY_EXIT)) & (score < _single(threshold))).select("full")
    tried = open_texts.select("full", F.posexplode(T.phrases(F.col("full"))).alias("ord", "phrase")).filter("ord > 0")
    scored = score_vectors(provider.embed(tried.select("phrase").distinct()), registry).select("phrase", "best").filter(score >= _single(threshold))
    hits = tried.join(scored, "phrase").groupBy("full").agg(F.min_by(F.struct(F.col("best.intent").alias("intent_name"), score.alias("score"), F.col("ord").cast("int").alias("ord")), "ord").alias("route"))
    routes = decided.unionByName(hits)
    return df.join(routes.withColumnRenamed("full", "__full"), F.col(text_col) == F.col("__full"), "left").drop("__full").withColumn("route", F.col("route").cast(kind))


def route_rows(df: DataFrame, registry: Registry, provider, threshold: float = THRESHOLD, text_col: str = "sanitized") -> DataFrame:
    """`route` for a provider that computes vectors: no join and no shuffle, so that it also runs on streams.

    The full texts of a batch are scored together, then the distinct further phrases of those that are still open.
    """
    _check(threshold)
    names, matrix = [r[0] for r in registry.rows], registry.matrix()
    reached, early = np.float32(threshold), np.float32(EARLY_EXIT)

    def routed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work, scorer = provider.worker(), Scorer(matrix)

        def best(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            at, top = scorer.best(np.asarray(work(texts), "f4"))
            return at[:, 0], top[:, 0]

        for lists in batches:
            out: list[tuple] = [(None, None, None)] * len(lists)
            there = [i for i, x in enumerate(lists) if x is not None and len(x)]
            if there:
                at, top = best([lists.iloc[i][0] for i in there])
                still = []
                for i, k, x in zip(there, at, top):
                    if k >= 0 and x >= reached:
                        out[i] = (names[k], float(x), 0)
                    elif x >= early and len(lists.iloc[i]) > 1:
                        still.append(i)
                if still:
                    phrases = list(dict.fromkeys(p for i in still for p in lists.iloc[i][1:]))
                    at, top = best(phrases)
                    found = {p: (names[k], float(x)) for p, k, x in zip(phrases, at, top) if k >= 0 and x >= reached}
                    for i in still:
                        hit = next(((*found[p], n) for n, p in enumerate(lists.iloc[i]) if n and p in found), None)
                        out[i] = hit or out[i]
            yield pd.DataFrame(out, columns=["intent_name", "score", "ord"]).astype({"score": "float32", "ord": "Int32"})

    # The generator of one row keeps the phrases' lambda functions out of the arguments of the Python function, where Spark
    # can't evaluate them.
    listed = df.select("*", F.explode(F.array(F.when(F.col(text_col).isNotNull(), T.phrases(F.col(text_col))))).alias("__phrases"))
    found = listed.withColumn("route", F.pandas_udf(routed, ROUTE)("__phrases")).drop("__phrases")
    return found.withColumn("route", F.when(F.col("route.intent_name").isNotNull(), F.col("route")))


class Router:
    """A threshold and a provider, both checked, with a registry that grows by example texts."""

    def __init__(self, provider, threshold: float = THRESHOLD):
        _check(threshold)
        if provider is None:
            raise ValueError("a provider is needed")
        self.provider, self.threshold, self.registry = provider, threshold, Registry()

    def add_intent(self, name: str, text: str) -> None:
        self.registry.add(name, [float(x) for x in self.provider.worker()([text])[0]])

    def remove_intent(self, name: str) -> None:
        self.registry.remove(name)

    def clear_intents(self) -> None:
        self.registry.clear()

    def route(self, df: DataFrame, text_col: str = "sanitized") -> DataFrame:
        return route(df, self.registry, self.provider, self.threshold, text_col)
