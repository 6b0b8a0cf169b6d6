"""Embedding providers: each adds a vector to a table of distinct phrases.

A provider has `embed(phrases)` taking a DataFrame with a `phrase` column and returning phrase, embedding. One that
computes its vectors also has `worker()`, a function of texts for use inside Python workers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MOST_KNOWN_WORDS = 200_000
WHITE = " \t\n\x0b\f\r"


def bucket_of(word: str, size: int) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % size


def _embedded(provider, phrases: DataFrame) -> DataFrame:
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = provider.worker()
        for texts in batches:
            yield pd.Series(list(work(texts.tolist())), dtype="object") if len(texts) else pd.Series([], dtype="object")

    return phrases.select("phrase").withColumn("embedding", F.pandas_udf(vectors, "array<float>")("phrase"))


class HashingProvider:
    """Counts of words by md5 bucket. The counts are whole numbers, so that cosines are the same in every engine."""

    def __init__(self, size: int = 64):
        self.size = size

    def worker(self) -> Callable[[list[str]], np.ndarray]:
        """A function of texts for one Python worker, which remembers the buckets of words up to a bound."""
        size, known, table = self.size, {}, str.maketrans(WHITE, " " * len(WHITE))

        def vectors(texts: list[str]) -> np.ndarray:
            if len(known) > MOST_KNOWN_WORDS:
                known.clear()
            out = np.zeros((len(texts), size), "f4")
            for v, text in zip(out, texts):
                for w in (text or "").translate(table).split(" "):
                    if w:
                        if w not in known:
                            known[w] = bucket_of(w, size)
                        v[known[w]] += 1
            return out

        return vectors

    def embed(self, phrases: DataFrame) -> DataFrame:
        return _embedded(self, phrases)


class PrecomputedProvider:
    """Vectors of a table with phrase and embedding; phrases that are not in it get null."""

    def __init__(self, table: DataFrame):
        self.table = table.select("phrase", "embedding")

    def embed(self, phrases: DataFrame) -> DataFrame:
        return phrases.select("phrase").join(self.table, "phrase", "left")


class OnnxProvider:
    """Mean-pooled, normalised output of an ONNX encoder; one session for each Python worker.

    encode: text -> ids, in Python (see operators.tokenize.Cutter). session: a factory of objects with `get_inputs()` and
    `run()`, onnxruntime's by default. Inputs are given by name: ids, mask of ones, type ids of zero. Texts with the same
    number of ids run together, `batch` at most at a time, so nothing is padded and each text's output is that of a run alone.
    """

    def __init__(self, path: str, encode: Callable[[str], list[int]], session: Callable | None = None, batch: int = 32):
        if encode is None:
            raise ValueError("a tokenizer is needed")
        self.path, self.encode, self.session, self.batch = path, encode, session, batch

    def _open(self):
        if self.session is not None:
            return self.session(self.path)
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
        if self.path.endswith(".ort"):
            options.add_session_config_entry("session.load_model_format", "ORT")
        return onnxruntime.InferenceSession(self.path, options)

    def _run(self, session, ids: np.ndarray) -> np.ndarray:
        """A unit vector for each row of ids; a zero one stays."""
        given = {"mask": np.ones_like(ids), "type": np.zeros_like(ids), "ids": ids}
        feed = {x.name: given[next((k for k in ("mask", "type") if k in x.name), "ids")] for x in session.get_inputs()}
        out = np.asarray(session.run(None, feed)[0], "f4")
        pooled = out.mean(axis=1, dtype="f4") if out.ndim == 3 else out.reshape(len(ids), -1)
        norm = np.sqrt((pooled * pooled).sum(axis=1, keepdims=True, dtype="f4"))
        return np.divide(pooled, norm, out=pooled.copy(), where=norm != 0)

    def vectors(self, session, texts: list[str]) -> np.ndarray:
        ids = [self.encode(t or "") for t in texts]
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(ids):
            by_size.setdefault(len(x), []).append(i)
        found: list[np.ndarray | None] = [None] * len(texts)
        for own in by_size.values():
            for at in range(0, len(own), self.batch):
                rows = own[at : at + self.batch]
                for i, v in zip(rows, self._run(session, np.array([ids[i] for i in rows], "i8"))):
                    found[i] = v
        return np.stack(found)

    def worker(self) -> Callable[[list[str]], np.ndarray]:
        session = self._open()
        return lambda texts: self.vectors(session, texts)

    def embed(self, phrases: DataFrame) -> DataFrame:
        return _embedded(self, phrases)
