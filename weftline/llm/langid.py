"""Operator 2: language of a text from unigram pieces, with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum, over all
ways to cut it into pieces, of the product of their probabilities: the forward algorithm, position by position. A
character that no piece covers is a piece of its own at a fixed floor. Words are the lower-cased runs of letters of the
whole text, written with the vocabulary's word mark in front; a text's log likelihood is the sum over its words.

Training: counts of words come from at most `most_rows` labelled rows (the documented bound; ids in the order of their
XXH64, so that the choice is the same each time). Expectation-maximisation then runs once per language: expected piece counts
over all segmentations, from forward and backward sums, with additive smoothing. Words of over LONGEST_LINEAR letters are
learned and scored in the same way, in logarithms.

The score is the posterior probability of the predicted language, with the languages' shares of the training rows as
prior. Defined cases: null, empty or letterless text gives `und` and score 0; with nothing learned every text is `und`;
null languages are not learned; a language of a single row is learned like any other; ties go to the first language in
alphabetical order. lang, source and ids are no input of a prediction. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import id_crc, prepare

#: Runs of letters, and of numeric signs such as ½, which `words` takes out.
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
FLOOR = -18.0
SMOOTHING = 0.01
ROUNDS = 2
MOST_ROWS = 1_000
#: Words, and characters of words, that a worker remembers.
MOST_KNOWN, MOST_KNOWN_CHARS = 250_000, 8_000_000
#: Probabilities of longer words are summed in logarithms.
LONGEST_LINEAR = 64
#: Every character's factor is raised by exp(SCALE), so that products over words of up to LONGEST_LINEAR letters stay in range.
SCALE = 9.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Pieces made of letters and the word mark, lower-cased, with a number each; and the longest piece's length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).lower()
        if p != MARK and not model.is_control(i) and not model.is_byte(i) and p.replace(MARK, "", 1).isalpha():
            pieces.setdefault(p, len(pieces))
    return pieces, max(map(len, pieces))


def words(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join([c if c.isalpha() else " " for c in run]).split()]


def arcs(word: str, pieces: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece inside the marked word; -1 for a single character that is no piece."""
    s = MARK + word
    found = []
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - longest), end):
            p = pieces.get(s[start:end], -1)
            if p >= 0 or start == end - 1:
                found.append((start, end, p))
    return found


def forward(word: str, logp: np.ndarray, pieces: dict[str, int], longest: int) -> np.ndarray:
    """log of the sum over all segmentations, for each language (a row of logp; its last column is the floor)."""
    n, s = len(word) + 1, MARK + word
    sums = np.full((n + 1, len(logp)), -np.inf)
    sums[0] = 0.0
    for end in range(1, n + 1):
        starts, own = [], []
        for start in range(max(0, end - longest), end):
            p = pieces.get(s[start:end], -1)
            if p >= 0 or start == end - 1:
                starts.append(start)
                own.append(p)
        if len(own) == 1:
            sums[end] = sums[starts[0]] + logp[:, own[0]]
        else:
            paths = sums[starts] + logp[:, own].T
            top = paths.max(axis=0)
            sums[end] = top + np.log(np.exp(paths - top).sum(axis=0))
    return sums[n]


def _log_sum(a: float, b: float) -> float:
    a, b = max(a, b), min(a, b)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _shares_in_logs(lattice: list[tuple[int, int, int]], own: list[float], n: int) -> list[float]:
    """For each arc the share of all segmentations that go through it; own has the arcs' log probabilities."""
    ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = back[n] = 0.0
    for (a, b, _), q in zip(lattice, own):
        ahead[b] = _log_sum(ahead[b], ahead[a] + q)
    for (a, b, _), q in zip(reversed(lattice), reversed(own)):
        back[a] = _log_sum(back[a], back[b] + q)
    return [math.exp(ahead[a] + q + back[b] - ahead[n]) for (a, b, _), q in zip(lattice, own)]


def estimate(counts: dict[str, int], pieces: dict[str, int], longest: int, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log probabilities of the pieces of one language, by expectation-maximisation over its counted words."""
    lattices = [(arcs(w, pieces, longest), c, len(w) + 1) for w, c in counts.items()]
    expected = np.full(len(pieces), smoothing)
    for lattice, c, n in lattices:
        for _, _, p in lattice:
            if p >= 0:
                expected[p] += c / len(lattice)
    logp = np.log(expected / expected.sum())
    floor, raised = math.exp(FLOOR), [math.exp(SCALE * k) for k in range(max(longest, 1) + 1)]
    for _ in range(rounds):
        prob = np.exp(logp).tolist()
        expected = np.full(len(pieces), smoothing)
        for lattice, c, n in lattices:
            if n > LONGEST_LINEAR + 1:
                shares = _shares_in_logs(lattice, [float(logp[p]) if p >= 0 else FLOOR for _, _, p in lattice], n)
                for (_, _, p), x in zip(lattice, shares):
                    if p >= 0:
                        expected[p] += c * x
                continue
            own = [raised[b - a] * (prob[p] if p >= 0 else floor) for a, b, p in lattice]
            ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
            ahead[0] = back[n] = 1.0
            for (a, b, _), q in zip(lattice, own):
                ahead[b] += ahead[a] * q
            total = ahead[n]
            for (a, b, _), q in zip(reversed(lattice), reversed(own)):
                back[a] += back[b] * q
            for (a, b, p), q in zip(lattice, own):
                if p >= 0:
                    expected[p] += c * ahead[a] * q * back[b] / total
        logp = np.log(expected / expected.sum())
    return logp


class Model:
    """langs in alphabetical order, prior log shares, log probabilities with the floor as last column."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray, path: str):
        self.langs, self.prior, self.logp, self.path = langs, prior, logp, path


def _estimator(path: str):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, longest = vocabulary(path)
        logp = estimate(dict(zip(pdf["word"], pdf["n"].tolist())), pieces, longest)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "logp": [logp.astype("f4")]})

    return fit


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            name = lang.as_py()
            counts.update((name, w) for w in words(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, path: str | None = None, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns the languages of docs from at most `most_rows` of its labelled rows; one task fits one language."""
    path = path or default_vocabulary()
    labelled = prepare(docs).filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = labelled.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h")).distinct().orderBy("h", "id").limit(most_rows).select("id")
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(chosen), "id")
    counts = rows.select("lang", "text").mapInArrow(_counter, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = counts.groupBy("lang").applyInPandas(_estimator(path), "lang string, logp array<float>").toPandas().sort_values("lang")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = fitted["lang"].tolist()
    prior = np.log(np.array([shares[x] for x in langs], "f8") / max(1, sum(shares[x] for x in langs)))
    logp = np.array([np.append(x, FLOOR) for x in fitted["logp"]], "f8") if langs else np.zeros((0, 1))
    return Model(langs, prior, logp, path)


def scaled(logp: np.ndarray, pieces: dict[str, int]) -> np.ndarray:
    """Raised probabilities with a row for each piece, the floor and, last, a zero for stretches that are no piece."""
    sizes = np.array([*map(len, pieces), 1])
    return np.vstack([np.exp(logp.T + SCALE * sizes[:, None]), np.zeros((1, len(logp)))])


def _codes(strings: list[str], n: int) -> np.ndarray:
    """Code points of strings of n characters, a row for each."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(strings), n)


class PieceIndex:
    """Finds the pieces in many words at once: by a polynomial hash of each stretch, then by comparing its characters."""

    def __init__(self, pieces: dict[str, int]):
        self.longest = max(map(len, pieces), default=1)
        sizes: dict[int, list[str]] = {}
        for p in pieces:
            sizes.setdefault(len(p), []).append(p)
        codes = {k: _codes(own, k) for k, own in sizes.items()}
        for i in count():  # the first multiplier that tells all pieces of one length apart
            self.factor = np.uint64(xxhash.xxh64_intdigest(b"piece", i) | 1)
            hashes = {k: self._hash(c) for k, c in codes.items()}
            if all(len(np.unique(h)) == len(h) for h in hashes.values()):
                break
        self._of = {}
        for k, own in sizes.items():
            order = np.argsort(hashes[k])
            self._of[k] = hashes[k][order], np.array([pieces[p] for p in own], "i4")[order], codes[k][order]

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), "u8")
        for column in codes.T:
            h = h * self.factor + column
        return h

    def stretches(self, words: list[str], none: int, floor: int) -> dict[int, np.ndarray]:
        """For each length the pieces at all starts of the marked words, which have one length; `none` where there is no piece,
        `floor` for a single character that is none."""
        n = len(words[0]) + 1
        codes, found = _codes([MARK + w for w in words], n), {}
        h = np.zeros(codes.shape, "u8")
        for k in range(1, min(n, self.longest) + 1):
            h = h[:, : n - k + 1] * self.factor + codes[:, k - 1 :]
            found[k] = ids = np.full(h.shape, floor if k == 1 else none, "i4")
            if k in self._of:
                hashes, numbers, own = self._of[k]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                row, start = np.nonzero(hashes[at] == h)
                at = at[row, start]
                same = (codes[row[:, None], start[:, None] + np.arange(k)] == own[at]).all(axis=1)
                ids[row[same], start[same]] = numbers[at[same]]
        return found


def forward_many(words: list[str], table: np.ndarray, index: PieceIndex) -> np.ndarray:
    """`forward` of words of one length: all of them move through the positions together. A row for each word."""
    n, floor, never = len(words[0]) + 1, len(table) - 2, len(table) - 1
    found = index.stretches(words, never, floor)
    sums = np.zeros((n + 1, len(words), table.shape[1]))
    sums[0] = 1.0
    for end in range(1, n + 1):
        sums[end] = sums[end - 1] * table[found[1][:, end - 1]]
        for k in range(2, min(end, index.longest) + 1):
            ids = found[k][:, end - k]
            hit = np.flatnonzero(ids != never)
            if len(hit):
                sums[end, hit] += sums[end - k, hit] * table[ids[hit]]
    return np.log(sums[n]) - SCALE * n


class Scorer:
    """Predicts with a model. Likelihoods of words are kept in a matrix with a row for each word, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.pieces, self.longest = vocabulary(model.path)
        self._table, self._index = scaled(model.logp, self.pieces), PieceIndex(self.pieces)
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._chars = 0
        self._rows = np.zeros((1024, len(self.model.langs)))

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        need = len(self._at) + len(words)
        if need > len(self._rows):
            self._rows = np.vstack([self._rows, np.zeros((max(need, 2 * len(self._rows)) - len(self._rows), self._rows.shape[1]))])
        for n, own in by_length.items():
            for at in range(0, len(own), 512):
                block = own[at : at + 512]
                found = [forward(w, self.model.logp, self.pieces, self.longest) for w in block] if n > LONGEST_LINEAR else forward_many(block, self._table, self._index)
                start = len(self._at)
                self._rows[start : start + len(block)] = found
                self._at.update(zip(block, range(start, start + len(block))))
            self._chars += n * len(own)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        own = [words(t) for t in texts]
        if not self.model.langs:
            return [("und", 0.0)] * len(own)
        if len(self._at) > MOST_KNOWN or self._chars > MOST_KNOWN_CHARS:
            self._forget()
        new = set().union(*own).difference(self._at)
        if new:
            self._learn(new)
        out = []
        for found in own:
            if not found:
                out.append(("und", 0.0))
                continue
            total = self.model.prior + self._rows[np.fromiter(map(self._at.__getitem__, found), "i8", len(found))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _predictor(model: Model):
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            rows = [scorer.predict(texts.iloc[at : at + 250].tolist()) for at in range(0, len(texts), 250)]
            yield pd.DataFrame([x for r in rows for x in r], columns=["lang_pred", "score"])

    return F.pandas_udf(predict, "lang_pred string, score double")


def held_out(col):
    """Whether an id's row is kept from learning; a null id's is."""
    return F.coalesce(id_crc(col) % 3 == 1, F.lit(True))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = prepare(docs).select(F.col(id_col).alias("doc_id"), _predictor(model)(F.col(text_col)).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out."""
    model = train(docs.filter(~held_out(F.col(id_col))), None, MOST_ROWS, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col)
