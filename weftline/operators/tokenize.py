"""WordPiece ids. A vocabulary of at most MOST_TOKENS tokens and MOST_BYTES bytes, which is counted, is sent to the tasks: texts
are cut where they are, without a shuffle, and a worker remembers the ids of words up to a bound. With a larger one distinct
words are cut once, by joins with the vocabulary, and texts are put together from their words. Both give the same ids.

The rule for a word: the longest piece from the current place is taken, `##` in front of pieces after the first; where no
piece fits, the pieces found so far stay and one UNK is added. A word over MOST_WORD_BYTES bytes is one UNK.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

MOST_IDS, MOST_WORD_BYTES = 512, 200
CLS, SEP, UNK = ("[CLS]", 101), ("[SEP]", 102), ("[UNK]", 100)
MOST_TOKENS, MOST_BYTES = 1_000_000, 16 << 20
#: Words whose ids a worker remembers.
MOST_KNOWN = 200_000


@dataclass
class Vocabulary:
    """token and token_id rows, the ids of the special tokens and the longest token."""

    tokens: DataFrame
    cls: int = CLS[1]
    sep: int = SEP[1]
    unk: int = UNK[1]
    longest: int = 0

    @classmethod
    def of(cls, tokens: DataFrame) -> Vocabulary:
        special = {r["token"]: r["token_id"] for r in tokens.filter(F.col("token").isin(CLS[0], SEP[0], UNK[0])).collect()}
        longest = tokens.agg(F.max(F.length("token"))).first()[0] or 0
        return cls(tokens.select("token", F.col("token_id").cast("long")), special.get(CLS[0], CLS[1]), special.get(SEP[0], SEP[1]), special.get(UNK[0], UNK[1]), longest)

    def held(self) -> dict[str, int] | None:
        """The tokens and ids on the driver, None if there are too many."""
        n, size = self.tokens.limit(MOST_TOKENS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()
        return None if n > MOST_TOKENS or size > MOST_BYTES else {r["token"]: r["token_id"] for r in self.tokens.collect()}


class Cutter:
    """Cuts texts with a vocabulary in memory."""

    def __init__(self, tokens: dict[str, int], cls: int = CLS[1], sep: int = SEP[1], unk: int = UNK[1]):
        self.tokens, self.cls, self.sep, self.unk = tokens, cls, sep, unk
        self._longest, self._known = max(map(len, tokens), default=0), {}
        self._lower, self._token = str.maketrans(T.UPPER, T.LOWER), re.compile(T.BASIC_TOKEN)

    def word(self, word: str) -> list[int]:
        if len(word.encode("utf-8", "surrogatepass")) > MOST_WORD_BYTES:
            return [self.unk]
        out, at, get = [], 0, self.tokens.get
        while at < len(word):
            mark = "##" if at else ""
            for end in range(min(len(word), at + self._longest), at, -1):
                found = get(mark + word[at:end])
                if found is not None:
                    break
            else:
                return [*out, self.unk]
            out.append(found)
            at = end
        return out

    def ids(self, text: str | None, most: int = MOST_IDS) -> list[int]:
        """CLS, at most `most` - 2 ids, SEP; null counts as empty."""
        out, known = [], self._known
        if len(known) > MOST_KNOWN:
            known.clear()
        for m in self._token.finditer((text or "").translate(self._lower)):
            if len(out) >= most - 2:
                break
            w = m[0]
            if w not in known:
                known[w] = self.word(w)
            out += known[w]
        return [self.cls, *out[: most - 2], self.sep]


def pieces(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word and ids of distinct words (column `word`).

    Every substring no longer than the longest token is joined with the vocabulary on equality; the longest hit per start
    is kept in a map, which is then walked from the start of the word.
    """
    size = F.length("word")
    starts = words.filter((F.octet_length("word") <= MOST_WORD_BYTES) & (size > 0)).select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    ends = starts.select("word", "i", F.explode(F.sequence(F.col("i") + 1, F.least(size, F.col("i") + vocabulary.longest))).alias("j"))
    named = ends.withColumn("token", F.concat(F.when(F.col("i") > 0, "##").otherwise(""), F.substring("word", F.col("i") + 1, F.col("j") - F.col("i"))))
    hits = named.join(vocabulary.tokens, "token").groupBy("word", "i").agg(F.max(F.struct("j", "token_id")).alias("hit"))
    maps = hits.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("i", "hit"))).alias("hits"))
    state = "struct<at:int,ids:array<bigint>,stuck:boolean>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("ids"), F.lit(False).alias("stuck")).cast(state)

    def step(s, _):
        hit = F.try_element_at(F.col("hits"), s["at"])
        done = s["stuck"] | (s["at"] >= F.length("word"))
        unknown = F.struct(s["at"].alias("at"), F.concat(s["ids"], F.array(F.lit(vocabulary.unk).cast("long"))).alias("ids"), F.lit(True).alias("stuck")).cast(state)
        found = F.struct(hit["j"].alias("at"), F.concat(s["ids"], F.array(hit["token_id"])).alias("ids"), F.lit(False).alias("stuck")).cast(state)
        return F.when(done, s).when(hit.isNull(), unknown).otherwise(found)

    walked = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step, lambda s: s["ids"])
    unknown = F.array(F.lit(vocabulary.unk).cast("long"))
    joined = words.join(maps, "word", "left")
    return joined.select("word", F.when((F.octet_length("word") > MOST_WORD_BYTES) | F.col("hits").isNull(), unknown).otherwise(walked).alias("ids"))


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, most: int = MOST_IDS) -> DataFrame:
    """id_col and ids (CLS, at most `most` - 2 ids, SEP) of every row. Null text counts as empty."""
    tokens = vocabulary.held()
    if tokens is None:
        return encode_joined(df, vocabulary, id_col, text_col, most)
    special = vocabulary.cls, vocabulary.sep, vocabulary.unk
    sent = df.sparkSession.sparkContext.broadcast(tokens)

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cutter = Cutter(sent.value, *special)
        for texts in batches:
            yield pd.Series([cutter.ids(t, most) for t in texts], dtype="object")

    return df.select(id_col, F.pandas_udf(cut, "array<long>")(F.col(text_col)).alias("ids"))


def encode_joined(df: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, most: int = MOST_IDS) -> DataFrame:
    """`encode` for a vocabulary of any size; id_col must be unique."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    placed = rows.select("id", F.posexplode(T.basic_tokens(F.col("text"))).alias("pos", "word")).filter(F.col("pos") < most - 2)
    cut_words = pieces(placed.select("word").distinct(), vocabulary)
    joined = placed.join(cut_words, "word").groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    whole = F.concat(F.array(F.lit(vocabulary.cls).cast("long")), F.slice(F.coalesce("ids", F.array().cast("array<bigint>")), 1, most - 2), F.array(F.lit(vocabulary.sep).cast("long")))
    return rows.select("id").join(joined, "id", "left").select(F.col("id").alias(id_col), whole.alias("ids"))


def encode_text(text: str, vocabulary: dict[str, int], most: int = MOST_IDS) -> list[int]:
    """The same for one text in Python, for model workers that hold the vocabulary."""
    return cutter_of(vocabulary).ids(text, most)


def cutter_of(vocabulary: dict[str, int]) -> Cutter:
    return Cutter(vocabulary, *(vocabulary.get(name, default) for name, default in (CLS, SEP, UNK)))
