"""Token ids of whole texts with a public tokenizer, by way of a bounded table of words already encoded."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Python's split() also takes these as white space; the tokenizer does not.
_INFORMATION_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile(r"(?:(?![\x1c-\x1f])\s)+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII punctuation that the tokenizer takes as runs of its own; the apostrophe, which starts contractions, is not in it.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: Words on which the short way must agree with the whole tokenizer before it is used.
PROBES = ["a", "THE", "thing", "Éçeau", "straße", "ünung", "naïve,", "(word).", "x!!", "$$$", "ciónque?!", "ßein;", "the|"]


def _visible_bytes() -> list[str]:
    """The byte-level alphabet: a printable Latin-1 byte is its own character, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and never merges across it.

    For such a tokenizer the ids of a text are the ids of its words, one after the other. Each word goes through the
    tokenizers library once and is then read from a table of two generations, each of at most `most_words` words:
    when the younger is full it becomes the older one, and words met again move back.

    Most of the library's time for a single word is spent around its merges. Words of letters with punctuation before and
    after them are therefore cut and lower-cased here and handed to the library's model directly, if that gives the
    same ids on PROBES; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str, most_words: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._bytes = self._tokenizer.model, _visible_bytes()
        self._most = most_words
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._codes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._direct = False
        whole = [self._whole(w) for w in PROBES]
        self._direct = all(self._short(w) == x for w, x in zip(PROBES, whole))

    @staticmethod
    def words(text: str) -> list[str]:
        if _INFORMATION_SEPARATORS.search(text):
            return [w for w in _WHITE.split(text) if w]
        return text.split()

    def _whole(self, word: str) -> bytes:
        return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _run(self, piece: str) -> bytes:
        if not piece:
            return b""
        shown = piece if piece.isascii() else "".join([self._bytes[b] for b in piece.encode()])
        codes = self._codes
        return b"".join([codes[t.id] for t in self._model.tokenize(shown)])

    def _short(self, word: str) -> bytes | None:
        """ids of marks, letters, marks; None for any other word."""
        if word.isascii() and word.isalpha():
            return self._core(word.lower())
        head = word.lstrip(MARKS)
        core = head.rstrip(MARKS)
        if not core:
            return self._run(word)
        if not core.isascii() and ("Σ" in core or not unicodedata.is_normalized("NFC", core)):
            return None
        lower = core.lower()
        if not (core.isalpha() and lower.isalpha()):
            return None
        before, after = word[: len(word) - len(head)], head[len(core) :]
        return self._run(before) + self._core(lower) + self._run(after)

    def _core(self, lower: str) -> bytes:
        found = self._young.get(lower)
        if found is None:
            found = self._young[lower] = self._old.get(lower) or self._run(lower)
        return found

    def _learn(self, words: list[str]) -> None:
        if len(self._young) > self._most:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        for word in words:
            if word not in young:
                found = old.get(word)
                if found is None and self._direct:
                    found = self._short(word)
                young[word] = self._whole(word) if found is None else found

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of the whole text; none for null."""
        if not text:
            return b""
        words = self.words(text)
        try:
            return b"".join(map(self._young.__getitem__, words))
        except KeyError:
            self._learn(words)
            return b"".join(map(self._young.__getitem__, words))

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // self.dtype.itemsize


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
