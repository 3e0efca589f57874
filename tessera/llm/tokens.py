"""Word-cached tokenizer: a word that a worker has met lately is not encoded again."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import regex

from tessera.llm.common import gather, words_of

#: Entries of the younger half of a cache: of pre-tokens, and of words of other than letters and marks behind them. Longer
#: ones are encoded each time they come up.
CACHE_PRETOKENS, CACHE_WORDS, CACHE_LETTERS = 150_000, 50_000, 64
#: What a run of is one pre-token, unless letters stand behind it.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: The pre-token pattern of the public word tokenizer.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_loaded: dict[str, "WordTokenizer"] = {}


def byte_letters() -> dict[int, str]:
    """Latin-1 characters to the letters that stand for their UTF-8 bytes in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take code points from 256 on, in order.
    """
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letter:
            letter[b] = chr(256 + len(letter) - len(printable))
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Recent:
    """Ids by word, for at most twice `most` words: when the younger half is full, the older one goes."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is not None:
                self.put(word, found)
        return found

    def put(self, word: str, ids: bytes) -> None:
        if len(word) > CACHE_LETTERS:
            return
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[word] = ids


class WordTokenizer:
    """Ids of whole texts under a tokenizer that lower-cases and drops white space.

    No pre-token crosses white space, so the ids of a text are those of its words in a row. Words of
    Latin-1 characters are lower-cased and split here and only their pre-tokens go to the library's
    model; all other words, and those with "<|", go through the whole library tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known = Recent(CACHE_WORDS)
        self.pretokens = Recent(CACHE_PRETOKENS)

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _pretoken(self, word: str) -> bytes:
        found = self.pretokens.young.get(word)
        if found is None:
            found = self.pretokens.get(word)
        if found is None:
            letters = word if word.isascii() and word.isalpha() else word.translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            self.pretokens.put(word, found)
        return found

    def _split(self, word: str) -> bytes:
        if "<|" in word or not (word.isascii() or max(word) <= "\xff"):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self._pretoken(part) for part in PRETOKEN.findall(word.lower()))

    def _word(self, word: str) -> bytes:
        """Most words are letters, or letters and marks behind them: these need no pattern and no entry of their own."""
        if word.isascii() or max(word) <= "\xff":
            low = word.lower()
            if low.isalpha():
                return self._pretoken(low)
            core = low.rstrip(MARKS)
            if core.isalpha() and "<|" not in low:
                return self._pretoken(core) + self._pretoken(low[len(core) :])
        found = self.known.get(word)
        if found is None:
            found = self._split(word)
            self.known.put(word, found)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's offset among them."""
        codes, words, offsets = words_of(texts)
        own = [self._word(word) for word in words]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        return gather(np.frombuffer(b"".join(own), "<u4"), starts[codes], each), np.concatenate(([0], np.cumsum(each)))[offsets]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
