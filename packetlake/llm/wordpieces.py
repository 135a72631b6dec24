"""Ids of a tokenizers-library BPE, word by word with a bounded cache."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

#: Distinct words of one generation of the cache, looked at after each text; a task keeps two of them.
CACHED_WORDS = 200_000
#: Characters that str.split takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Words of one letter run and one run of punctuation: two pieces of the tokenizer's split.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([.,;:!?*&%$#|]*)")


def byte_letters() -> str:
    """The letter that a byte-level vocabulary uses for each byte value: printable
    Latin-1 stands for itself, the others follow from 256 on."""
    letters, extra = [], 256
    for value in range(256):
        if 33 <= value <= 126 or 161 <= value <= 172 or 174 <= value <= 255:
            letters.append(chr(value))
        else:
            letters.append(chr(extra))
            extra += 1
    return "".join(letters)


class WordPieces:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    The vocabularies meant here drop white space and never join pieces across
    it, so a text's ids are those of its words in order. Ids are little-endian unsigned 32-bit.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words = Words(self.learn)
        probe = "It's  a Naïve\tTEST!! of_3 words, (&c.)"
        if self.encode([probe])[0] != self.whole(probe):
            raise ValueError("this vocabulary joins pieces across white space")

    def whole(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        spelled = piece.lower().encode().decode("latin-1").translate(self.letters) if not piece.isascii() else piece.lower()
        return pack([token.id for token in self.model.tokenize(spelled)])

    def learn(self, word: str) -> bytes:
        """Ids of a word without white space."""
        found = _PLAIN.fullmatch(word)
        if found is None:
            return self.whole(word)
        core, tail = found.groups()
        if tail:
            return self.words[core] + self.words[tail]
        return self._piece(core)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; callers pass batches of bounded size."""
        packed = []
        for text in texts:
            if _ODD.search(text):
                packed.append(self.whole(text))
                continue
            packed.append(b"".join(map(self.words.__getitem__, text.split())))
            self.words.renew()
        return packed


class Words(dict):
    """Ids by word in two generations: what the newer one lacks comes from the older one or is learned."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.learn(word)
        self[word] = ids
        return ids

    def renew(self) -> None:
        """Starts a new generation where this one is full."""
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()


def pack(ids: list[int]) -> bytes:
    """Unsigned 32-bit ids, little-endian as on every platform Spark supports here."""
    return array("I", ids).tobytes()


@functools.lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    """One encoder per worker process and vocabulary."""
    return WordPieces(path)
