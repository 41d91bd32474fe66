"""Token ids of whole texts, word by word."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from struct import Struct

import numpy as np

HELD = 64 << 20                        # bytes of words and ids kept per worker, unless said otherwise
# lower-case Latin letters that are single characters in composed form, then marks of ASCII but the apostrophe
LETTERS = "a-zß-öø-įı-ňŊ-ſ"
COMBINING = re.compile(b"[\xcc\xcd]")   # first bytes of U+0300 to U+037F, the marks that compose with A-Z
PLAIN = re.compile(f"[{LETTERS}]+")
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PACK = [Struct(f"<{n}I").pack for n in range(64)]


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, from a tokenizers file.

    For byte-level tokenizers that ignore case and never join text across white space, nor a letter with a mark
    behind it: a text's ids are then its words' ids in a row, and each distinct word is encoded once while the cache
    holds it. A word of Latin letters goes straight to the tokenizer's model, as normalising leaves it as it is.
    """

    def __init__(self, path: str, held: int = HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks share the cores
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.older, self.size = Tokenizer.from_file(path), {}, {}, 0
        self.tokens, self.held = self.tokenizer.model.tokenize, held
        letters = (c for c in map(chr, range(0x80, 0x180)) if PLAIN.fullmatch(c))
        self.bytewise = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}

    def encode(self, text: str) -> bytes:
        if "<|" in text:                                   # may hold a special token, which has a case
            return self.whole([text])[0]
        body = text.encode()
        if not COMBINING.search(body):                     # a capital may compose with a mark where its small letter does not
            body = body.lower()
        words = body.split()                               # on bytes: A-Z and ASCII white space alone
        ids = list(map(self.known.get, words))
        if None in ids:
            self.learn({w for w, known in zip(words, ids, strict=True) if known is None})
            ids = list(map(self.known.__getitem__, words))
            if self.size > self.held // 2:                      # words not met again by the time the next half is full are forgotten
                self.known, self.older, self.size = {}, self.known, 0
        return b"".join(ids)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        others, size, known, older, mark = [], 0, self.known, self.older, self.mark
        for word in words:
            size += len(word)
            ids = older.get(word)
            if ids is None:
                stem = word.rstrip(MARKS)
                letters = stem.decode()
                if not (stem.isalpha() or PLAIN.fullmatch(letters.lower())):
                    others.append(word)
                    continue
                marked = len(stem) < len(word)
                ids = (known.get(stem) or older.get(stem)) if marked else None
                if ids is None:
                    ids = self.of_letters(letters.lower())
                if marked:
                    ids += mark(word[len(stem):].decode())
            known[word] = ids
        known.update(zip(others, self.whole([w.decode() for w in others]), strict=True))
        self.size += 8 * size + 200 * len(words)

    def of_letters(self, letters: str) -> bytes:
        ids = [t.id for t in self.tokens(letters if letters.isascii() else letters.translate(self.bytewise))]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()

    @lru_cache(maxsize=4_096)                              # noqa: B019  encoders live as long as their worker
    def mark(self, marks: str) -> bytes:
        return self.whole([marks])[0]


@lru_cache(maxsize=2)
def encoder(path: str, held: int = HELD) -> WordEncoder:
    """The worker's encoder, kept from task to task."""
    return WordEncoder(path, held)


def serialized(path: str, text: str | None, end: int, held: int = HELD) -> bytes:
    return encoder(path, held).encode(text or "") + end.to_bytes(4, "little")
