import random
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tickloom.llm import packing
from tickloom.llm.packing import Levels, Piece, pack, windows
from tickloom.llm.words import WordEncoder


def whole(documents, made, window):
    """Every id lies in one piece; all windows are full but those whose lengths are powers of two."""
    parts = defaultdict(list)
    for pieces in made:
        fill = sum(p.size for p in pieces)
        assert fill == window or fill < window and fill & (fill - 1) == 0
        for p in pieces:
            parts[p.id].append(p)
    assert {i: b"".join(p.ids for p in sorted(ps, key=lambda p: p.start)) for i, ps in parts.items()} == dict(documents)
    for ps in parts.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.size


def test_windows_hold_every_id(monkeypatch):
    rng = random.Random(2)
    for open_, sizes in ((4_096, lambda: rng.choice([1, 7, 33, 64, 65, 200, 1])), (5, lambda: 33), (3, lambda: rng.randint(1, 150))):
        monkeypatch.setattr(packing, "OPEN", open_)
        documents = [(i, np.arange(sizes(), dtype="<u4").tobytes()) for i in range(500)]
        made = list(windows(iter(documents), 64))
        whole(documents, made, 64)


def test_level_minimises_the_sum_of_squares():
    rng, levels = random.Random(4), Levels(12)
    for i in range(400):
        size = rng.randint(1, 11)
        count = levels.count.copy()

        def squares(level, count=count, size=size):
            after = count.copy()
            if level:
                after[level] -= 1
            if level + size < 12:
                after[level + size] += 1
            return int((after.astype(int) ** 2).sum())
        can = [0, *(h for h in range(1, 12 - size + 1) if count[h])]
        chosen = levels.level_for(size)
        assert chosen in can and squares(chosen) == min(map(squares, can))
        levels.place(Piece(i, 0, size, bytes(4 * size)))


def test_given_and_odd_documents(spark, small, odd_docs, no_docs, vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    for docs in (small, odd_docs):
        rows = pack(docs, vocabulary).collect()
        want = sorted(tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
        texts, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            texts[r["doc_id"], r["doc_tokens"]].append(r)
            sequences[r["sequence_id"]].append(r)
        for pieces in sequences.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at and 4 * r["length"] == len(r["ids"])
                at += r["length"]
            assert at == 4096 or at & (at - 1) == 0
        if docs is small:
            got = sorted(tuple(np.frombuffer(b"".join(r["ids"] for r in sorted(p, key=lambda r: r["start"])), "<u4").tolist())
                         for p in texts.values())
            assert got == want
        assert sum(r["length"] for r in rows) == sum(map(len, want))
    assert pack(no_docs, vocabulary).collect() == []


def test_encoder_equals_the_tokenizer(vocabulary):
    tokenizer, encoder = Tokenizer.from_file(vocabulary), WordEncoder(vocabulary)
    texts = ["", "a\x1cb ĿÉ ÉÉÉ, don't it's. x.,y a|b | || É.  z\xa0q İstanbul ΣΑΣ. <|endoftext|>A <|EndOfText|> KK é. ́x .,a. 1. 12, ,.",
             "... 'S 'LL we'Ve. a.' a,'s ŉ Å ﬁ ß ẞ straße… x…, „y“. 漢字。 été, É!! naïve-ly co­op", "\x0b\x0c\x85 x y\r\n\tz"]
    rng = random.Random(5)
    texts += ["J\u030c H\u0331 T\u0308 W\u030a Y\u030a I\u0327\u0307 JJ\u030cJ, I\u0344 J I", "AI\u0327\u0307\u2028\x00"]
    alphabet = "JI\u030c\u0307\u0327aAéÉßẞ.,'|<> \t\n12½²́…İıŒŸ漢🙂-"
    texts += ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(2_000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
