"""Spelling variants against plain loops."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm.variants import Acceptor, damaged, near_words, runs, spelling_variants


def near(a, b):
    a, b = sorted((a, b), key=len, reverse=True)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def by_loops(rows, letters=5, least=3, times=2):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if id is None else id}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += len(word) >= letters
    words = {w: n for w, n in counts.items() if n >= least}
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= times * n else None, n, len(others)]
    found = set()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found.add((w, form, root, n, n_near, words.get(form)))
    return found


@given(st.sets(st.text("abc", max_size=6), max_size=50))
@settings(max_examples=200, deadline=None)
def test_composition_accepts_near_pairs_once(words):
    words = sorted(words)
    found = list(Acceptor(words).near(0, 99))
    assert len(found) == len(set(found)) and all(len(a) >= len(b) for a, b in found)
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_acceptor_is_minimal():
    a = Acceptor(sorted(["tap", "taps", "top", "tops"]))
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo.extend(a.next[s].values())
    assert len(reached) == 5 and a.next[a.next[0]["t"]]["a"] == a.next[a.next[0]["t"]]["o"]


def test_long_words_need_no_deep_stack():
    word = "ab" * 5_000
    assert len(list(Acceptor(sorted([word, word + "a", "x" + word[1:]])).near(0, 10 ** 9))) == 2


@pytest.mark.parametrize("cell", [2, 5, 20_000])
def test_partitions_lose_and_repeat_no_pair(spark, cell):
    words = sorted({f"{a}{b}stone{c}{d}"[:n] for a in ("", "x", "y") for b in "abé" for c in ("", "r", "rs") for d in "klm" for n in (6, 7, 9)})
    got = near_words(spark.createDataFrame([(w,) for w in words], "word string"), cell).collect()
    assert len(got) == len({frozenset(r) for r in got})
    assert {frozenset(r) for r in got} == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_runs_and_damage():
    assert runs("Ärger ÄRGER's x2y…Straße×÷ İstanbul") == Counter(
        s.encode("latin-1") for s in ("Ärger", "Ärger", "s", "x", "y", "straße×÷", "stanbul"))
    long = "Word " * 300_000 + "z" * 1_200_000
    assert runs(long) == Counter({b"word": 300_000, b"z" * 1_200_000: 1})
    assert damaged(b"word", 97) == b"wrd" and damaged(b"word", 98) == b"word" and damaged(b"a", 97) == b""


def test_whole_table_against_loops(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling_variants(small).collect()}
    assert got == by_loops(rows) and any(r[2] != r[1] for r in got if r[1])


def test_forms_ties_and_chains(spark):
    text = "stone " * 3 + "stones " * 6 + "stoner " * 6 + "stonera " * 12 + "stonerax " * 24 + "Stone "
    rows = [(1, text), (1, text), (None, "alone alone alone"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "form": F.lit(2)})
    got = {tuple(r) for r in spelling_variants(docs).collect()}
    assert got == by_loops(rows)
    word = {r[0]: r for r in got}
    assert word["stonera"][1:3] == ("stonerax", "stonerax") and word["stoner"][2] == "stonerax"


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling_variants(odd_docs).collect()} == by_loops(rows)
    assert spelling_variants(no_docs).collect() == []
