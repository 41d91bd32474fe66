"""Spelling variants: words one edit apart, by finite-state composition.

The vocabulary is an acyclic acceptor; composed with a transducer of exactly one edit and with itself again, it accepts
the pairs of near words. Partitions of that composition follow from the states it starts in. A pair has its edit behind
the first letters of both words or before the last letters of both, so for every length `s` of the shorter word,
the words of `s` and `s + 1` letters meet once per state that their first half leads to, and once per state that
their last half is read from. In each partition the words' acceptor is built minimised, and the composition walked from
there; where a partition has more than `CELL` words, its words are dealt by the place of the edit instead: partitions that
share all letters but one or two and so are bounded by the alphabet.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import saved

RUN = re.compile(rb"[A-Za-z\xc0-\xff]+")          # on Latin-1, which holds every letter of a run
BREAK = re.compile(rb"[^A-Za-z\xc0-\xff]")
PIECE = 1 << 20        # bytes of a text whose runs are listed at once
HELD = 1 << 18         # words that a task counts before it passes its counts on
CELL = 20_000          # words of a partition that one acceptor holds; larger partitions are dealt anew
DAMAGED = 97           # of as many words of a document, one loses a letter


def runs(text: str) -> Counter:
    """The runs of letters of a text with A-Z in lower case, as Latin-1 bytes, with their numbers."""
    body = text.encode("latin-1", "replace").lower()       # bytes: lowers A-Z alone; what Latin-1 lacks ends a run, as "?" does
    if len(body) <= PIECE:
        return Counter(RUN.findall(body))
    found, at = Counter(), 0
    while at < len(body):
        stop = BREAK.search(body, at + PIECE)
        end = stop.start() if stop else len(body)
        found.update(RUN.findall(body, at, end))
        at = end
    return found


def damaged(word: bytes, number: int) -> bytes:
    """The word, or where `DAMAGED` divides its number, the word without the letter that the number picks."""
    if number % DAMAGED:
        return word
    at = number % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame, id: str, text: str, letters: int, least: int) -> DataFrame:
    """(word, n): the runs of all texts, damaged, that have at least `letters` letters and occur `least` times overall."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = crc32(f"{name}:".encode())
                for word, n in runs(body).items():
                    if len(word) >= letters:
                        word = damaged(word, crc32(word if word.isascii() else word.decode("latin-1").encode(), start))
                        if len(word) >= letters:
                            held[word] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    texts = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words: per state its letters' next states, and whether a word ends."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[bool] = [False]
        self.met: dict[tuple[int, int], bool] = {}              # state pairs known to share a rest, or not
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def settle(depth: int) -> None:
            """States deeper than `depth` on the last word's path get no more arcs: equal ones become one."""
            while len(path) > depth + 1:
                state = path.pop()
                key = (self.ends[state], *self.next[state].items())
                self.next[path[-1]][last[len(path) - 1]] = known.setdefault(key, state)

        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            settle(same)
            for letter in word[same:]:
                self.next.append({})
                self.ends.append(False)
                self.next[path[-1]][letter] = len(self.next) - 1
                path.append(len(self.next) - 1)
            self.ends[path[-1]] = True
            last = word
        settle(0)

    def common(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The state pairs that one letter leads to, in order of state."""
        other = self.next[b]
        return ((n, other[c]) if n < other[c] else (other[c], n) for c, n in self.next[a].items() if c in other)

    def meet(self, a: int, b: int) -> bool:
        """Whether some rest of a word is accepted from both states. Without recursion, as words may be of any length."""
        first = (a, b) if a < b else (b, a)
        path: list[tuple[tuple[int, int], Iterator]] = []
        todo: tuple[int, int] | None = first
        while True:
            if todo is not None:
                a, b = todo
                found = True if a == b or (self.ends[a] and self.ends[b]) else self.met.get(todo)
                if found:
                    self.met.update(((pair, True) for pair, _ in path))
                    return True
                if found is None:
                    path.append((todo, self.common(a, b)))
            if not path:
                return False
            todo = next(path[-1][1], None)
            if todo is None:
                self.met[path.pop()[0]] = False

    def rests(self, a: int, b: int, but: str = "") -> Iterator[str]:
        """The rests of words accepted from both states, but those that begin with the letter `but`."""
        todo = [(a, b, "")]
        while todo:
            a, b, rest = todo.pop()
            if self.ends[a] and self.ends[b]:
                yield rest
            other = self.next[b]
            for c, n in self.next[a].items():
                if c in other and (rest or c != but) and self.meet(n, other[c]):
                    todo.append((n, other[c], rest + c))

    def near(self, low: int, high: int) -> Iterator[tuple[str, str]]:
        """The pairs that the composition with one edit accepts, each once: the edit at the first letter that differs, with
        `low` to `high` letters before it. Of two lengths, the longer word comes first."""
        todo = [(0, "")]                                       # before the edit both acceptors are in one state
        while todo:
            state, read = todo.pop()
            arcs = list(self.next[state].items())
            if len(read) >= low:
                for i, (c, n) in enumerate(arcs):
                    if self.meet(n, state):                     # c deleted; a rest that begins with it differs later only
                        for rest in self.rests(n, state, but=c):
                            yield read + c + rest, read + rest
                    for d, m in arcs[i + 1:]:                   # c replaced by d
                        if self.meet(n, m):
                            for rest in self.rests(n, m):
                                yield read + c + rest, read + d + rest
            if len(read) < high:
                todo.extend((n, read + c) for c, n in arcs)


def near_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow` over rows (cell, word, s, low, high) sorted by cell and word: the pairs of each cell whose shorter
    word has s letters."""
    cell, words, bounds = None, [], None
    left, right = [], []

    def found() -> None:
        if len(words) > 1:
            size, low, high = bounds
            for a, b in Acceptor(words).near(low, high):
                if len(b) == size:
                    left.append(a)
                    right.append(b)

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["a", "b"])
        left.clear()
        right.clear()
        return batch

    for batch in batches:
        for key, word, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != cell:
                found()
                cell, words, bounds = key, [], rest
                if len(left) > 50_000:
                    yield rows()
            words.append(word)
    found()
    yield rows()


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b): the pairs of distinct `word`s that differ by one letter inserted, deleted or replaced, each pair once."""
    def cells(rows: DataFrame, key: Column, low: Column, high: Column) -> DataFrame:
        return rows.select(key.alias("cell"), "word", "s", low.alias("low"), high.alias("high"))

    def search(rows: DataFrame) -> DataFrame:
        return rows.repartition("cell").sortWithinPartitions("cell", "word").mapInArrow(near_in_groups, "a string, b string")

    size, s, p = F.length("word"), F.col("s"), F.col("p")
    rows = words.select("word").withColumn("s", F.explode(F.array(size - 1, size))).where("s > 0").withColumn("p", F.floor((s - 1) / 2).cast("int"))
    head = cells(rows, F.xxhash64(s, F.lit("head"), F.substring("word", F.lit(1), p)), p, s + 1)
    tail = cells(rows, F.xxhash64(s, F.lit("tail"), F.substring("word", p - s, s - p)), F.lit(0), p - 1)
    halves = head.union(tail.where("high >= 0"))
    sizes = halves.groupBy("cell").count()
    usual = halves.join(sizes.where(f"count between 2 and {cell}"), "cell", "left_semi")
    large = halves.join(sizes.where(f"count > {cell}"), "cell", "left_semi")
    place = F.col("place")
    dealt = large.withColumn("place", F.explode(F.sequence(F.col("low"), F.least("high", s - 1))))
    letters = (F.substring("word", F.lit(1), place), F.substring("word", place - s + 1, s - 1 - place))
    rest = F.when(place < s - 1, letters[1]).otherwise("")
    dealt = cells(dealt, F.xxhash64(s, F.lit("place"), place, letters[0], rest), place, F.when(place == s - 1, s).otherwise(place))
    return search(usual).union(search(dealt))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: the last form that forms lead to. Each round doubles the way."""
    now = saved(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = saved(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", letters: int = 5, least: int = 3, times: int = 2,
                      cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the texts with at least `letters` letters and `least` occurrences.

    A word's form is its near word (one edit apart) with most occurrences, ties to the least in code-point order, where
    that has at least `times` as many as the word; form and form_n are null without one. Root is where forms lead to.
    Null and empty texts have no words, a null id counts as an empty one, repeated rows count as often as they are there,
    very long texts are read in pieces. No words: no rows. Other columns are not used.
    """
    words = saved(vocabulary(docs, id, text, letters, least))
    links = saved(near_words(words, cell))
    both = links.select(F.col("a").alias("word"), F.col("b").alias("near")).union(links.select("b", "a"))
    best = (both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
            .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    most = -F.col("best.less")
    forms = saved(words.join(best, "word", "left").withColumn("chosen", F.coalesce(most >= times * F.col("n"), F.lit(False))).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("chosen"), F.col("best.near")).alias("form"),
        F.when(F.col("chosen"), most).alias("form_n")))
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
