"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text's subwords are the runs of two, three and four bytes of its lower-cased letters (anything else is a space).
Each is hashed to a row of an embedding table; the rows' mean goes through a linear layer and a softmax. Table and
layer are fitted by stochastic gradient descent in numpy, on a bounded sample of labelled texts. Part of the sample
is kept back to fit a temperature, which makes scores probabilities, and the score below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, DIMENSIONS = 4_096, 16
PER_LANGUAGE, SAMPLE = 500, 20_000       # texts of a language, and of all, in the sample at most; every language has one
EPOCHS, RATE, BATCH = 40, 20.0, 32
SPLITS = 64                              # splits in which a language's first texts are sought
REJECTED = 0.001                         # share of rightly labelled texts that may be rejected
AT_ONCE = 2 << 20                        # bytes of text hashed at once
ROWS = 512                               # rows of counts held at once
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def subwords(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed subwords, a row per text (bytes as `cleaned` gives them)."""
    joined = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, [len(t) for t in texts])
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    code = joined
    for n in (2, 3, 4):
        code = code[:-1] | joined[n - 1:] << np.uint32(8 * (n - 1))
        if not len(code):
            break
        bucket = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
        whole = row[:len(code)] == row[n - 1:]                        # not across two texts
        counts += np.bincount((row[:len(code)] + bucket)[whole], minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS)


def cleaned(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" "


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """Mean-ready rows (counts that sum to one), in runs of bounded size; a longer text is counted in pieces."""
    run: list[bytes] = []
    held = 0
    for text in texts:
        body = cleaned(text)
        if len(body) > AT_ONCE:
            if run:
                yield shares(subwords(run))
                run, held = [], 0
            pieces = (body[max(0, at - 3):at + AT_ONCE] for at in range(0, len(body), AT_ONCE))
            yield shares(sum(subwords([p]) for p in pieces))
            continue
        run.append(body)
        held += len(body)
        if held > AT_ONCE or len(run) >= ROWS:
            yield shares(subwords(run))
            run, held = [], 0
    if run:
        yield shares(subwords(run))


def shares(counts: np.ndarray) -> np.ndarray:
    return (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Sparse:
    """Rows of which only what is not zero is held, at six bytes each: (buckets as uint16, shares as float32) a row."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        self.at = [np.frombuffer(at, np.uint16) for at, _ in rows]
        self.share = [np.frombuffer(share, np.float32) for _, share in rows]

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        """The rows in full; ask for few at once."""
        dense = np.zeros((len(which), BUCKETS), np.float32)
        for row, i in zip(dense, which, strict=True):
            row[self.at[i]] = self.share[i]
        return dense


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.table @ self.layer + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x).astype(np.float64) / self.temperature)


def fit(x: Sparse | np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Fits on four fifths of the rows, calibrates on the rest (on all rows where that is too few).

    Works on a batch, or on `ROWS` rows, at once: nothing grows with rows times languages.
    """
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS,
                  np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    order = rng.permutation(len(y))
    kept, rest = order[:len(y) // 5], order[len(y) // 5:]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(rest), max(1, len(rest) // BATCH)):
            batch = x[at]
            hidden = batch @ model.table
            wrong = softmax(hidden @ model.layer + model.bias)
            wrong[np.arange(len(at)), y[at]] -= 1
            wrong = wrong.astype(np.float32) / max(1, len(at))
            back = wrong @ model.layer.T
            model.layer -= 0.1 * rate * hidden.T @ wrong
            model.bias -= 0.01 * rate * wrong.sum(axis=0)
            model.table -= rate * batch.T @ back
    if len(kept) < 10 * len(languages):
        kept = order
    blocks = [kept[i:i + ROWS] for i in range(0, len(kept), ROWS)]
    if blocks:
        warmths = np.geomspace(0.2, 5, 33)
        loss = np.zeros(len(warmths))
        for at in blocks:
            z = model.logits(x[at]).astype(np.float64)
            loss -= [np.log(np.maximum(softmax(z / t)[np.arange(len(at)), y[at]], 1e-12)).sum() for t in warmths]
        model.temperature = float(warmths[loss.argmin()])
        right = []
        for at in blocks:
            p = model.scores(x[at])
            right.extend(p.max(axis=1)[p.argmax(axis=1) == y[at]])
        if right:
            model.least = float(min(0.5, np.quantile(right, REJECTED)))
    return model


def held_out(id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of every language that labels name, from at most `PER_LANGUAGE` texts of each, fewer where `SAMPLE` texts
    among all languages give less, one at least: those first in the order of their id's hash. Held-out rows, null labels,
    null ids and null texts are left out. None without any.

    The sample's subword counts are made by Spark; what comes to the driver is `SAMPLE` rows (or one per language, if there
    are more languages) of at most 6 x `BUCKETS` bytes, six for each bucket that a text touches.
    """
    known = docs.select(F.col(id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).isNotNull().alias("ok"),
                        F.xxhash64(id).alias("mark")).where("ok and lang is not null and id is not null").where(~held_out(F.col("id")))
    labels = known.select("lang").distinct().count()
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, labels)))
    picked = known.select("id", "lang", "mark", (F.spark_partition_id() % SPLITS).alias("split"))
    for keys in (["lang", "split"], ["lang"]):             # each task's first, then each split's, then a language's
        first = Window.partitionBy(*keys).orderBy("mark", "id")
        picked = picked.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).drop("place")
    picked = picked.drop("split")
    texts = docs.select(F.col(id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    # at most SAMPLE rows, or one per language, each a short id
    sample = texts.join(F.broadcast(picked), ["id", "lang"]).where("text is not null").dropDuplicates(["id", "lang"])

    @F.arrow_udf("struct<at: binary, share: binary>")
    def counted(column: pa.Array) -> pa.Array:
        at, share = [], []
        for block in features(column.to_pylist()):
            for row in block:
                some = np.flatnonzero(row)
                at.append(some.astype(np.uint16).tobytes())
                share.append(row[some].tobytes())
        return pa.StructArray.from_arrays([pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["at", "share"])

    found = sorted(sample.select("mark", "id", "lang", counted("text").alias("f")).collect(), key=lambda r: (r["mark"], r["id"], r["lang"]))
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    number = {name: i for i, name in enumerate(languages)}
    return fit(Sparse([tuple(r["f"]) for r in found]), np.array([number[r["lang"]] for r in found]), languages)


def predicted(text: Column, model: Model | None) -> Column:
    """struct(lang, score, rejected): `und` with score 0, rejected, for null texts and texts without letters (and for
    all without a model); else the likeliest language and its probability, rejected below the model's least score."""
    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        bodies = texts.to_pylist()
        lang, score, rejected = [UNKNOWN] * len(bodies), np.zeros(len(bodies)), np.ones(len(bodies), bool)
        which = [i for i, t in enumerate(bodies) if t and LETTER.search(t)] if model else []
        left = iter(which)
        for block in features([bodies[i] for i in which]):
            p = model.scores(block)
            for best, row, i in zip(p.argmax(axis=1), p, left):            # the block first, so that no index is lost
                lang[i], score[i], rejected[i] = model.languages[best], row[best], row[best] < model.least
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                          ["lang", "score", "rejected"])
    return run(text.cast("string"))


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) per row, by a model trained on the rows not held out.

    The prediction sees the text alone. Repeated rows each get their row; other columns are not used. An empty table
    gives no rows; a table without labels predicts `und` throughout.
    """
    model = train(docs, id, text, lang)
    return (docs.select(F.col(id).alias("_id"), predicted(F.col(text), model).alias("p"))
            .select(F.col("_id").alias(id), held_out(F.col("_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected"))


def keep_identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language is identified: all columns, without rejected rows."""
    model = train(docs, id, text, lang)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), predicted(F.col(text), model).alias("_p")).where("not _p.rejected").select("_row.*")
