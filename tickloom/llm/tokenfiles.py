"""Token ids in compressed files with a shared dictionary and an index of offsets.

Format: a Parquet table in ascending document order, one row per shard. A shard has the concatenated zstandard
frames of its documents (each document's ids, little-endian unsigned 32-bit, compressed on their own with the shared
dictionary) and three arrays beside them: ids of documents, where each frame starts, and its number of ids; further
first_id and last_id, by which a reader finds a document's shard from the file's statistics, its number of
documents and ids, and the SHA-256 of the dictionary. The dictionary lies in a table of one row beside the shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.words import serialized

SHARD = 4 << 20            # bytes of frames after which a shard ends
SAMPLE = 2_000             # documents the dictionary is trained on, at most
SAMPLE_BYTES = 16 << 10    # bytes of ids taken from each of them, at most
DICTIONARY = 64 << 10      # bytes of the dictionary, at most
WORDS = 256 << 20          # bytes of words and ids that a worker keeps


def train_dictionary(docs: DataFrame, tokenizer: str, id: str, text: str, end: int) -> bytes:
    """A dictionary from the ids of at most `SAMPLE` documents, those first in the order of their id's hash.

    Too few or too short samples to train on are the dictionary themselves, as plain content.
    """
    mark = F.xxhash64(id)
    picked = docs.select(mark.alias("_mark")).distinct().orderBy("_mark").limit(SAMPLE)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([serialized(tokenizer, t.as_py(), end, WORDS)[:SAMPLE_BYTES] for t in texts], pa.binary())

    sample = (docs.select(mark.alias("_mark"), F.col(text).cast("string").alias("_text"))
              .join(F.broadcast(picked), "_mark", "left_semi").dropDuplicates(["_mark"])
              .select("_mark", ids("_text").alias("ids")).collect())
    samples = [bytes(r["ids"]) for r in sorted(sample, key=lambda r: r["_mark"])]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY]


def shared_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 2,
                 level: int = 3) -> None:
    """Writes the ids of all documents below `path`, in ascending id order (null ids first).

    A document's ids are those of the tokenizers file `tokenizer` (tokens end at white space), then `end`; null and
    empty texts are `end` alone. Repeated rows are documents of their own; rows equal in id are ordered by their
    text's hash. Other columns are not used. An empty table gives a table without shards.
    """
    spark = docs.sparkSession
    content = train_dictionary(docs, tokenizer, id, text, end)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, bytearray(content))], "hash string, content binary").coalesce(1).write.parquet(
        f"{path}/dictionary")
    kind = docs.schema[id].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared_dictionary(content), write_content_size=True)
        number, frames, held, ids, starts, counts, id_type = 0, [], 0, [], [], [], None

        def shard():
            row = [[number], [ids[0]], [ids[-1]], [len(ids)], [sum(counts)], [digest], [b"".join(frames)],
                   [ids], [starts], [counts]]
            types = [pa.int64(), id_type, id_type, pa.int64(), pa.int64(), pa.string(), pa.binary(),
                     pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = serialized(tokenizer, body.as_py(), end, WORDS)
                frame = packer.compress(raw)
                ids.append(key)
                starts.append(held)
                counts.append(len(raw) // 4)
                frames.append(frame)
                held += len(frame)
                if held >= SHARD:
                    yield shard()
                    number, frames, held, ids, starts, counts = number + 1, [], 0, [], [], []
        if ids:
            yield shard()

    names = ["shard", "first_id", "last_id", "documents", "ids", "dictionary", "frames", "doc_ids", "starts", "counts"]
    schema = (f"shard bigint, first_id {kind}, last_id {kind}, documents bigint, ids bigint, dictionary string, "
              f"frames binary, doc_ids array<{kind}>, starts array<bigint>, counts array<bigint>")
    order = ["_id", "_tie"]
    (docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"), F.xxhash64(text).alias("_tie"))
     .repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
     .mapInArrow(shards, schema).withColumn("part", F.spark_partition_id())
     .write.option("compression", "none").parquet(f"{path}/shards"))


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    digest, content = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError(f"{path}: the dictionary does not have its hash")
    return digest, bytes(content)


def _frames(digest: str, content: bytes, wanted=None):
    """A function for `mapInArrow` that unpacks shards (dictionary, frames, doc_ids, starts, counts, start)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor(dict_data=shared_dictionary(content))
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError("a shard was written with another dictionary")
                starts, counts, ids = row["starts"], row["counts"], row["doc_ids"]
                stops = [*starts[1:], len(row["frames"])]
                before = row["start"] + np.concatenate([[0], np.cumsum(counts)[:-1]])
                for at in range(0, len(ids), 1_000):
                    chosen = [i for i in range(at, min(at + 1_000, len(ids))) if wanted is None or ids[i] == wanted]
                    bodies = [reader.decompress(row["frames"][starts[i]:stops[i]]) for i in chosen]
                    if any(len(b) != 4 * counts[i] for b, i in zip(bodies, chosen, strict=True)):
                        raise ValueError("a frame does not hold the ids its index names")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in chosen], id_type), pa.array([before[i] for i in chosen], pa.int64()),
                         pa.array([counts[i] for i in chosen], pa.int64()), pa.array(bodies, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])
    return run


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `start`: the ids before each, from totals per part and per shard."""
    shards = spark.read.parquet(f"{path}/shards")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (shards.groupBy("part").agg(F.sum("ids").alias("ids"))
             .select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (shards.select("part", "shard", "ids").join(parts, "part")
              .select("part", "shard", (F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("start")))
    return shards.join(starts, ["part", "shard"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: start is the number of ids of all documents before it."""
    digest, content = read_dictionary(spark, path)
    kind = spark.read.parquet(f"{path}/shards").schema["first_id"].dataType.simpleString()
    return (_placed(spark, path).select("dictionary", "frames", "doc_ids", "starts", "counts", "start")
            .mapInArrow(_frames(digest, content), f"doc_id {kind}, start bigint, n_tokens bigint, ids binary"))


def read_document(spark: SparkSession, path: str, doc_id) -> DataFrame:
    """(doc_id, n_tokens, ids) of one document: only shards whose id range holds it are read, only its frame unpacked."""
    digest, content = read_dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    kind = shards.schema["first_id"].dataType.simpleString()
    holds = (F.col("first_id") <= F.lit(doc_id)) & (F.col("last_id") >= F.lit(doc_id))
    return (shards.where(holds).select("dictionary", "frames", "doc_ids", "starts", "counts", F.lit(0).cast("bigint").alias("start"))
            .mapInArrow(_frames(digest, content, doc_id), f"doc_id {kind}, start bigint, n_tokens bigint, ids binary").drop("start"))
