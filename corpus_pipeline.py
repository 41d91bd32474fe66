"""The corpus pipeline: documents whose language is known, without near copies, mixed by source and packed.

Each stage works on all that the one before it kept. `run` writes a stage's result as Parquet in the session's
shared folder (`spark.checkpoint.dir`) and reads it again as the next one's documents. Stages before the last return
the columns of `documents`; the last one packed pieces. A table without rows passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.langid import keep_identified
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.packing import pack
from tickloom.llm.queries import vocabulary
from tickloom.llm.simhash import near_dedup
from tickloom.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the identifier rejects go."""
    return keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash candidates, five-word shingles of a similarity of 0.8 or more."""
    return near_dedup(docs, width=5, similarity=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them; sources weigh 5, 2, 1 in turn and share 150 % of all words."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4,096 token ids."""
    pieces = pack(docs, vocabulary(), window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", language_id), ("SimHash near-dedup", simhash_dedup), ("source mix", source_mix), ("packing", packing)]

# language identification is a trained model, which SQL cannot state; the tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
