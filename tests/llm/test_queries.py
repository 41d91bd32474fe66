"""The registered queries against their SQL, and the pipeline's stages against brute force."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm.langid import identify
from tickloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match_the_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = Counter(tuple(map(rounded, r)) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(map(rounded, r)) for r in df.select(*columns).collect()) == want


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "source mix", "packing"]


def test_pipeline_stages(spark, small, tmp_path):
    """Stage by stage on its own input; near copies, the mix and packing have brute-force tests of their own."""
    docs, kept = small, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        assert out.columns == small.columns
        kept.append((docs, out))
        docs = out
    first, known = kept[0]
    rejected = {r["doc_id"] for r in identify(first).where("rejected").collect()}
    assert {r["doc_id"] for r in first.collect()} - rejected == {r["doc_id"] for r in known.collect()}
    before, after = kept[1]
    texts = [r["text"] for r in after.collect()]
    assert len(texts) == len(set(texts)) and {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    pieces = corpus_pipeline.packing(spark, docs, SF)
    fills = pieces.groupBy("sequence_id").agg(F.sum("length").alias("fill")).collect()
    assert all(r["fill"] == 4096 or r["fill"] & (r["fill"] - 1) == 0 for r in fills)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == pieces.columns and whole.agg(F.sum("length")).first() == pieces.agg(F.sum("length")).first()


def test_pipeline_of_nothing_and_of_odd_rows(spark, no_docs, odd_docs):
    for docs in (no_docs, odd_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        corpus_pipeline.packing(spark, docs, SF).collect()
