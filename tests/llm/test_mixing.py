from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm.mixing import mix, mixed_documents, words


def shared_out(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()) * share, set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / (sum(weight[s] for s in order if s not in full) or 1)
        over = {s for s in order if s not in full and weight[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1_000, "c": 500, None: 30}, {"x": 7}, {"a": 0, "b": 5}, {"é": 50, "z": 60, "Z": 70}])
def test_budgets(spark, sizes):
    rows = [(s, 1 + i % 3) for s, n in sizes.items() for i in range(n)] + [(s, 0) for s in sizes]
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id bigint, source string, size bigint")
    got = mix(df, "doc_id", "source", "size").collect()
    real = defaultdict(int)
    for s, n in rows:
        real[s] += n
    want = shared_out(dict(real))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == real[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    for s, t in want.items():
        assert taken[s] == int(round(t, 6)) and abs(taken[s] - t) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(df.repartition(3), "doc_id", "source", "size").collect()), key=str)


def test_documents_follow_what_is_taken(odd_docs, no_docs, small):
    for docs in (odd_docs, small):
        out = mixed_documents(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("m"))
        want = {k: v for k, v in mix(sized.select("doc_id", "source", "size"), "doc_id", "source", "size").groupBy("source").agg(F.sum("taken")).collect()}
        got = {k: v for k, v in out.groupBy("source").agg(F.sum(words(F.col("text")))).collect()}
        assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
    assert mixed_documents(no_docs).collect() == [] and mix(no_docs.withColumn("size", F.lit(1)), "doc_id", "source", "size").collect() == []


def test_cut_text_keeps_its_white_space(spark):
    df = spark.createDataFrame([(1, "a\n b  c\td e", "s", 11)], "doc_id bigint, text string, source string, n_chars bigint")
    got = sorted(mixed_documents(df).collect(), key=lambda r: -len(r["text"]))
    assert [(r["text"], r["n_chars"]) for r in got] == [("a\n b  c\td e", 11), ("a\n b", 4)]


def test_extra_columns_of_any_type(spark):
    docs = spark.createDataFrame([(1, "a b", "s", {"k": 1}, [{"k": 2}]), (1, "a b", "s", None, None)],
                                 "doc_id int, text string, source string, m map<string, int>, size array<map<string, int>>")
    out = mixed_documents(docs, share=2.0)
    assert out.columns == docs.columns and sorted(str(r["m"]) for r in out.collect()) == ["None", "None", "{'k': 1}", "{'k': 1}"]
