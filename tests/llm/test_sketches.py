import hashlib
import random

from pyspark.sql import functions as F

from tickloom.llm import queries
from tickloom.llm.sketches import (as_text, containment, distinct_shingles, edited_fingerprints, merge_groups, merged,
                                   resemblance, sketch)


def test_edits_follow_descending_ids(spark):
    rows = {r["doc_id"]: r for r in queries.op2_bottom_k_sketches(spark, "/root/testdata/sf0.001").collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    for id, after in zip(order, order[1:] + order[:1], strict=True):
        text, third = docs[id], len(docs[id]) // 3
        edited = text[:len(text) - third] + docs[after][:third]
        assert rows[id]["n_chars"] == len(text)
        assert rows[id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

        def shingles(t):
            w = t.split()
            return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        a, b, c = shingles(text), shingles(edited), shingles(docs[after])
        assert abs(rows[id]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
        assert abs(rows[id]["near_next"] - (len(a & c) / len(a | c) if a | c else 1)) < 0.2
    by_text = {}
    for id, text in docs.items():
        assert by_text.setdefault(text, rows[id]["fingerprint"]) == rows[id]["fingerprint"]


def test_no_python_on_the_main_path(spark):
    plan = queries.op2_bottom_k_sketches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_estimates(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 9)}" for _ in range(6_000)]
    df = spark.createDataFrame([(" ".join(words[:4_000]), " ".join(words[2_000:]), " ".join(words[:1_000]))], "a string, b string, c string")
    s = df.select(*[sketch(F.col(c)).alias(c) for c in "abc"])
    got = s.select(resemblance(F.col("a"), F.col("b")).alias("r"), containment(F.col("c"), F.col("a")).alias("c"),
                   distinct_shingles(F.col("a")).alias("n"),
                   distinct_shingles(merged(F.col("a"), F.col("b"))).alias("both")).first()
    assert abs(got["r"] - 1 / 3) < 0.13 and got["c"] > 0.75 and abs(got["n"] - 3_996) < 1_000 and abs(got["both"] - 5_992) < 1_500


def test_merged_parts_are_the_whole(spark):
    parts = [("g", "a b c d e f g"), ("g", "f g h i j k"), ("g", None), ("h", ""), (None, "x y z"), ("g", "a b c d e f g")]
    df = spark.createDataFrame(parts, "g string, text string").withColumn("sketch", sketch(F.col("text"), k=4))
    got = {r["g"]: r["sketch"] for r in merge_groups(df, ["g"], k=4).collect()}
    every = sorted({h for r in df.where("g = 'g'").select(sketch(F.col("text"), k=99).alias("s")).collect() for h in r["s"]})
    assert got["g"] == every[:4] and got["h"] == [] and len(got[None]) == 1


def test_odd_rows(odd_docs, no_docs):
    got = edited_fingerprints(odd_docs).select("doc_id", "text", "edited", as_text(F.col("sketch")).alias("s")).collect()
    assert len(got) == 10 and sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 7 for r in got) == 2
    by = {r["doc_id"]: r for r in got}
    assert by[3]["text"] == "" and by[3]["s"] == "" and by[5]["s"] == "" and len(by[1]["s"]) == 48
    assert by[None]["edited"] == by[None]["text"][:12] + by[8]["text"][:5]              # the last is followed by the first
    assert edited_fingerprints(no_docs).collect() == []
    alone = edited_fingerprints(odd_docs.where("doc_id = 1")).first()
    assert alone["edited"] == alone["text"][:len(alone["text"]) - len(alone["text"]) // 3] + alone["text"][:len(alone["text"]) // 3]
