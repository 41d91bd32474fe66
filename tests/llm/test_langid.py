import zlib

import numpy as np

from tickloom.llm import langid
from tickloom.llm.langid import Sparse, cleaned, features, identify, keep_identified, shares, subwords, train


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = identify(docs.select("doc_id", "text", "lang")).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    test = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in test) > 0.98 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got) and np.mean([r["rejected"] for r in got]) < 0.01


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    from pyspark.sql import functions as F
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(identify(docs).collect()) == sorted(identify(changed).collect())


def test_odd_rows(odd_docs, no_docs):
    got = identify(odd_docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and sum(r["doc_id"] == 7 for r in got) == 2
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (3, 4, 5, 7))
    assert by[None]["held_out"] is False and by[6]["lang_pred"] != "und"
    assert identify(no_docs).collect() == [] and keep_identified(no_docs).collect() == []
    unlabelled = odd_docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}
    kept = keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} <= {1, 2, 6, 8, None}


def test_long_texts_count_whole(monkeypatch):
    text = "ein langer Text über alles Mögliche " * 400
    whole = shares(subwords([cleaned(text)]))
    monkeypatch.setattr(langid, "AT_ONCE", 1_000)
    pieces = next(features([text]))
    assert np.abs(whole - pieces).sum() < 0.02                  # runs at the seams count twice
    assert len(list(features(["a", text, "b"]))) == 3


def test_every_label_is_learned(spark, monkeypatch):
    """150 languages, each with words of its own; few texts of each fit in the sample, but none is left out."""
    rows = [(150 * k + n, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}x{chr(97 + (n * 7 + j) % 26)}" for j in range(12)), f"l{n:03}")
            for k in range(12) for n in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE", 450)
    model = train(docs)
    assert len(model.languages) == 150
    monkeypatch.setattr(langid, "SAMPLE", 20)                   # fewer than languages: one text of each all the same
    assert len(train(docs).languages) == 150


def test_sparse_rows_and_plain_softmax():
    """Predictions of the model against the same worked out text by text, from a table of subwords by plain loops."""
    texts = ["die Katze sitzt", "the cat sits", "le chat dort", "der Hund", "a dog", "un chien"] * 6
    x = np.concatenate(list(features(texts)))
    sparse = Sparse([(np.flatnonzero(r).astype(np.uint16).tobytes(), r[np.flatnonzero(r)].tobytes()) for r in x])
    assert (sparse[np.arange(len(texts))] == x).all()
    y = np.array([0, 1, 2] * 12)
    model, same = langid.fit(sparse, y, ["de", "en", "fr"]), langid.fit(x, y, ["de", "en", "fr"])
    assert (model.table == same.table).all() and model.least == same.least and model.temperature == same.temperature
    for text, got in zip(texts[:6], model.scores(x[:6]), strict=True):
        body, hits = cleaned(text), []
        for n in (2, 3, 4):
            for i in range(len(body) - n + 1):
                code = int.from_bytes(body[i:i + n], "little")
                hits.append((code * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF)) % 2 ** 32 >> 20)
        mean = sum(model.table[h].astype(float) for h in hits) / len(hits)
        z = [(sum(mean[d] * model.layer[d, k] for d in range(len(mean))) + model.bias[k]) / model.temperature for k in range(3)]
        want = [np.exp(v) / sum(np.exp(w) for w in z) for v in z]
        assert np.allclose(got, want, atol=1e-3)
