"""Rule lists: statistics against plain loops, learning against another implementation and planted rules."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm.queries import QUERIES
from tickloom.llm.rulelists import Rule, RuleList, Test as Bound, base_failed, best_test, features, gain, judge, labelled_sample, learn, quality_list, statistics

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def by_loops(text):
    text = text or ""
    words, lines = re.findall(WORD, text), [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, again = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            again |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts(spark, odd_docs, small):
    extra = ["a b c a b c a", "x x x x x", "a b c d", "l 1\n\nl 1\n \nl 2\nl 1", "  \x85 #*$%&|<> \x0b\x0c\r a", "a b c d e f " * 30, "𝒳 𝒴 Ä"]
    docs = odd_docs.select("doc_id", "text").union(small.select("doc_id", "text")).union(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    rows = statistics(docs).withColumn("failed", base_failed()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (*(r[c] for c in COUNTS), r["failed"]) == by_loops(r["text"])


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_learned_quality_rules"](spark, SF).collect()
    assert len(got) == len(texts)
    assert all((*(r[c] for c in COUNTS), r["base_failed"]) == by_loops(texts[r["doc_id"]]) and not (r["base_failed"] and r["kept"]) for r in got)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = [(r["kept"], quality[r["doc_id"]]) for r in got if r["doc_id"] in quality and not r["base_failed"]]
    good = [kept for kept, label in passed if label == 1]
    poor = [kept for kept, label in passed if label == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.2 * len(poor)


def test_held_out_documents(spark):
    """Learned from half of the labels, the list is right for the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    rules = quality_list(docs.repartition(4), labels.where(half))
    assert rules.rules and all(r.verdict == 0 and r.tests for r in rules.rules)
    rows = statistics(docs.repartition(4).join(labels.where(~half), "doc_id")).where(~base_failed())
    found = {(r["quality"], r["v"]): r["count"] for r in rows.groupBy("quality", rules.verdict(features()).alias("v")).count().collect()}
    assert found.get((1, 0), 0) <= 0.01 * found[1, 1] and found.get((0, 1), 0) <= 0.1 * found[0, 0]


def planted(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(), rng.random(), rng.random()
        poor = a > 0.8 and b < 0.5 or c > 0.93
        rows.append((i, a, b, c, int(not poor)))
    return rows


def test_planted_rules_are_found(spark):
    rows = spark.createDataFrame(planted(4000), "id bigint, a double, b double, c double, label int")
    values = {n: F.col(n) for n in "abc"}
    rules = learn(rows, values, "label", F.col("id"))
    wrong = rows.where(rules.verdict(values) != F.col("label")).count()
    assert wrong < 80 and 1 < len(rules.rules) < 9 and rules.default == 1
    assert {t.feature for r in rules.rules for t in r.tests} >= {"a", "b", "c"}
    again = learn(rows.repartition(7), values, "label", F.col("id"))
    assert str(again) == str(rules)


def test_best_test_equals_a_search_of_all():
    rng = random.Random(5)
    for _ in range(50):
        bounds = {"a": sorted(rng.sample(range(20), 5)), "b": sorted(rng.sample(range(20), 3))}
        rows = [({"a": rng.randrange(20), "b": rng.randrange(20)}, rng.randrange(2)) for _ in range(40)]
        counts = {n: {} for n in bounds}
        for values, hit in rows:
            for n in bounds:
                counts[n].setdefault(sum(x <= values[n] for x in bounds[n]), [0, 0])[hit] += 1
        ways = []
        p0 = sum(hit for _, hit in rows)
        for n in bounds:
            for bound in bounds[n]:
                for over in (False, True):
                    left = [hit for values, hit in rows if (values[n] >= bound) == over]
                    ways.append(gain(p0, len(rows) - p0, sum(left), len(left) - sum(left)))
        found = best_test(counts, bounds)
        assert found is None and max(ways) <= 1e-9 or found and abs(gain(p0, len(rows) - p0, *found[1:]) - max(ways)) < 1e-9


def test_order_and_default():
    one = Rule((Bound("a", True, 2.0), Bound("b", False, 1.0)), 0)
    assert str(RuleList((one,), 1)) == "a >= 2 and b < 1 -> 0\nelse 1"


def test_labels_that_teach_nothing(spark, small):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    odd = spark.createDataFrame([(None, 0), (1, None), (2, 7), (10 ** 9, 0)], none.schema)
    same = small.select("doc_id", F.lit(1).alias("quality"))
    for labels in (none, odd, same):
        rows = judge(small, labels).collect()
        assert len(rows) == small.count() and all(r["kept"] != r["base_failed"] for r in rows)
    poor = judge(small, small.select("doc_id", F.lit(0).alias("quality"))).collect()
    assert not any(r["kept"] for r in poor)


def test_odd_rows_and_no_rows(spark, odd_docs, no_docs):
    labels = odd_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = judge(odd_docs.withColumn("n_words", F.lit("x")), labels).collect()
    assert len(rows) == odd_docs.count() and all(type(r["kept"]) is bool for r in rows)
    assert judge(no_docs, labels).collect() == []


def test_sample_is_bounded_and_the_same_again(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    a, b = (labelled_sample(x, "doc_id", "quality", 1000) for x in (labels, labels.union(labels).repartition(5)))
    assert 850 < a.count() < 1150 and sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("name", ["op13_learned_quality_rules"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
