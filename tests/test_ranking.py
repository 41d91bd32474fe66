import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ranking as K


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most of the rows, heavy ties, nulls, and a group of one."""
    rng = random.Random(5)
    data = [("hot", float(rng.choice([1, 2, 2, 3])) if rng.random() < 0.5 else rng.gauss(0, 10)) for _ in range(4000)]
    data += [("cool", rng.uniform(0, 1)) for _ in range(101)] + [("one", 4.0), ("none", None), ("cool", None)]
    pdf = pd.DataFrame(data, columns=["g", "v"])
    return spark.createDataFrame([(i, g, None if pd.isna(v) else v) for i, (g, v) in enumerate(data)],
                                 "id int, g string, v double"), pdf


def test_percent_rank_of_any_group(skewed):
    df, pdf = skewed
    want = pdf.groupby("g")["v"].rank(pct=True)
    got = {r["id"]: r["p"] for r in K.pct_rank(df, ["g"], "v", "p", ranges=8).collect()}
    assert len(got) == len(pdf)
    for i, w in want.items():
        assert got[i] is None if pd.isna(w) else got[i] == pytest.approx(w)
    whole = {r["id"]: r["p"] for r in K.pct_rank(df, [], "v", "p").collect()}
    for i, w in pdf["v"].rank(pct=True).items():
        assert whole[i] is None if pd.isna(w) else whole[i] == pytest.approx(w)


def test_small_group_rank_agrees(skewed):
    df, pdf = skewed
    want = pdf.groupby("g")["v"].rank(pct=True)
    got = {r["id"]: r["p"] for r in df.withColumn("p", K.pct_rank_in([F.col("g")], F.col("v"))).collect()}
    for i, w in want.items():
        assert got[i] is None if pd.isna(w) else got[i] == pytest.approx(w)


def test_exact_median(skewed):
    df, pdf = skewed
    got = {r["g"]: r["median"] for r in K.exact_median(df, ["g"], "v").collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert got[g] == pytest.approx(statistics.median(part["v"]))


def test_top_k_and_bounded_sample(spark):
    df = spark.range(10_000).withColumn("g", F.col("id") % 3)
    top = K.top_k(df, ["g"], 2, [F.col("id").desc()]).collect()
    assert sorted(r["id"] for r in top) == [9994, 9995, 9996, 9997, 9998, 9999]
    for n in (0, 1, 777, 10_000, 50_000):
        ids = [r["id"] for r in K.cap_rows(df, n, ["id"]).collect()]
        assert len(ids) == len(set(ids)) == min(n, 10_000)
    a, b = (sorted(r["id"] for r in K.cap_rows(d, 500, ["id"]).collect()) for d in (df, df.repartition(7)))
    assert a == b
    assert a != sorted(r["id"] for r in K.cap_rows(df, 500, ["id"], seed=1).collect())
