import math

import numpy as np
import pytest

from tickloom.llm import vectors
from tickloom.llm.vectors import vector_groups


def brute(rows, least):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(
        x is not None and math.isfinite(x) for x in v) and any(v)}
    linked = {i: [] for i in good}
    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a != b and len(good[a]) == len(good[b]):
                x, y = good[a] / np.abs(good[a]).max(), good[b] / np.abs(good[b]).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    linked[a].append(b)
    low = {i: i for i in ids}
    for _ in ids:
        low = {i: min([low[i], *(low[j] for j in linked[i])]) for i in ids}
    return sorted((i, len(linked.get(i, [])), low.get(i, i), low.get(i, i) == i) for i, _ in rows if i is not None)


@pytest.mark.parametrize("block", [16_384, 50])
def test_matches_brute_force(spark, monkeypatch, block):
    """Clusters of several widths, chains, scaled and exact copies; small blocks take the split paths."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=8) for _ in range(60)]
    rows += [rows[i % 60] + rng.normal(size=8) * 0.25 for i in range(240)]
    rows += [rows[0] * s for s in (1, 1, 1, 2, 1e-200, 1e150)] + [-rows[0]]
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    got = vector_groups(spark.createDataFrame(table, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == brute(table, 0.9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
             (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 1.0]), (13, [7.0])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in table], "vec_id bigint, embedding array<float>, n_links int, node int")
    assert sorted(map(tuple, vector_groups(df).collect())) == brute(table, 0.9)
    unnamed = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, vector_groups(unnamed).collect()), key=str) == [(3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)]
    assert vector_groups(df.where("vec_id > 99")).collect() == []
