import numpy as np
from pyspark.sql import functions as F
import pytest
import xxhash

from tickloom.llm import simhash
from tickloom.llm.shared import Links, components, forest
from tickloom.llm.simhash import candidate_links, grid_masks, near_dedup, near_links, radius_at, shingle_set, simhash_groups


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest reachable node of each, by repeated merging."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("width", [4, 5])
def test_groups_match_brute_force(spark, small, width):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(small, width=width).collect()}
    want = {r["doc_id"]: plain_fingerprint(r["text"], width) for r in small.collect()}
    assert {i: f"{f:016x}" for i, f in want.items()} == {i: f for i, (f, _) in got.items()}
    ids = sorted(want)
    near = [(a, b) for a in ids for b in ids if a < b and (want[a] ^ want[b]).bit_count() <= 4]
    assert groups(ids, near) == {i: c for i, (_, c) in got.items()}


@pytest.mark.parametrize(("distance", "cell"), [(4, 65_536), (4, 8), (9, 65_536)])
def test_join_finds_every_link(spark, distance, cell):
    """Random points, chains of small steps and a tight group; a small `cell` sends cells through the split."""
    rng = np.random.default_rng(distance)
    points = set(rng.integers(-2 ** 63, 2 ** 63, 300).tolist())
    for start in list(points)[:40]:
        for _ in range(6):
            for bit in rng.integers(0, 63, rng.integers(1, distance + 3)).tolist():
                start ^= 1 << bit
            points.add(start)
    hub = next(iter(points))
    points |= {hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    df = spark.createDataFrame([(p,) for p in points], "first bigint")
    found = {r["node"]: r["root"] for r in components(near_links(df, distance, cell)).collect()}
    order = sorted(points)
    near = [(a, b) for a in order for b in order if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= distance]
    assert {p: found.get(p, p) for p in order} == groups(order, near)


def test_odd_rows(odd_docs, no_docs):
    got = sorted(simhash_groups(odd_docs, width=4).collect(), key=lambda r: (r[0] is None, r[0]))
    assert len(got) == 10 and got[0].component_id == got[1].component_id == 1        # case is ignored
    assert [r.component_id for r in got[2:5]] == [3, 3, 3] and got[2].fingerprint == "0" * 16
    assert [r.doc_id for r in got].count(7) == 2 and got[-1].doc_id is None and got[-1].component_id is None
    assert simhash_groups(no_docs).collect() == []


def test_dedup_keeps_one_of_each_group(spark, odd_docs, no_docs):
    kept = near_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (True, None)]
    assert near_dedup(no_docs).collect() == []


def test_candidates_lie_within_the_radius(spark):
    """Two partners per node at most, all within the radius; a group of any size hangs together."""
    rng = np.random.default_rng(2)
    rows, centre = [], rng.integers(-2 ** 63, 2 ** 63, 2)
    for i in range(400):
        first, second = (int(x) for x in (centre if i < 200 else rng.integers(-2 ** 63, 2 ** 63, 2)))
        for bit in rng.integers(0, 63, 4):
            first ^= 1 << int(bit)
        rows.append((i, first, second))
    points = spark.createDataFrame(rows, "node bigint, first bigint, second bigint")
    at = {r[0]: r[1:] for r in rows}
    bits = lambda a, b: sum(((x ^ y) & (2 ** 64 - 1)).bit_count() for x, y in zip(at[a], at[b], strict=True))
    found = [(r["u"], r["v"]) for r in candidate_links(points, 20).collect()]
    assert all(a < b and bits(a, b) <= 20 for a, b in found) and 150 < len(found) <= 800
    assert set(groups(range(200), [p for p in found if p[1] < 200]).values()) == {0}
    split = {(r["u"], r["v"]) for r in simhash.candidate_links(points, 20, cell=40).collect()}
    assert set(groups(range(200), split).values()) == {0}


def test_grids_and_radius():
    masks = grid_masks()
    assert len(masks) == 84 and all((a & (2 ** 64 - 1)).bit_count() + (b & (2 ** 64 - 1)).bit_count() == 18 for a, b in masks)
    assert radius_at(0.8) == 28


def test_components_of_long_chain_and_cycle(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 7) % 30) for i in range(30)] + [(5, 5)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == groups({n for e in edges for n in e}, edges)


def test_forest_keeps_memory_to_the_nodes():
    links = Links(most=100)
    for i in range(50):
        links.add(np.arange(30), np.full(30, i % 30))
    assert links.held <= 200
    child, root = links.tree()
    assert set(root) == {0} and sorted(child) == list(range(1, 30))
    assert [x.tolist() for x in forest(np.array([3, 9]), np.array([5, 9]))] == [[5], [3]]


def test_masks_cover_each_choice():
    masks = simhash.block_masks(4)
    assert len(masks) == 35 and np.bitwise_or.reduce(np.array(masks)) == -1


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"word{i % 313}" for i in range(20_000))
    monkeypatch.setattr(simhash, "VOTES", 1_000)
    assert simhash.majority(simhash.shingle_hashes(text.encode(), 5)) & (2 ** 64 - 1) == plain_fingerprint(text, 5)


def by_resemblance(texts, similarity=0.8):
    """Ids that stay, by exact resemblance of all pairs."""
    sets = {i: set(shingle_set((t or "").encode(), 5).tolist()) for i, t in texts.items()}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or
            len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity)]
    return set(groups(ids, near).values())


def is_nearly_all(kept, texts):
    """Nothing goes that exact resemblance of all pairs would keep, and nine in ten of what it would not keep go."""
    want = by_resemblance(texts)
    assert kept >= want and len(texts) - len(kept) >= 0.9 * (len(texts) - len(want))


def test_pipeline_stage_against_brute_force_resemblance(spark, small):
    import corpus_pipeline
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, small, "").collect()}
    is_nearly_all(kept, {r["doc_id"]: r["text"] for r in small.collect()})


def test_resemblance_decides_among_candidates(spark):
    """Copies with some words changed, from just over to just under the bound; a chain; a common beginning."""
    rng = np.random.default_rng(5)
    texts = {}
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 100_000, int(rng.integers(40, 300)))]
        for copy in range(5):
            changed = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 40))):
                changed[at] = f"c{copy}"
            texts[10 * base + copy] = " ".join(changed)
    common = " ".join(f"same{i}" for i in range(60))
    for i in range(40):
        texts[1_000 + i] = common + "".join(f" own{i}x{k}" for k in range(10 + i % 8))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    is_nearly_all({r["doc_id"] for r in near_dedup(df).collect()}, texts)


def test_rows_equal_in_id_and_text(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "other words than those before", "z"), (None, "a b c d e f", "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    first, second = (sorted(map(tuple, near_dedup(x).collect())) for x in (df, df.orderBy(F.desc("source")).repartition(3)))
    assert first == second and [r[1][0] for r in first] == ["a", "o"]


def test_pairs_beyond_two_candidates_are_found(spark):
    """Every pair of a dense group that no link has joined, but none inside a root or of sizes that rule the similarity out."""
    rng = np.random.RandomState(4)
    base, rows = int(rng.randint(0, 2**62)), []
    for i in range(60):
        a, b = base ^ (1 << int(rng.randint(0, 60))), base ^ (1 << int(rng.randint(0, 60)))
        rows.append((i, a, b, i % 3, 100 if i % 5 else 50))
    points = spark.createDataFrame(rows, "node bigint, first bigint, second bigint, root bigint, size bigint")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 != j % 3 and (i % 5 == 0) == (j % 5 == 0)}
    for cell in (simhash.CELL, 40):
        assert {(r["u"], r["v"]) for r in simhash.open_links(points, 20, 0.8, cell).collect()} == want


def test_dedup_finds_links_that_the_first_candidates_leave_out(spark, monkeypatch):
    """As if a text's two candidates were none of its near copies: the rest of the pairs must still be looked at."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words[1:]), " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nothing = lambda points, radius: points.select(points.node.alias("u"), points.node.alias("v")).where("false")
    monkeypatch.setattr(simhash, "candidate_links", nothing)
    assert {r["doc_id"] for r in near_dedup(docs).collect()} == {0, 3}


def test_open_pairs_are_decided_without_being_written(spark, monkeypatch):
    """Many near copies that are not alike: no more rows than a node has grids, and just the groups of all pairs' links."""
    rng = np.random.default_rng(8)
    base, sets = rng.integers(0, 2**64, 150, dtype=np.uint64), {}
    for i in range(70):
        own = base.copy()
        own[rng.permutation(150)[:1 + i % 30]] = rng.integers(0, 2**64, 1 + i % 30, dtype=np.uint64)
        sets[i] = np.unique(own)
    fp = {i: (simhash.majority(s), simhash.majority(simhash.remixed(s))) for i, s in sets.items()}
    points = spark.createDataFrame([(i, *fp[i], i, len(s)) for i, s in sets.items()],
                                   "node bigint, first bigint, second bigint, root bigint, size bigint").repartition(4)
    kept = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "node bigint, set binary")
    near = [(r["u"], r["v"]) for r in simhash.open_links(points, 28, 0.8).collect()]
    want = groups(sets, [(u, v) for u, v in near if simhash.alike(sets[u], sets[v]) >= 0.8])
    assert 1 < len(set(want.values())) < 70 and len(near) > 700
    written = []
    monkeypatch.setattr(simhash, "saved", lambda df: written.append(df.localCheckpoint()) or written[-1])
    for cell, most, room in ((simhash.CELL, simhash.MOST, simhash.ROOM), (40, 8, simhash.ROOM), (simhash.CELL, simhash.MOST, 4_096)):
        found = [(r["u"], r["v"]) for r in simhash.joining_links(points, lambda nodes: kept.join(nodes, "node"), 28, 0.8, cell, most, room).collect()]
        assert groups(sets, found) == want
    rows = [(r["cell"], r["node"]) for r in written[0].collect()]
    assert len(rows) == len(set(rows)) <= 84 * 70
