from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm.chat import escape, prefix_tree, read_conversations, unescape

TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, node int"


def tree_of(rows):
    """Spans of every distinct beginning, depth first, by plain recursion over sorted conversations."""
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda y: (str(y[0]), y[1] is not None, y[1] or 0, y[2] or "", y[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    return convs


def test_prefix_tree(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "more"),
            (2, 0, "system", "be"), (2, 1, "user", "hi"), (2, 2, "assistant", "no <s>"), (3, 0, "system", "be"), (3, 1, "user", "x"),
            (4, 0, "system", "be"), (4, 1, "user", "hi"), (4, 2, "assistant", "yo"), (5, 0, "user", "alone"), (6, None, None, None), (6, 2, "a\nb", "")]
    nodes, paths = prefix_tree(spark.createDataFrame([(*r, 0, 0) for r in rows], TURNS))
    by = {r["node"]: r for r in nodes.collect()}
    convs = tree_of(rows)
    beginnings = {tuple(c[:i + 1]) for c in convs.values() for i in range(len(c))}
    assert len(by) == len(beginnings)                                    # each emitted once
    for tree in {n["tree"] for n in by.values()}:                        # without a gap, parents before children
        at = 0
        for n in sorted((n for n in by.values() if n["tree"] == tree), key=lambda n: n["token_start"]):
            assert n["token_start"] == at and n["n_chars"] == len(n["formatted"])
            at += n["n_chars"]
    open_ = []
    for n in sorted(by.values(), key=lambda n: n["node"]):               # depth first
        del open_[n["depth"] - 1:]
        assert (open_[-1] if open_ else None) == n["parent"]
        open_.append(n["node"])
    way = {}
    for r in paths.orderBy("conv_id", "depth").collect():
        way.setdefault(r["conv_id"], []).append(by[r["node"]])
    for conv, turns in convs.items():
        assert [n["depth"] for n in way[conv]] == list(range(1, len(turns) + 1))
        at, seen = 0, []
        for n in way[conv]:
            assert n["position_start"] == at
            assert sorted(i for s in n["attends"] for i in range(*s)) == seen
            assert len({tuple(s) for s in n["attends"]}) == len(n["attends"])
            at += n["n_chars"]
            seen = sorted([*seen, *range(n["token_start"], n["token_start"] + n["n_chars"])])
            shown = n["formatted"][n["loss_start"]:n["loss_stop"]]
            assert bool(shown) == (n["role"] == "assistant")
    got = {r["conv_id"]: r for r in read_conversations(nodes, paths).collect()}
    for conv, turns in convs.items():
        assert got[conv]["turns"] == "".join(f"{r}\n{x}\n" for r, x in turns) and got[conv]["n_turns"] == len(turns)
        assert got[conv]["loss"] == "".join(x for r, x in turns if r == "assistant")


def test_equal_null_and_no_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "assistant", "x" * 300_000)]
    turns = spark.createDataFrame([(*r, 0, 0) for r in rows], TURNS)
    nodes, paths = prefix_tree(turns)
    assert nodes.count() == 3 and paths.count() == 5
    assert {(r["conv_id"], r["n_turns"]) for r in read_conversations(nodes, paths).collect()} == {(None, 2), (1, 1), (2, 1), (3, 1)}
    assert read_conversations(*prefix_tree(turns.where("conv_id > 9"))).collect() == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "[", "\\", "\\\\", "s>", "/s>", "t>", "INST]", "/INST]", "<s>", "</s>", "[INST]", "<<SYS>>",
                                          "|im_end|>", "a", "\n", "é", "$1"]), max_size=12).map("".join), min_size=30, max_size=30))
def test_escaping_is_reversible_and_complete(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escape(F.col("t")))
    for t, e, back in df.withColumn("b", unescape(F.col("e"))).collect():
        assert back == t and not any(c in e for c in ("<s>", "</s>", "<t>", "[INST]", "[/INST]", "<|im_end|>"))
