"""Conversations as prefix trees: shared turns are emitted once, depth first, with positions and attention spans.

A turn is written `<s>` role `<t>` text `</s>`. Control strings inside roles and texts get a backslash behind their
first character (one more, if they have some already), which reading takes away again.

A node stands for all conversations that begin with the same turns. Its key is two sums of hashes over (turn number,
role, text) from the first turn on, 128 bits that name the whole beginning. Conversations are range-sorted by their
lists of turn hashes, so those with a shared beginning lie together; a node stands where the first conversation
through it does, behind its parent. Prefix sums of lengths over that order are its place in the emitted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import running_total
from tickloom.session import saved

# control strings: the template's own, and those of common chat formats
# (the first character is `<` or `[`, and neither comes again, so that matches never overlap)
CONTROL = (r"/?s>", r"t>", r"\|[a-z_]+\|>", r"/?INST\]", r"/?SYS>>")
TAIL = "(" + "|".join(CONTROL) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])(\\*)" + TAIL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])\\(\\*)" + TAIL), F.lit(r"$1$2$3"))


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>"), escape(role), F.lit("<t>"), escape(text), F.lit("</s>"))


def turn_hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col("depth"), F.col("role"), F.col("text")).cast("decimal(38,0)")


def prefix_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of conversations given as rows of turns.

    nodes, one per distinct beginning: node (its place in the emission), tree (its root's place), parent, depth, role,
    formatted, n_chars, token_start (characters emitted before it in its tree), position_start (position of its first
    character: characters on the way from the root), loss_start and loss_stop (the part of `formatted` under the loss
    mask: an assistant's text; both 0 for other roles), and attends: the intervals of its tree's emission that its
    characters see before their own, [start, stop) each, adjoining ones merged. Tokens are code points.
    paths: (conv, depth, node).

    Turns of a conversation are ordered by turn number, null first, then by role and text. Null roles and texts are
    empty. Equal conversations share all nodes; rows of a null conversation are one conversation. Other columns are
    not used.
    """
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                     F.coalesce(text, F.lit("")).alias("text"))
    along = Window.partitionBy("conv").orderBy("turn", "role", "text")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("depth", F.row_number().over(along))
    t = saved(t.withColumn("a", F.sum(turn_hash("a")).over(so_far).cast("decimal(38,0)"))
              .withColumn("b", F.sum(turn_hash("b")).over(so_far).cast("decimal(38,0)")))

    path = F.transform(F.array_sort(F.collect_list(F.struct("depth", F.xxhash64("a", "b").alias("h")))), lambda x: x["h"])
    ranked = running_total(t.groupBy("conv").agg(path.alias("path")), ["path", "conv"], F.lit(1), "rank").select("conv", "rank")
    ranked = saved(ranked)
    on_conv = F.col("t.conv").eqNullSafe(F.col("r.conv"))
    rows = saved(t.alias("t").join(ranked.alias("r"), on_conv).select("t.*", "rank"))

    key = ["depth", "a", "b"]
    first = rows.groupBy(*key).agg(F.min("rank").alias("rank"))
    firsts = rows.join(first, [*key, "rank"]).withColumn("formatted", formatted(F.col("role"), F.col("text")))
    firsts = firsts.withColumn("n_chars", F.length("formatted").cast("bigint"))
    placed = running_total(firsts, ["rank", "depth"], F.col("n_chars"), "start")
    placed = saved(placed.withColumn("node", F.col("start")))          # no node is empty, so places differ

    seen = rows.select("conv", "rank", *key).join(placed.select(*key, "node", "start", "n_chars", F.col("rank").alias("owner")), key)
    way = Window.partitionBy("rank").orderBy("depth")
    above = way.rowsBetween(Window.unboundedPreceding, -1)
    seen = (seen.withColumn("tree", F.first("node").over(way)).withColumn("root_start", F.first("start").over(way))
            .withColumn("parent", F.lag("node").over(way))
            .withColumn("position_start", F.coalesce(F.sum("n_chars").over(above), F.lit(0)))
            .withColumn("at", F.col("start") - F.col("root_start"))
            .withColumn("last", F.lag(F.col("at") + F.col("n_chars")).over(way))
            .withColumn("run", F.sum(F.when(F.col("at") == F.col("last"), 0).otherwise(1)).over(
                way.rowsBetween(Window.unboundedPreceding, 0))))
    seen = seen.withColumn("run_start", F.min("at").over(Window.partitionBy("rank", "run")))
    behind = F.lag(F.struct(F.col("run_start").alias("start"), (F.col("at") + F.col("n_chars")).alias("stop"))).over(way)
    seen = seen.withColumn("ended", F.when(F.col("at") != F.col("last"), behind))
    seen = seen.withColumn("earlier", F.collect_list("ended").over(way.rowsBetween(Window.unboundedPreceding, 0)))
    attends = F.when(F.col("run_start") < F.col("at"), F.concat("earlier", F.array(
        F.struct(F.col("run_start").alias("start"), F.col("at").alias("stop"))))).otherwise(F.col("earlier"))
    seen = saved(seen.select("conv", "rank", "owner", "depth", "node", "tree", "parent", "position_start",
                             F.col("at").alias("token_start"), F.when(F.col("owner") == F.col("rank"), attends).alias("attends")))
    paths = seen.select(F.col("conv").alias(conv), "depth", "node")
    spans = seen.where("owner = rank").select("node", "tree", "parent", "token_start", "position_start", "attends")
    body = F.length(F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("<t>")))
    assistant = F.col("role") == "assistant"
    nodes = placed.select("node", "depth", "role", "formatted", "n_chars",
                          F.when(assistant, body).otherwise(0).alias("loss_start"),
                          F.when(assistant, F.length("formatted") - 4).otherwise(0).alias("loss_stop")).join(spans, "node")
    return nodes, paths


def read_turns(nodes: DataFrame) -> DataFrame:
    """`nodes` with read_role, read_text and loss_text, all taken from the formatted text."""
    inside = F.expr("substring(formatted, 4, length(formatted) - 7)")
    at = F.instr(inside, "<t>")                                  # escaped text holds no template mark
    return (nodes.withColumn("read_role", unescape(F.substring(inside, F.lit(1), at - 1)))
            .withColumn("read_text", unescape(F.substring(inside, at + 3, F.length(inside))))
            .withColumn("loss_text", unescape(F.expr("substring(formatted, loss_start + 1, loss_stop - loss_start)"))))


def read_conversations(nodes: DataFrame, paths: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Each conversation read back from the emitted nodes: n_turns, turns and loss text (one string each), formatted_chars."""
    turns = paths.join(read_turns(nodes).select("node", "read_role", "read_text", "loss_text", "n_chars"), "node")
    in_order = F.array_sort(F.collect_list(F.struct("depth", "read_role", "read_text", "loss_text")))
    spoken = F.transform("all", lambda x: F.concat(x["read_role"], F.lit("\n"), x["read_text"], F.lit("\n")))
    return (turns.groupBy(conv).agg(F.count("*").alias("n_turns"), in_order.alias("all"), F.sum("n_chars").alias("formatted_chars"))
            .select(conv, "n_turns", F.array_join(spoken, "").alias("turns"),
                    F.array_join(F.transform("all", lambda x: x["loss_text"]), "").alias("loss"), "formatted_chars"))
