"""Conversations brought back to a role grammar by the cheapest edits: generalised LR parsing with repair.

A conversation's rows are read in order by an LR automaton of the grammar of roles. Its stacks form a graph: nodes hold a
state and the node below, and parses share what lies below. At each row every stack top tries all edits at once (keep, rerole, delete,
and insert at any place); of equal tops the one of least (cost, audit) stays. In this grammar a top alone decides which rows
may follow, so nothing is lost, and there are never more tops than states.

Rows come sorted from one shuffle and pass by the tops. What all tops agree on is settled and leaves the memory, so a
conversation of any length is read in one pass with a short memory: its audit and its digest are sequences by nature.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import WORD

# a conversation: nothing, or pairs of a user's and an assistant's row, perhaps after a system row
GRAMMAR = (("conversation", ()), ("conversation", ("pairs",)), ("conversation", ("s", "pairs")),
           ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("u", "a")))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# a top this much dearer than one after a user's row or a pair never wins: that one reaches any place of the grammar with an
# inserted row, and does without what only the beginning allows, a kept system row, by deleting it
APART = INSERT + DELETE

Node = tuple              # (state, node below or None)


class Automaton:
    """LR(0) item sets of the grammar with the moves of each state. Reductions within a conversation need no look-ahead."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("", (grammar[0][0],)), *grammar)
        heads = {head for head, _ in grammar}
        first = self.closure(frozenset({(0, 0)}), heads)
        states, self.go, self.reduces, self.accepts = [first], [], [], []
        for items in states:                               # grows while it is read
            moves: dict[str, frozenset] = {}
            for rule, dot in items:
                body = self.rules[rule][1]
                if dot < len(body):
                    moves[body[dot]] = moves.get(body[dot], frozenset()) | {(rule, dot + 1)}
            to = {}
            for symbol, kernel in moves.items():
                target = self.closure(kernel, heads)
                if target not in states:
                    states.append(target)
                to[symbol] = states.index(target)
            self.go.append(to)
            done = [rule for rule, dot in items if dot == len(self.rules[rule][1])]
            ends = [rule for rule in done if self.rules[rule][0] == grammar[0][0]]
            self.accepts.append(bool(ends))
            inner = [rule for rule in done if rule and rule not in ends]
            self.reduces.append(inner[0] if inner else None)
        self.start: Node = (0, None)

    def closure(self, items: frozenset, heads: set) -> frozenset:
        todo, found = list(items), set(items)
        while todo:
            rule, dot = todo.pop()
            body = self.rules[rule][1]
            if dot < len(body) and body[dot] in heads:
                new = {(i, 0) for i, (head, _) in enumerate(self.rules) if head == body[dot]} - found
                found |= new
                todo.extend(new)
        return frozenset(found)

    def shift(self, node: Node, symbol: str) -> Node | None:
        """The top after a role's initial, with all reductions that follow; None if the state has no such move."""
        state = self.go[node[0]].get(symbol)
        if state is None:
            return None
        node = (state, node)
        while (rule := self.reduces[node[0]]) is not None:
            head, body = self.rules[rule]
            for _ in body:
                node = node[1]
            node = (self.go[node[0]][head], node)
        return node


AUTOMATON = Automaton()
EDITABLE = tuple(ROLES)


class Repair:
    """One conversation's parse: `row` takes rows in order, `result` ends it.

    Tops by state: (cost, edits not yet settled, node). Edits: K keep, R rerole, D delete, I insert. An edit's role follows
    from the top it is made on, so equal edits are equal repairs.
    """

    def __init__(self):
        self.tops = {AUTOMATON.start[0]: (0, "", AUTOMATON.start)}
        self.held: deque = deque()                         # rows whose edits are open
        self.settled: list[str] = []
        self.node, self.digest, self.some = AUTOMATON.start, sha256(), False
        self.insert()

    def offer(self, tops: dict, node: Node, cost: int, edits: str) -> bool:
        best = tops.get(node[0])
        if best is not None and best[:2] <= (cost, edits):
            return False
        tops[node[0]] = (cost, edits, node)
        return True

    def insert(self) -> None:
        """Rows without text before the next one, while that makes a top cheaper."""
        more = True
        while more:
            more = False
            for cost, edits, node in list(self.tops.values()):
                for role in EDITABLE:
                    to = AUTOMATON.shift(node, role)
                    if to is not None:
                        more |= self.offer(self.tops, to, cost + INSERT, edits + "I")

    def row(self, role: str, text: str, initial: str, fault: str) -> None:
        tops: dict = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for cost, edits, node in self.tops.values():
            self.offer(tops, node, cost + DELETE, edits + "D")
            if fault in ("", "truncated"):
                to = AUTOMATON.shift(node, initial)
                if to is not None:
                    self.offer(tops, to, cost + extra, edits + "K")
                for other in EDITABLE:
                    to = AUTOMATON.shift(node, other)
                    if to is not None:
                        self.offer(tops, to, cost + extra + REROLE, edits + "R")
        self.tops = tops
        self.insert()
        least = min((t[0] for t in self.tops.values() if self.free(t[2])), default=None)
        if least is not None:
            self.tops = {s: t for s, t in self.tops.items() if t[0] <= least + APART}
        self.held.append((role, text))
        self.settle(commonprefix([t[1] for t in self.tops.values()]))

    @staticmethod
    def free(node: Node) -> bool:
        """Whether the top comes after a user's row or a pair."""
        return "a" in AUTOMATON.go[node[0]] or (AUTOMATON.accepts[node[0]] and node[1] is not None)

    def settle(self, edits: str) -> None:
        """Applies edits that all tops share."""
        if not edits:
            return
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.held.popleft()
            if edit == "D":
                continue
            initial = role[:1]
            if edit != "K":
                initial = next(r for r in EDITABLE if AUTOMATON.shift(self.node, r) is not None)
                role = ROLES[initial]
            self.node = AUTOMATON.shift(self.node, initial)
            self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True
        self.settled.append(edits)
        self.tops = {s: (cost, e[len(edits):], node) for s, (cost, e, node) in self.tops.items()}

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the cheapest repair, ties to the least audit."""
        cost, edits, _ = min(t for s, t in self.tops.items() if AUTOMATON.accepts[s])
        self.settle(edits)
        return cost, "".join(self.settled), self.digest.hexdigest()


def damaged_turns(turns: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) with a fault put into some, picked by a hash of conversation and turn.

    Nulls of role and text count as one space, in the hash those of conversation and turn do. A dropped row stays with
    `gone` set, so that its conversation does.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return (rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
            .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
            .select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone")))


def with_faults(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, gone) sorted by conversation and turn (nulls first) in partitions that hold
    conversations whole, with `fault`: blank, duplicate, truncated, or empty. One shuffle; rows equal in turn are in order of
    role and text."""
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(~F.col("text").rlike(WORD), "blank").when(F.col("nth") > 1, "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise(""))
    return (turns.repartition("conv_id").withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault)
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "nth")
            .select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), "fault", "gone"))


RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


def repair_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow` over `with_faults`: one row of `RESULT` per conversation."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    out: list[tuple] = []
    group: object = ...
    parse, counts, illegal, before, low, high, distinct = None, {}, 0, "", None, None, 0

    def end() -> None:
        if group is not ...:
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((group, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, *parse.result()))

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 6 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)
        out.clear()
        return batch

    for batch in batches:
        for conv, turn, role, text, initial, fault, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group is ... or conv != group:
                end()
                group, parse, counts = conv, Repair(), dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
                illegal, before, low, high, distinct = 0, "", None, None, 0
            if gone:
                continue
            counts[fault] += 1
            if before:
                illegal += before + initial not in LEGAL
            before = initial or "-"
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
            parse.row(role, text, initial, fault)
        if out:
            yield rows()
    end()
    if out:
        yield rows()


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row of `RESULT` per conversation of `turns` (conv_id, turn, role, text): faults found and the cheapest repair.

    Rows may carry `gone`: such rows are not read, but their conversation is named. Needs role and text without nulls
    (`damaged_turns` sees to that); null conversations are one conversation, null turns come first and count for no gap. Rows
    equal in turn are in order of role and text. A conversation without rows left has zeros, an empty audit and the digest
    of nothing. No rows: no rows. Other columns are not used.
    """
    if "gone" not in turns.columns:
        turns = turns.withColumn("gone", F.lit(False))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "gone")
    return with_faults(rows).mapInArrow(repair_turns, RESULT)
