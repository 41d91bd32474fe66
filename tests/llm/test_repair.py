"""Conversation repair against another solver: from the end, over the states of the regular expression, and all edits."""

import re
import zlib
from hashlib import sha256
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm.queries import QUERIES
from tickloom.llm.repair import Automaton, Repair, damaged_turns, repair_conversations

NAMES = {"u": "user", "a": "assistant"}
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
VALID = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        v = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not v else "duplicate" if (role, text) in seen else "truncated" if v[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def solve(rows, found):
    """(cost, audit, digest), row by row from the end."""
    def inserted(best):
        more = True
        while more:
            more = False
            for (state, role), to in STEP.items():
                if role in NAMES and to in best:
                    new = (best[to][0] + 5, "I" + best[to][1], (NAMES[role] + ":", *best[to][2]))
                    if state not in best or new[:2] < best[state][:2]:
                        best[state], more = new, True
        return best

    after = inserted({0: (0, "", ()), 3: (0, "", ())})
    for (_, role, text), fault in zip(reversed(rows), reversed(found), strict=True):
        best = {}
        for state in range(4):
            ways = [(after[state][0] + 2, "D" + after[state][1], after[state][2])] if state in after else []
            for initial, cost, edit, name in ((role[:1], 0, "K", role), ("u", 1, "R", "user"), ("a", 1, "R", "assistant")):
                to = STEP.get((state, initial))
                if fault in ("", "truncated") and to in after:
                    ways.append((after[to][0] + cost + 5 * bool(fault), edit + after[to][1], (f"{name}:{text}", *after[to][2])))
            if ways:
                best[state] = min(ways, key=lambda w: w[:2])
        after = inserted(best)
    cost, audit, lines = after[0]
    return cost, audit, sha256("\n".join(lines).encode()).hexdigest()


def parsed(rows, found):
    parse = Repair()
    for (_, role, text), fault in zip(rows, found, strict=True):
        parse.row(role, text, role[:1], fault)
    return parse.result()


ROWS = st.lists(st.tuples(st.just(0), st.sampled_from(["user", "assistant", "system", "tool", ""]),
                          st.sampled_from(["a.", "b", " ", "c!", "d?", "e."])), max_size=12)


@given(ROWS)
@settings(max_examples=400, deadline=None)
def test_parse_equals_the_other_solver(rows):
    found = faults(rows)
    assert parsed(rows, found) == solve(rows, found)


def test_parse_equals_all_edits():
    """Every sequence of edits with at most two insertions, for all short conversations."""
    for n in range(4):
        for roles in product(("user", "assistant", "system"), repeat=n):
            rows = [(i, r, f"{i}{'.' if i != 1 else ''}") for i, r in enumerate(roles)]
            found = faults(rows)
            best = None
            for edits in product("KuaD", repeat=n):
                for inserts in product(("", "u", "a", "ua"), repeat=n + 1):
                    line, cost, audit = "", 0, ""
                    for i in range(n + 1):
                        line, cost, audit = line + inserts[i], cost + 5 * len(inserts[i]), audit + "I" * len(inserts[i])
                        if i < n and edits[i] == "D":
                            cost, audit = cost + 2, audit + "D"
                        elif i < n:
                            line += rows[i][1][0] if edits[i] == "K" else edits[i]
                            cost += (edits[i] != "K") + 5 * bool(found[i])
                            audit += "K" if edits[i] == "K" else "R"
                    if VALID.fullmatch(line) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
            assert parsed(rows, found)[:2] == best


def test_automaton_accepts_the_roles():
    machine = Automaton()
    for n in range(6):
        for roles in product("sua", repeat=n):
            node = machine.start
            for r in roles:
                node = node and machine.shift(node, r)
            assert bool(node and machine.accepts[node[0]]) == bool(VALID.fullmatch("".join(roles)))


def test_memory_of_a_long_conversation_stays_short():
    parse = Repair()
    for i in range(20_000):
        parse.row("ua"[i % 2], f"{i}.", "ua"[i % 2], "")
        assert len(parse.held) < 8 and all(len(t[1]) < 12 for t in parse.tops.values())
    assert parse.result()[:2] == (0, "K" * 20_000)


def by_loops(rows):
    """{conv_id: the other columns} from (conv_id, turn, role, text)."""
    kept = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        lines = kept.setdefault(conv, [])
        if kind:
            role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            lines += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, lines in kept.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found, turns = faults(lines), [r[0] for r in lines if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(lines, lines[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), *solve(lines, found))
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == by_loops(rows) and all(any(e in r[6] for r in got.values()) for e in "KRD")


def test_odd_rows(spark):
    long = "word " * 200_000 + "."
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, 3, "assistant", None),
            (1, 3, "assistant", "b."), (1, 9, "", "x."), (2, 0, "user", long), (2, 1, "assistant", "ok"), (3, 0, None, ""),
            *[(4, i, "user", "same.") for i in range(40)], *[(5, i % 3, "assistant", f"{i}.") for i in range(30)]]
    turns = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, fault string, nth bigint")
    got = repair_conversations(damaged_turns(turns)).collect()
    assert len(got) == 6 and {r["conv_id"]: tuple(r)[1:] for r in got} == by_loops(rows)


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair_conversations(damaged_turns(none)).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "x.")], none.schema)
    assert tuple(repair_conversations(damaged_turns(one)).first()) == (dropped, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
