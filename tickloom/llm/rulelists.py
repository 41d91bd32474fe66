"""Quality rules: decision lists learned by sequential covering from labelled statistics of texts.

A document is described by counts and shares of its words, lines and characters. From labelled documents a list of rules
for the rarer label is learned, one rule after another: a conjunction of thresholds is grown test by test on two thirds of
the rows that no earlier rule covers, then cut back to the tests that hold up on the other third. The list is a chain of
`WHEN` branches, read from the top, with the commoner label at its end.

Everything runs in DataFrame functions. Learning brings counts per feature and bin to the driver, whose number is fixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import SPACE, WORD
from tickloom.session import saved

SYMBOLS = "#*$%&|<>"
WINDOW = 3             # words of a window that counts as repeated
SAMPLE = 20_000        # labelled documents that a list is learned from, about
BINS = 24              # thresholds tried per feature and label
TESTS = 4              # most tests of a rule
RULES = 24             # most rules of a list
PRECISE = 0.9          # least share of right rows, among those kept back, of a rule that enters the list


def named(value: Column, use) -> Column:
    """`use` of a value that is worked out once: the array of one is there to name it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of `width` words that occur more than once in the array, the first time included.

    Windows are compared by 64-bit hashes, sorted with their places, so that a text costs n log n whatever repeats.
    """
    def in_runs(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - width)
        windows = F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(width)]).alias("k"), i.alias("at")))
        return F.when(F.size(h) < width, F.lit(0)).otherwise(named(F.sort_array(windows), repeats))

    def repeats(s: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False))
        return named(F.sort_array(F.transform(F.filter(s, again), lambda x: x["at"])), covered)

    def covered(at: Column) -> Column:
        new = F.transform(at, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - x, F.lit(width))))
        return F.aggregate(new, F.lit(0), lambda total, n: total + n)

    return named(F.transform(words, lambda w: F.xxhash64(w)), in_runs)


def duplicate_lines(text: Column) -> Column:
    """struct(lines, repeats): the lines with a word, and those of them that equal an earlier one."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return named(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeats")))


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`df` with the counts of each text under their names after `prefix`; a null text has none of anything. Columns of
    `df` with such a name are replaced."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    counts = named(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines, length = duplicate_lines(t), F.length(t)
    found = {"n_words": F.col("_w.n_words"), "word_chars": without(t, " \t\n\x0b\x0c\r"), "n_symbols": length - without(t, SYMBOLS),
             "n_lines": F.col("_l.lines"), "n_dup_lines": F.col("_l.repeats"), "n_repeat_words": F.col("_w.n_repeat_words"),
             "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")), "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
             "n_marks": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,]+", ""))}
    named_ = {f"{prefix}{k}": v.cast("bigint") for k, v in found.items()}
    return df.withColumn("_w", counts).withColumn("_l", lines).withColumns(named_).drop("_w", "_l")


def features(prefix: str = "") -> dict[str, Column]:
    """What rules test, from `statistics`; shares of nothing are 0."""
    c = {k: F.col(f"{prefix}{k}") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
                                             "n_upper", "n_letters", "n_marks")}

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(c[a].cast("double"), c[b].cast("double")), F.lit(0.0))

    return {"words": c["n_words"].cast("double"), "mean word": share("word_chars", "n_words"), "symbols a word": share("n_symbols", "n_words"),
            "marks a word": share("n_marks", "n_words"), "words a line": share("n_words", "n_lines"),
            "repeated lines": share("n_dup_lines", "n_lines"), "repeated words": share("n_repeat_words", "n_words"),
            "capitals": share("n_upper", "n_letters"), "letters": share("n_letters", "word_chars")}


@dataclass(frozen=True)
class Test:
    """`feature` at or over the `bound`, or under it."""
    feature: str
    over: bool
    bound: float

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value >= self.bound if self.over else value < self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.over else '<'} {self.bound:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    verdict: int

    def column(self, values: dict[str, Column]) -> Column:
        out = self.tests[0].column(values)
        for test in self.tests[1:]:
            out = out & test.column(values)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests)) + f" -> {self.verdict}"


@dataclass(frozen=True)
class RuleList:
    """Rules in order, and the label where none applies."""
    rules: tuple[Rule, ...] = ()
    default: int = 1
    bounds: dict[str, list[float]] = field(default_factory=dict, compare=False)

    def verdict(self, values: dict[str, Column]) -> Column:
        out = F
        for rule in self.rules:
            out = out.when(rule.column(values), F.lit(rule.verdict))
        return out.otherwise(F.lit(self.default)) if self.rules else F.lit(self.default)

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), f"else {self.default}"])


def thresholds(rows: DataFrame, names: list[str], label: str, bins: int) -> dict[str, list[float]]:
    """Bounds to try for each feature: the quantiles of each label's rows (exact; the rows are a bounded sample)."""
    shares = F.array(*[F.lit((i + 0.5) / bins) for i in range(bins)])
    found = rows.groupBy(label).agg(*[F.percentile(F.col(f"`{n}`"), shares).alias(n) for n in names]).collect()
    return {n: sorted({float(x) for r in found for x in r[n]}) for n in names}


def place(value: Column, bounds: list[float]) -> Column:
    """How many of the bounds a value reaches."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value))


def gain(p0: int, n0: int, p: int, n: int) -> float:
    """What a test tells of the rows it leaves (first-order inductive learning's measure)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def tally(rows: DataFrame, names: list[str], label: str) -> dict[str, dict[int, list[int]]]:
    """Rows per feature, bin and label (0: other, 1: the rules'). Number of returned rows: features x bins x 2 at most."""
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`bin {n}`").alias("b")) for i, n in enumerate(names)]))
    out: dict[str, dict[int, list[int]]] = {n: {} for n in names}
    for f, b, hit, count in rows.select(bins.alias("x"), label).groupBy("x.f", "x.b", label).count().collect():
        out[names[f]].setdefault(b, [0, 0])[hit] += count
    return out


def best_test(counts: dict[str, dict[int, list[int]]], bounds: dict[str, list[float]]) -> tuple[Test, int, int] | None:
    """The test that gains most, with the rows of the rules' label and the others that it leaves."""
    best = None
    for name, by_bin in counts.items():
        p0, n0 = sum(c[1] for c in by_bin.values()), sum(c[0] for c in by_bin.values())
        if not p0 or not n0:
            return None
        under_p = under_n = 0
        for i, bound in enumerate(bounds[name]):               # bin i holds what is under bound i and not under the one before
            other, hit = by_bin.get(i, (0, 0))
            under_p, under_n = under_p + hit, under_n + other
            for over, p, n in ((False, under_p, under_n), (True, p0 - under_p, n0 - under_n)):
                score = gain(p0, n0, p, n)
                if score > 1e-9 and (best is None or score > best[0] + 1e-9):
                    best = (score, Test(name, over, bound), p, n)
    return best and best[1:]


def learn(rows: DataFrame, values: dict[str, Column], label: str, tie: Column, bins: int = BINS, tests: int = TESTS, rules: int = RULES,
          precise: float = PRECISE) -> RuleList:
    """The list for `label` (0 or 1; other rows teach nothing) from `values` of `rows`, a table of bounded size.

    `tie` is hashed to keep back every third row. Rules are for the rarer label (0, where both are as frequent). A rule
    enters the list while it is right for a share of `precise` of the kept-back rows that it covers, and covers some.
    Rows of a single label, or none, give no rules and that label (1 for none).
    """
    names = list(values)
    rows = saved(rows.where(F.col(label).isin(0, 1)).select(
        F.col(label).cast("int").alias("label"), (F.pmod(F.xxhash64(tie), F.lit(3)) == 0).alias("held"), *[v.alias(n) for n, v in values.items()]))
    sizes = dict.fromkeys((0, 1), 0) | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not min(sizes.values()):
        return RuleList((), 0 if sizes[0] and not sizes[1] else 1)
    target = 0 if sizes[0] <= sizes[1] else 1
    bounds = thresholds(rows, names, "label", bins)
    steps = {f"bin {n}": place(F.col(f"`{n}`"), bounds[n]) for n in names}
    rows = saved(rows.withColumns(steps).withColumn("hit", (F.col("label") == target).cast("int")))
    own = {n: F.col(f"`{n}`") for n in names}
    found: list[Rule] = []
    while len(found) < rules:
        grow, held = rows.where(~F.col("held")), rows.where("held")
        rule: list[Test] = []
        while len(rule) < tests:
            step = best_test(tally(grow, names, "hit"), bounds)
            if step is None:
                break
            rule.append(step[0])
            grow = grow.where(step[0].column(own))
        if not rule:
            break
        covers = [Rule(tuple(rule[:i + 1]), target).column(own) for i in range(len(rule))]
        sums = held.agg(*[F.count_if(c & (F.col("hit") == hit)).alias(f"{i}_{hit}") for i, c in enumerate(covers) for hit in (0, 1)]).first()
        worth = [((sums[f"{i}_1"] - sums[f"{i}_0"]) / max(1, sums[f"{i}_1"] + sums[f"{i}_0"]), sums[f"{i}_1"], -i) for i in range(len(rule))]
        kept = -max(worth)[2]
        right, wrong = sums[f"{kept}_1"], sums[f"{kept}_0"]
        if not right or right < precise * (right + wrong):
            break
        found.append(Rule(tuple(rule[:kept + 1]), target))
        rows = rows.where(~covers[kept])
    return RuleList(tuple(found), 1 - target, bounds)


def labelled_sample(labels: DataFrame, id: str, label: str, sample: int) -> DataFrame:
    """(id, label): about `sample` labelled ids by hash, all where there are no more; an id labelled twice has its least label."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(id).agg(F.min(label).alias(label))
    n = known.count()
    if n <= sample:
        return known
    return known.where(F.xxhash64(F.lit("sample"), id) < int((2 * sample / n - 1) * 2 ** 63))


def base_failed(prefix: str = "") -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    words, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 50) | (100 * again > 50 * words)


def quality_list(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE,
                 **how) -> RuleList:
    """The rule list for documents that the base rules let pass, from a bounded sample of the labelled ones."""
    chosen = labelled_sample(labels.select(id, label), id, label, sample)
    rows = statistics(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(
        chosen.select(F.col(id).alias("id"), F.col(label).alias("label")), "id"))
    return learn(rows.where(~base_failed()), features(), "label", F.col("id"), **how)


def judge(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", **how) -> DataFrame:
    """(id, counts, base_failed, kept) for every row of `docs`.

    Null and empty texts have no words, so the base rules drop them. Repeated rows each get their row, a null id stays null
    and is never learned from. Labels other than 0 and 1 teach nothing; without labels of both kinds the base rules alone
    decide. Ties between tests go to the feature named first, its least bound and `<`. Other columns of both tables are not used.
    """
    rules = quality_list(docs, labels, id, text, label, **how)
    rows = statistics(docs.select(F.col(id).alias(id), F.col(text).alias("_text")), "_text")
    return (rows.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (rules.verdict(features()) == 1))
            .select(id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
