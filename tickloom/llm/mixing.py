"""Mixes sources to target weights, to the word.

Every row gets a hash-random key. Within a source the rows are sorted by it in hash ranges, word counts are summed
up over ranges and rows, and each source is cut exactly at its budget; a budget beyond the source's size takes
whole passes over the source first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import SPACE, WORD, running_total
from tickloom.session import saved

KEY_BITS = 60          # of a row's hash-random key
RANGE_BITS = 10        # the first of them number the range a row is sorted in


def words(text: Column) -> Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """`sizes` (s: source, size, weight) with `target`: the words each source should give.

    All targets together are `share` of all sizes, in proportion to the weights, but none above `most` times its
    source's size: the excess is shared out again by weight among the others until none is above. Each round
    settles the sources above their bound; only three sums of a round come to the driver.
    """
    total = sizes.agg(F.sum("size").cast("double")).first()[0] or 0.0
    level = 0.0
    while True:
        full = F.col("size") * most <= F.col("weight") * level
        spent, left = sizes.agg(F.sum(F.when(full, F.col("size") * most).otherwise(0.0)),
                                F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not left:
            break
        raised = (total * share - spent) / left
        if raised <= level:
            break
        level = raised
    return sizes.withColumn("target", F.least(F.col("size") * most, F.col("weight") * level))


def keyed_value(id: str, seed: str) -> Column:
    """A row's hash-random key of `KEY_BITS` bits."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("bigint")


def keyed(rows: DataFrame, id: str, source: str, size: str, seed: str) -> DataFrame:
    """`rows` as column `row`, with source (s, none), size, hash-random key, tie and the key's range."""
    maps = [c for c in rows.columns if "map<" in rows.schema[c].dataType.simpleString()]        # have no hash, but a text
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.coalesce(source, F.lit("")).alias("s"),
        F.col(source).isNull().alias("none"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"),
        keyed_value(id, seed).alias("key"),
        F.xxhash64(*[F.col(f"`{c}`").cast("string") if c in maps else F.col(f"`{c}`") for c in rows.columns]).alias("tie"))
    return packed.withColumn("part", F.shiftright("key", KEY_BITS - RANGE_BITS))


def placed(packed: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """`packed` with source_size, target, `passes` (how often the mix takes all of the source) and `extra` (the words of the row
    that it takes once more)."""
    part = ["none", "s", "part"]
    ranges = saved(packed.groupBy(*part).agg(F.sum("size").alias("size")))
    sizes = ranges.groupBy("none", "s").agg(F.sum("size").alias("size"))
    places = running_total(sizes, ["none", "s"], F.lit(1), "place")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    goals = targets(saved(places.withColumn("weight", turn)), share, most)
    earlier = Window.partitionBy("none", "s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranges.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size")
               .join(goals.select("none", "s", F.col("size").alias("source_size"), "target"), ["none", "s"]))
    inside = Window.partitionBy(*part).orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor(F.round("target", 6))
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("passes") * F.col("source_size")
    return (packed.join(offsets, part).withColumn("start", start).withColumn("passes", passes.cast("bigint"))
            .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))).cast("bigint")))


def mix(rows: DataFrame, id: str, source: str, size: str, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
        most: float = 2.0, seed: str = "mix") -> DataFrame:
    """`rows` with source_size, target (its source's) and taken: the words of the row that the mix takes.

    Sources by code point, null last, have the `weights` in turn. Each source's taken words sum up to its target
    rounded down; all rows of a source are taken `floor(target / source_size)` times, and those first in hash order
    once more, the last of them in part. Hash order follows id and seed alone; rows equal in id are ordered by their
    other columns' hash. A null size counts 0, a null id is an id of its own. Columns of `rows` that have the name
    of a result column are replaced. Runs agree.
    """
    own = [c for c in rows.columns if c not in ("source_size", "target", "taken")]
    done = placed(keyed(rows.select(*[F.col(f"`{c}`") for c in own]), id, source, size, seed), weights, share, most)
    return done.select("row.*", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1),
                    share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents of the mix, in the columns of `docs`: each as often as the mix takes it whole, and the document
    at a source's cut once more with the words up to the cut. Documents without words are in the mix once: they
    weigh nothing. `n_chars`, where `docs` has it, follows a cut text. Null text stays null.

    Only keys and sizes are sorted and summed. What a source gives once more ends at one place of its hash order, so every
    document sees from its own key what the mix takes of it, and texts are never moved. Of rows equal throughout at that
    place, as many are taken as make up the words there.
    """
    maps = [c for c in docs.columns if "map<" in docs.schema[c].dataType.simpleString()]
    every = F.xxhash64(*[F.col(f"`{c}`").cast("string") if c in maps else F.col(f"`{c}`") for c in docs.columns])
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), every.alias("hash"), doc.alias("doc"))
    packed = keyed(sized.drop("doc"), "id", "source", "size", seed)
    group, at = ["none", "s"], F.struct("key", "tie")
    rows = saved(placed(packed.drop("row"), weights, share, most).select(*group, "key", "tie", "extra", "passes"))
    ends = rows.groupBy(*group).agg(F.max(F.when(F.col("extra") > 0, at)).alias("end"), F.max("passes").alias("passes"))
    last = (rows.join(ends.select(*group, "end"), group).where(at == F.col("end")).groupBy(*group).agg(F.sum("extra").alias("words")))
    ends = saved(ends.join(last, group, "left"))                                     # one row per source
    whole = sized.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    whole = whole.withColumn("key", keyed_value("id", seed)).withColumn("tie", F.xxhash64("id", "source", "size", "hash")).join(ends, group)
    place, size = F.struct("key", "tie"), F.col("size")
    plain = whole.where((place != F.col("end")) | F.col("end").isNull()).withColumn(
        "extra", F.when(place < F.col("end"), size).otherwise(0))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("key")) - 1            # equal rows, nearly always one
    cut = whole.where(place == F.col("end")).withColumn("extra", F.greatest(F.lit(0), F.least(size, F.col("words") - nth * size)))
    taken = plain.unionByName(cut).withColumn("taken", F.col("passes") * size + F.col("extra"))
    body = F.col("doc").getField(text)
    times = F.when(size == 0, F.lit(1)).otherwise(F.ceil(F.col("taken") / size)).cast("int")
    part = F.col("taken") - (F.col("nth") - 1) * size
    copies = taken.withColumn("times", times).where("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    pieces = F.regexp_extract_all(body, F.lit(SPACE.replace("+", "*") + WORD), F.lit(0))
    copies = copies.withColumn("part", part).withColumn("body", F.when(F.col("part") >= size, body).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("body").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("part") >= size, F.col("doc").getField(c)).otherwise(
                F.length("body")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("doc").getField(c).alias(c))
    return copies.select(*out)
