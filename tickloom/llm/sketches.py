"""Bottom-k sketches of documents' shingle hashes, in DataFrame functions alone.

A sketch is the sorted array of the k smallest distinct hashes of a text's shingles. The sketch of several texts
together follows from theirs, so parts can be sketched apart and merged. Two sketches give estimates of the
resemblance and the containment of the shingle sets; one gives the number of distinct shingles. Estimates are exact
while the sets are no larger than k.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import SPACE

K = 128
WIDTH = 5


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes (64 bits) of the `width`-word shingles of a text; of all its words together if they are fewer."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")

    def runs(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)))
        found = F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(found)

    # the array of one array is there to name the word hashes, which are then worked out once
    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), 1)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text (array<bigint>); of null and empty texts: empty."""
    return F.slice(F.sort_array(F.array_distinct(shingles(text, width))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over the union, 0 to 1. Two empty sketches resemble each other fully."""
    both, union = F.array_intersect(a, b), merged(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.size(F.array_intersect(union, both)) / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    kth = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: the intersection from resemblance and union, over a's number."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, keys: list[str], sketches: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group. Each task keeps a group's k smallest hashes before they are shuffled, so that a group
    of any size brings k per task. Groups that have only empty or null sketches get an empty one."""
    hashes = df.select(*keys, F.explode_outer(sketches).alias("_hash")).distinct()
    low = Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last())
    kept = hashes.withColumn("_place", F.row_number().over(low)).where(F.col("_place") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketches))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, 16 per hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(df: DataFrame, id: str, own: dict[str, Column]) -> DataFrame:
    """`df`, the columns `own`, and `next`: a struct of them from the row with the next smaller id.

    The row with the smallest id is followed by the one with the largest. Null ids count as smallest; rows equal in
    id are ordered by the hash of `own`. Rows are dealt into ranges of ids and sorted within each; the first row of a
    range goes to the end of the range above as well, so that each row meets its next in one task. The ranges are cut
    at approximate quantiles of the ids, four per shuffle partition, found on a tree of two levels.
    """
    spark = df.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.coalesce(F.col(id).cast("bigint"), F.lit(-2 ** 63)))
    found = keyed.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 10 * parts), F.max("_key")).first()
    cuts = sorted({*(found[0] or []), *([] if found[1] is None else [found[1]])}) or [0]
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[at:at + wide] for at in range(0, len(cuts), wide)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda cut: cut < F.col("_key")))

    def array(values) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    group = below(array([g[-1] for g in groups]))
    tree = F.array(*[array(g) for g in groups])
    placed = (keyed.withColumn("_group", group).withColumn("_cuts", F.get(tree, F.col("_group")))
              .withColumn("_part", F.col("_group") * wide + below(F.col("_cuts"))))
    here = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    above = F.struct(((F.col("_part") + 1) % len(cuts)).alias("part"), F.lit(True).alias("guest"))
    first = F.array_contains("_cuts", F.col("_key"))
    placed = (placed.withColumn("_place", F.explode(F.when(first, F.array(here, above)).otherwise(F.array(here))))
              .drop("_part", "_group", "_cuts").repartition("_place.part"))
    placed = placed.select("*", *[value.alias(name) for name, value in own.items()])
    placed = placed.withColumn("_tie", F.xxhash64(*own)).withColumn("_at", F.col("_place.part"))
    order = Window.partitionBy("_at").orderBy("_place.guest", F.col("_key").desc(), "_tie")
    return (placed.withColumn("next", F.lead(F.struct(*own)).over(order)).where("not _place.guest")
            .drop("_key", "_place", "_tie", "_at"))


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """One row per document: id, text, edited (the last third of its characters replaced by as many of the next
    document's first), their sketches `sketch` and `edited_sketch`, and `next_sketch`, the next document's.

    The next document is the one with the next smaller id (`with_next`). Null texts are empty. Repeated rows are
    documents of their own. Other columns are not used.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    rows = with_next(rows, "id", {"text": F.col("body"), "sketch": sketch(F.col("body"), k, width)})
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring(F.col("next.text"), F.lit(1), third))
    return (rows.select(F.col("id").alias(id), "text", edited.alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
            .withColumn("edited_sketch", sketch(F.col("edited"), k, width)))
