"""Running values along sequences that no single task has to hold.

A key's rows run in one window, unless they are more than `HOT`. Those of hot keys are range-sorted by key and order and written
once in numbered parts, so that a key with a third of all rows lies in a third of the parts. Inside a part, values run in
windows; what the rows of earlier parts of the same key leave is one row per part. A part's first key alone can go on from
the part before, so there are never more carried rows than parts. Results do not depend on where the line is drawn.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom.session import saved

PART = "_part"
HOT = 1 << 20          # rows of a key that one task takes in order; keys with more are split
TINY = 1e-200          # a factor under it leaves nothing of what came before that a double could hold
BLOCK = 256.0          # binary digits by which factors may shrink within one block of an affine scan


def ordered_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` in range-sorted parts, written once, with the part's number in `_part`: numbers rise with keys and order."""
    by = [*keys, *order]
    return saved(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()))


def along(df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[DataFrame, DataFrame | None], DataFrame],
          hot: int | None = HOT) -> DataFrame:
    """`run(rows, span)` for the rows of usual keys (no span: none lies in several parts) and, apart, for those of hot ones.

    Hot keys are counted when the query is built; there are at most as many as `hot` goes into the table's rows. None: the
    caller knows a bound for every key, and nothing is counted.
    """
    if hot is None:
        return run(df.withColumn(PART, F.lit(0)), None)
    large = saved(df.groupBy(*keys).count().filter(F.col("count") > hot).select(together(keys)))
    if large.isEmpty():
        return run(df.withColumn(PART, F.lit(0)), None)
    placed = df.withColumn("_at", together(keys))
    usual = placed.join(large, "_at", "left_anti").drop("_at").withColumn(PART, F.lit(0))
    parts = ordered_parts(placed.join(large, "_at", "left_semi").drop("_at"), keys, order)
    return run(usual, None).unionByName(run(parts, spanning(parts, keys)))


def inside(keys: Sequence[str], order: Sequence[str]):
    """The window of a key's rows within a part, up to the row itself."""
    return W.partitionBy(PART, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def earlier_parts(keys: Sequence[str]):
    """The window of a key's earlier parts over one row per key and part."""
    return W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def together(keys: Sequence[str]) -> Column:
    return F.struct(*keys).alias("_at")


def spanning(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that lie in several parts, at most one for each part: the last of one and the first of the next that has rows."""
    ends = parts.groupBy(PART).agg(F.min(together(keys)).alias("_low"), F.max(together(keys)).alias("_high"))
    before = F.lag("_high").over(W.orderBy(PART))                  # one row per part
    return ends.withColumn("_before", before).filter(F.col("_low").eqNullSafe(F.col("_before"))).select(F.col("_low").alias("_at")).distinct()


def of_spanning(parts: DataFrame, keys: Sequence[str], span: DataFrame) -> DataFrame:
    """Only what spanning keys hold; no more of them than parts, so every task gets them all."""
    return parts.withColumn("_at", together(keys)).join(F.broadcast(span), "_at", "left_semi").drop("_at")


def carried(ends: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """One row per part that goes on with a key from an earlier one: `values`, window expressions over `ends`."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(PART)) == 1
    return ends.withColumn("_first", first).withColumns(values).filter(~F.col("_first")).select(PART, *keys, *values)


def with_carried(parts: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what earlier parts left, null where there is none. Null keys are keys. `rows` are never more than parts, so
    every task gets them all."""
    new = [c for c in rows.columns if c not in (PART, *keys)]
    other = rows.select(F.struct(PART, *keys).alias("_at"), *new)
    return parts.withColumn("_at", F.struct(PART, *keys)).join(F.broadcast(other), "_at", "left").drop("_at")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, span: DataFrame | None) -> DataFrame:
    """Adds each row's place among its key's rows in order, from 1."""
    return running_sum(rows.withColumn("_one", F.lit(1)), keys, order, "_one", name, span).drop("_one")


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, span: DataFrame | None) -> DataFrame:
    """Adds the sum of `value` over a key's rows up to and with the row. Nulls add nothing."""
    own = F.coalesce(F.sum(value).over(inside(keys, order)), F.lit(0))
    if span is None:
        return rows.withColumn(name, own)
    ends = of_spanning(rows, keys, span).groupBy(PART, *keys).agg(F.sum(value).alias("_sum"))
    before = carried(ends, keys, _carried=F.sum("_sum").over(earlier_parts(keys)))
    return with_carried(rows.withColumn(name, own), before, keys).withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0))).drop("_carried")


def floored_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, before: str, after: str,
                span: DataFrame | None) -> DataFrame:
    """Adds a key's running value `before` and `after` each row, where a row adds `value` and nothing goes under zero.

    The maps q -> max(q + u, 0) compose: after rows with sums S, q is S less the least S so far, or S if that is positive.
    So two running values, a sum and its minimum, say it all, and a part hands on both.
    """
    def summed(df: DataFrame) -> DataFrame:
        w = inside(keys, order)
        return df.withColumn("_sum", F.sum(value).over(w)).withColumn("_low", F.min("_sum").over(w))

    if span is None:
        done = summed(rows).withColumns({"_base": F.lit(0).cast("bigint"), "_under": F.lit(None).cast("bigint")})
    else:
        ends = summed(of_spanning(rows, keys, span)).groupBy(PART, *keys).agg(F.sum(value).alias("_end"), F.min("_low").alias("_least"))
        over = earlier_parts(keys)
        ends = ends.withColumn("_base", F.coalesce(F.sum("_end").over(over), F.lit(0))).withColumn("_under", F.col("_base") + F.col("_least"))
        done = with_carried(summed(rows), carried(ends, keys, _base=F.col("_base"), _under=F.min("_under").over(over)), keys)
    base, nothing = F.coalesce("_base", F.lit(0)), F.lit(0)
    low = F.least(base + F.col("_low"), F.coalesce("_under", nothing), nothing)
    done = done.withColumn(after, base + F.col("_sum") - low)
    # a row that ends over zero says what was before it; one that ends at zero took all there was
    last = F.lag(after).over(W.partitionBy(PART, *keys).orderBy(*order))
    entry = F.when(F.col("_under").isNotNull(), F.greatest(base - F.least("_under", nothing), nothing))
    return (done.withColumn(before, F.when(F.col(after) > 0, F.col(after) - F.col(value)).otherwise(F.coalesce(last, entry, nothing)))
            .drop("_sum", "_low", "_base", "_under"))


def affine(rows: DataFrame, by: Sequence[str], order: Sequence[str], factor: str, term: str, name: str) -> DataFrame:
    """Adds `name`, x = factor * x before + term along `by` in `order` from 0, and `_scale`, the product of the factors.

    Factors lie in 0 to 1. With L the running product, x is L times the sum of term / L. A factor of zero starts anew, and so
    that L keeps its digits, rows are also cut into blocks wherever the product has shrunk by another 2^256: a block goes on
    from the end of the one before, whose own beginning no longer weighs anything.
    """
    w, none = W.partitionBy(*by).orderBy(*order), F.col(factor) < TINY
    up = w.rowsBetween(W.unboundedPreceding, 0)
    kept = F.when(none, 1.0).otherwise(F.col(factor))
    rows = rows.withColumns({"_restarts": F.sum(none.cast("int")).over(up), "_digits": F.sum(F.log2(kept)).over(up)})
    rows = rows.withColumn("_block", F.struct("_restarts", F.floor(-F.col("_digits") / BLOCK)))
    block = W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_shrunk", F.product(kept).over(block))
    rows = rows.withColumn("_own", F.col("_shrunk") * F.sum(F.col(term) / F.col("_shrunk")).over(block))
    rows = rows.withColumns({"_last": F.lag("_own").over(w), "_same": F.lag("_block").over(w)})
    goes_on = F.when(none, 0.0).when(F.col("_same") != F.col("_block"), F.col("_last"))
    rows = rows.withColumn("_from", F.coalesce(F.last(goes_on, ignorenulls=True).over(up), F.lit(0.0)))
    return (rows.withColumn(name, F.col("_own") + F.col("_shrunk") * F.col("_from"))
            .withColumn("_scale", F.when(F.col("_restarts") > 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("_digits"))))
            .drop("_restarts", "_digits", "_block", "_shrunk", "_own", "_last", "_same", "_from"))


def blended(rows: DataFrame, keys: Sequence[str], order: Sequence[str], factor: str, target: str, name: str, lost: str,
            span: DataFrame | None) -> DataFrame:
    """Adds x = factor * x before + (1 - factor) * target along each key from 0, across its parts; null from the first row
    on for which `lost` holds.

    Worked out as distances from one of the part's targets, so that equal targets give just that. A part is itself such a map.
    """
    at, up = F.struct(*order), inside(keys, order)

    def within(df: DataFrame) -> DataFrame:
        whole = W.partitionBy(PART, *keys)
        df = df.withColumn("_near", F.coalesce(F.max(target).over(whole), F.lit(0.0)).cast("double"))
        df = df.withColumn("_term", F.when(F.col(factor) < 1, (F.coalesce(target, "_near") - F.col("_near")) * (1 - F.col(factor))).otherwise(0.0))
        df = affine(df, [PART, *keys], order, factor, "_term", "_far")
        return df.withColumn("_gone", F.max(F.col(lost).cast("int")).over(up)).drop("_term")

    if span is None:
        done = within(rows).withColumns({"_before": F.lit(0.0), "_gone_before": F.lit(0)})
    else:
        left = (F.col("_near") * (1 - F.col("_scale")) + F.col("_far")).alias("_left")
        ends = within(of_spanning(rows, keys, span)).groupBy(PART, *keys).agg(F.max_by(F.struct("_scale", left, "_gone"), at).alias("_end"))
        ends = affine(ends.select(PART, *keys, "_end.*").withColumnRenamed("_scale", "_factor"), keys, [PART], "_factor", "_left", "_entry")
        start = carried(ends, keys, _before=F.lag("_entry").over(W.partitionBy(*keys).orderBy(PART)),
                        _gone_before=F.max("_gone").over(earlier_parts(keys)))
        done = with_carried(within(rows), start, keys)
    value = F.col("_near") + F.col("_far") + F.col("_scale") * (F.coalesce("_before", F.lit(0.0)) - F.col("_near"))
    return (done.withColumn(name, F.when(F.greatest("_gone", "_gone_before") == 0, value))
            .drop("_near", "_far", "_scale", "_gone", "_before", "_gone_before"))
