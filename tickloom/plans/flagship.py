"""The flagship query: bars to features to labels to the strongest names of each day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.features import daily_features, labels
from tickloom.operators.ranking import top_k
from tickloom.plans import views as V
from tickloom.plans.registry import report

COLUMNS = ("symbol", "date", "pos", "gap", "first_hr_ret", "first_hr_range", "first_hr_vol_ratio", "vol_20d",
           "rel_first_hr", "label_excess", "label_rank")


def top_names_per_day(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    table = labels(daily_features(V.bars(spark, sf), V.INDEX, V.UNTIL))
    best = top_k(table, ["date"], k, [F.col("first_hr_ret").desc_nulls_last(), F.col("symbol")])
    return report(best, *COLUMNS)
