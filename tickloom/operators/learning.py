"""Boosted trees fitted walk-forward on the feature tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.operators.evaluation import fold_bounds
from tickloom.operators.ranking import cap_rows
from tickloom.session import saved, ship_functions

ship_functions(__name__)

AT_ONCE = 4             # folds fitted at the same time; each holds its own training rows in Spark's cache
MISSING = -1e6          # below every feature value, so trees can send missing rows their own way


def filled(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features})


def booster(label: str, features: tuple[str, ...], classify: bool, trees: int, min_rows: int, seed: int) -> Pipeline:
    """300 shallow trees, small steps, four fifths of the rows and features per tree by default."""
    kind = GBTClassifier if classify else GBTRegressor
    learner = kind(labelCol=label, featuresCol="_features", maxIter=trees, stepSize=0.03, maxDepth=5,
                   subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=min_rows, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), learner])


def _walk(d: DataFrame, label: str, features: tuple[str, ...], keep: list[str], classify: bool, min_train: int,
          period: str, trees: int, min_rows: int, seed: int, cap: int | None, cap_keys: list[str]) -> DataFrame:
    """Scores of every test period by a model fitted on the rows before it.

    The table is written once, and folds are fitted `AT_ONCE` at a time, each in a scheduler pool of its own; only the
    periods' bounds reach the driver.
    """
    table = saved(filled(d, features).select(*dict.fromkeys([*keep, "date", label, *cap_keys, *features])))
    spark = table.sparkSession

    def scores(fold) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{fold['fold']}")
        train = table.filter(F.col("date") < fold["cutoff"])
        if cap is not None:
            train = cap_rows(train, cap, cap_keys, seed)
        test = table.filter(F.col("date").between(fold["test_from"], fold["test_to"]))
        scored = booster(label, features, classify, trees, min_rows, seed).fit(train).transform(test)
        return scored.select(*keep, vector_to_array("probability")[1].alias("prob") if classify else F.col("prediction"))

    folds = fold_bounds(table, min_train, period).orderBy("fold").collect()
    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(scores), folds))
    if not parts:
        return table.select(*keep, F.lit(0.0).alias("prob" if classify else "prediction")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def walk_forward_regress(d: DataFrame, min_train: int = 6, period: str = "month", trees: int = 300,
                         min_rows: int = 200, seed: int = 42) -> DataFrame:
    """Predicted percent rank of each stock-day by models that never saw its period."""
    known = d.filter(F.col("label_rank").isNotNull())
    return _walk(known, "label_rank", C.DAY_FEATURES, ["symbol", "date", "label_ret", "label_excess"], False,
                 min_train, period, trees, min_rows, seed, None, [])


def walk_forward_classify(t: DataFrame, min_train: int = 6, period: str = "month", trees: int = 300,
                          min_rows: int = 500, seed: int = 42, cap: int = 3_000_000) -> DataFrame:
    """Probability of success of each hypothetical trade, trained on at most `cap` rows."""
    keys = ["symbol", "date", "entry_bar", "hold_bars"]
    return _walk(t, "success", C.ENTRY_FEATURES, [*keys, "net", "success"], True, min_train, period, trees, min_rows,
                 seed, cap, keys)


def fit_final(d: DataFrame, out: str, trees: int = 300, min_rows: int = 200, seed: int = 42) -> PipelineModel:
    """The ranker on all labelled rows, saved under `out`."""
    known = filled(d.filter(F.col("label_rank").isNotNull()), C.DAY_FEATURES)
    model = booster("label_rank", C.DAY_FEATURES, False, trees, min_rows, seed).fit(known)
    model.write().overwrite().save(out)
    return model


def score(df: DataFrame, path: str, features: tuple[str, ...] = C.DAY_FEATURES) -> DataFrame:
    """`df` with the saved model's prediction as `score`; missing features are allowed."""
    model = PipelineModel.load(path)
    scored = model.transform(filled(df, features)).withColumnRenamed("prediction", "score")
    return scored.drop("_features")


def score_with(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], features: tuple[str, ...],
               name: str = "pred") -> DataFrame:
    """`df` with an outside model's prediction; `load` runs once per task, rows go in Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in batches:
            yield pdf.assign(**{name: predict(pdf[list(features)].astype("float64"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"
    return df.mapInPandas(run, schema)
