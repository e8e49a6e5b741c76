"""Classifier families on Spark ML, with preparation that tolerates NULLs, early stopping and calibration."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import Binarizer, Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42


@dataclass(frozen=True)
class Family:
    """A way to build one classifier, its default parameters and the ranges a search draws from."""

    make: type
    fixed: dict = field(default_factory=dict)
    space: dict = field(default_factory=dict)
    boosted: bool = False
    binary_inputs: bool = False


_BOOST_SPACE = {"maxIter": ("int", 20, 100), "maxDepth": ("int", 3, 8), "stepSize": ("log", 0.01, 0.3),
                "subsamplingRate": ("float", 0.6, 1.0), "minInstancesPerNode": ("int", 5, 100)}
_FOREST_SPACE = {"numTrees": ("int", 20, 100), "maxDepth": ("int", 5, 12), "minInstancesPerNode": ("int", 1, 10),
                 "featureSubsetStrategy": ("choice", ["sqrt", "log2", "all"])}

FAMILIES: dict[str, Family] = {
    # boosted trees: one algorithm in presets that differ in shape
    "boosted": Family(GBTClassifier, {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "seed": SEED}, _BOOST_SPACE, boosted=True),
    "boosted_leafy": Family(GBTClassifier, {"maxIter": 20, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8,
                                            "minInstancesPerNode": 20, "seed": SEED}, _BOOST_SPACE, boosted=True),
    "boosted_binned": Family(GBTClassifier, {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "maxBins": 128, "seed": SEED},
                             _BOOST_SPACE, boosted=True),
    "forest": Family(RandomForestClassifier, {"numTrees": 30, "maxDepth": 6, "seed": SEED}, _FOREST_SPACE),
    "extra": Family(RandomForestClassifier, {"numTrees": 30, "maxDepth": 8, "bootstrap": False,
                                             "featureSubsetStrategy": "sqrt", "maxBins": 16, "seed": SEED}, _FOREST_SPACE),
    "logistic": Family(LogisticRegression, {"maxIter": 50, "regParam": 0.01, "elasticNetParam": 0.0},
                       {"regParam": ("log", 1e-4, 10.0), "elasticNetParam": ("choice", [0.0, 0.5, 1.0])}),
    "hinge": Family(LinearSVC, {"maxIter": 50, "regParam": 0.01}, {"regParam": ("log", 1e-5, 1e-1)}),
    "gaussian_bayes": Family(NaiveBayes, {"modelType": "gaussian"}),
    "bernoulli_bayes": Family(NaiveBayes, {"modelType": "bernoulli", "smoothing": 1.0},
                              {"smoothing": ("log", 1e-3, 10.0)}, binary_inputs=True),
}


def prepared(df: DataFrame, features: list[str], label: str = "is_home_win") -> DataFrame:
    """Labelled rows with double features, a double ``label`` and a 0/1 column per feature for missing values."""
    return df.where(F.col(label).isNotNull()).select(
        *[c for c in df.columns if c not in features],
        *[F.col(c).cast("double").alias(c) for c in features],
        *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in features],
        F.col(label).cast("double").alias("label"))


def filled_names(features: list[str]) -> list[str]:
    return [f"{c}_filled" for c in features]


def imputer(features: list[str]) -> Imputer:
    """Medians in place of missing features, as ``filled_names``."""
    return Imputer(inputCols=features, outputCols=filled_names(features), strategy="median")


def model_for(family: str, features: list[str], params: dict | None = None, weight: str | None = None,
              validation: str | None = None, threshold: float = 0.5, imputed: bool = False) -> Pipeline:
    """Imputer, assembler and classifier. ``validation`` names the boolean column of early-stopping rows; ``imputed`` rows went through an ``imputer``."""
    kind = FAMILIES[family]
    filled = filled_names(features)
    stages = [] if imputed else [imputer(features)]
    inputs = filled
    if kind.binary_inputs:
        inputs = [f"{c}_bit" for c in features]
        stages.append(Binarizer(inputCols=filled, outputCols=inputs, thresholds=[threshold] * len(features)))
    stages.append(VectorAssembler(inputCols=[*inputs, *[f"{c}_missing" for c in features]], outputCol="features"))
    learner = kind.make(featuresCol="features", labelCol="label", **{**kind.fixed, **(params or {})})
    if weight:
        learner = learner.setWeightCol(weight)
    if validation and kind.boosted:
        learner = learner.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*stages, learner])


def win_proba(scored: DataFrame, name: str = "proba") -> DataFrame:
    """Probability of a home win; margin classifiers give a logistic squash of their margin."""
    if "probability" in scored.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.withColumn(name, p)


def predict(model: PipelineModel, df: DataFrame, keep: list[str], name: str = "proba") -> DataFrame:
    return win_proba(model.transform(df), name).select(*keep, name)


def fit_predict(train: DataFrame, test: DataFrame, family: str, features: list[str], keep: list[str],
                params: dict | None = None, name: str = "proba", weight: str | None = None) -> DataFrame:
    return predict(model_for(family, features, params, weight).fit(train), test, keep, name)


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------

def draw(space: dict, rng: random.Random) -> dict:
    """One seeded draw from a parameter space."""
    out = {}
    for name, (kind, *args) in space.items():
        if kind == "int":
            out[name] = rng.randint(*args)
        elif kind == "float":
            out[name] = rng.uniform(*args)
        elif kind == "log":
            out[name] = args[0] * (args[1] / args[0]) ** rng.random()
        else:
            out[name] = rng.choice(args[0])
    return out


def fold_pair(folded: DataFrame, fold: int, expanding: bool) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a fold; with ``expanding`` only earlier blocks train (NULL is the first block)."""
    test = folded.where(F.col("fold") == fold)
    earlier = F.col("fold").isNull() | (F.col("fold") < fold)
    return folded.where(earlier if expanding else F.col("fold") != fold), test


# ---------------------------------------------------------------------------
# Calibration
# ---------------------------------------------------------------------------

def calibrator(held_out: DataFrame, proba: str = "proba"):
    """Isotonic map from raw to calibrated probability, learned on held-out rows."""
    rows = held_out.select(F.col(proba).alias("p"), F.col("is_home_win").cast("double").alias("y"))
    return IsotonicRegression(featuresCol="v", labelCol="y", predictionCol="calibrated").fit(
        rows.select(array_to_vector(F.array("p")).alias("v"), "y"))


def calibrated(model, scored: DataFrame, proba: str = "proba") -> DataFrame:
    out = model.transform(scored.withColumn("v", array_to_vector(F.array(proba))))
    return out.withColumn(proba, F.col("calibrated")).drop("v", "calibrated")
