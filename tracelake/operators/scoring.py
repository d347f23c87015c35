"""Classifiers with weights: dense networks scored in Arrow batches, ensembles, and training."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Network:
    """Dense layers (weights of out x in, biases), linear units cut at 0 between them; two outputs."""

    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]

    def outputs(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w.T + b
            if i + 1 < len(self.weights):
                x = np.maximum(x, 0)
        return x


def decision(network: Network, p1: Column, p2: Column, p3: Column) -> Column:
    """Whether the second output is the larger one (softmax keeps their order), for windows of one length."""
    width = network.weights[0].shape[1]

    @F.pandas_udf("boolean")
    def score(flat: pd.Series) -> pd.Series:
        x = np.zeros((len(flat), width))
        for i, v in enumerate(flat):
            if v is not None and len(v) == width:
                x[i] = v
        out = network.outputs(x)
        return pd.Series(out[:, 1] > out[:, 0])

    return score(F.concat(p1, p2, p3))


def decisions(networks: list[Network], p1: Column, p2: Column, p3: Column) -> Column:
    """The members' decisions, as an array."""
    return F.array(*[decision(n, p1, p2, p3) for n in networks])


def train(examples: DataFrame, features: str, label: str, hidden: tuple[int, ...] = (8,), rounds: int = 60, tolerance: float = 1e-6, seed: int = 1) -> Model:
    """A dense network of the features (an array column) for a label of 0 or 1; it stops early where the loss no
    longer falls by `tolerance`."""
    rows = examples.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))
    width = examples.select(F.size(features).alias("n")).first().n
    return MultilayerPerceptronClassifier(layers=[width, *hidden, 2], maxIter=rounds, tol=tolerance, seed=seed).fit(rows)


def predicted(model: Model, examples: DataFrame, features: str) -> DataFrame:
    """The rows with the model's decision."""
    out = model.transform(examples.withColumn("features", array_to_vector(features)))
    return out.withColumn("fired", F.col("prediction") > 0.5).drop("features", "prediction", "probability", "rawPrediction")
