"""Scoring and training hooks. A model is any function from a batch of inputs to scores.

`scorer` wraps one for Spark: it is loaded once for each Python worker and called on batches; `detected` does so for
detectors of objects. The training stand-in fits Spark's own logistic regression to feature vectors, and
`trained_by_epochs` evaluates it after each epoch and saves the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators import evaluation

#: label, confidence and edges of a box
Detection = tuple[str, float, tuple[float, float, float, float]]
_DETECTED = "label string, conf double, pos int, x_min double, y_min double, x_max double, y_max double"


def scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch_size: int = 64) -> Callable:
    """A column function from an array of `width` floats to the model's scores, an array of doubles."""
    return predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]])


def trained(rows: DataFrame, features: str, label: str, rounds: int = 10, strength: float = 0.0) -> LogisticRegressionModel:
    d = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=rounds, regParam=strength).fit(d)


def predicted(model: LogisticRegressionModel, rows: DataFrame, features: str) -> DataFrame:
    """rows with probability (array) and pred."""
    d = rows.withColumn("features", array_to_vector(F.col(features).cast("array<double>")))
    d = model.transform(d)
    return d.select(*rows.columns, vector_to_array("probability").alias("probability"), F.col("prediction").cast("int").alias("pred"))


def detected(images: DataFrame, load: Callable[[], Callable[[list[np.ndarray]], list[list[Detection]]]], id_col: str = "origin", batch_size: int = 16) -> DataFrame:
    """A row for each object found in each raster: id, label, conf, pos (its place in what was found) and the box.

    load gives the detector, once for each task; that takes a batch of arrays (height, width, channels). Feeds
    `scoring.detections`; images without an object have no row.
    """
    kind = dict(images.dtypes)[id_col]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        for part in parts:
            for start in range(0, len(part), batch_size):
                some = list(part.iloc[start : start + batch_size].itertuples(index=False))
                arrays = [np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels) for r in some]
                out = [(r[0], label, conf, pos, *box) for r, found in zip(some, detector(arrays), strict=True) for pos, (label, conf, box) in enumerate(found)]
                yield pd.DataFrame(out, columns=[id_col, "label", "conf", "pos", "x_min", "y_min", "x_max", "y_max"])

    return images.select(id_col, "height", "width", "nChannels", "data").mapInPandas(run, f"`{id_col}` {kind}, {_DETECTED}")


def _evaluated(model: LogisticRegressionModel, rows: DataFrame, features: str, label: str) -> tuple[float, float]:
    """Mean log loss and accuracy."""
    d = predicted(model, rows, features)
    p = F.greatest(F.get("probability", F.col(label).cast("int")), F.lit(1e-15))
    loss, acc = d.agg(F.avg(-F.log(p)), F.avg((F.col("pred") == F.col(label)).cast("int"))).first()
    return loss or 0.0, acc or 0.0


def trained_by_epochs(train: DataFrame, val: DataFrame, features: str, label: str, path: str, epochs: int = 10, strength: float = 0.0) -> DataFrame:
    """Train for 1, 2, ... `epochs` rounds and evaluate each time; the best model is at `path` (LogisticRegressionModel.load).

    Returns epoch, train_loss, val_loss, train_acc, val_acc, best_before and improved. A model is saved when its accuracy on val
    is over all before it, so the earliest of equals stays; none is if no accuracy is over 0.
    """
    series, best = [], 0.0
    for epoch in range(1, epochs + 1):
        model = trained(train, features, label, epoch, strength)
        (train_loss, train_acc), (val_loss, val_acc) = (_evaluated(model, d, features, label) for d in (train, val))
        if val_acc > best:
            model.write().overwrite().save(path)
            best = val_acc
        series.append((epoch, train_loss, val_loss, train_acc, val_acc))
    columns = "epoch int, train_loss double, val_loss double, train_acc double, val_acc double"
    return evaluation.improvements(train.sparkSession.createDataFrame(series, columns))
