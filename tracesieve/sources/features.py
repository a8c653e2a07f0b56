"""Image to feature vector by a model the caller supplies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

from tracesieve.functions.images import tensors


def featurize(
    df: DataFrame,
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    size: tuple[int, int] = (224, 224),
    batch_size: int = 64,
    dst: str = "x",
) -> DataFrame:
    """Add the model's output vector for every image.

    ``make_model`` runs once per Python worker and returns a function from a
    ``(batch, h, w, 3)`` float32 tensor to a ``(batch, d)`` array.  The tensor exists for
    one batch at a time only.
    """

    def make_predict():
        model = make_model()

        def predict(data, height, width):
            # Columns of one name arrive side by side: the first is the height, the last the width.
            heights, widths = height.reshape(len(data), -1)[:, 0], width.reshape(len(data), -1)[:, -1]
            batch = tensors([bytes(b) for b in np.ravel(data)], heights, widths, size)
            return np.asarray(model(batch), dtype=np.float32)

        return predict

    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(dst, udf(F.col("image.data"), F.col("image.height"), F.col("image.width")))
