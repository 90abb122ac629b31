"""Projection of vectors to few dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """``id, component_0.., share``: centred projection on the k leading directions, and the variance share of these.

    Only sums and products of dimensions are gathered: from each partition a table whose size is the square of the dimension.
    Null vectors are projected to nulls, an empty table gives an empty result.
    """
    v = F.transform(vector, lambda x: x.cast("double"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number, sum and products of one partition's vectors."""
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()]), pa.array([products.tobytes()])], names=["n", "total", "products"])

    n, total, products = 0, 0.0, 0.0
    for r in rows.filter(F.size(vector) > 0).select(v.alias("v")).mapInArrow(moments, "n long, total binary, products binary").toLocalIterator():
        n, total, products = n + r.n, total + np.frombuffer(r.total), products + np.frombuffer(r.products)
    if not n:
        return rows.select(id_col, *[F.lit(0.0).alias(f"component_{c}") for c in range(k)], F.lit(0.0).alias("share"))
    mean = total / n
    products = products.reshape(len(mean), -1) / n
    values, directions = np.linalg.eigh(products - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    share = float(values[order].sum() / values.sum()) if values.sum() > 0 else 0.0

    def component(d: np.ndarray):
        weights = F.array(*[F.lit(float(x)) for x in d])
        return F.aggregate(F.zip_with(v, weights, lambda x, w: x * w), F.lit(float(-mean @ d)), lambda s, x: s + x)

    return rows.select(id_col, *[component(directions[:, o]).alias(f"component_{n}") for n, o in enumerate(order)], F.lit(share).alias("share"))
