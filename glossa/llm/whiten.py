"""Whitening of embeddings (operator 13) by the covariance of MLlib's RowMatrix.

Every entry c becomes the integer x = floor(scale * c) + shift. Sums S of each dimension over all n usable vectors are exact
integers, so n * x - S centres a row without rounding; divided by n it is the row of a RowMatrix, whose Gramian divided by n is
the covariance V. Only that matrix (dimensions squared) comes to the driver, where eigh splits it; the leading eigenvectors,
divided by the roots of their eigenvalues, are broadcast, and mapInPandas projects the rows. The whitened rows are stored, centred and
put through a second RowMatrix, which measures how far their covariance is from the identity.

Cases: vectors that are null or hold a null or non-finite entry are left out of everything; shorter vectors, empty ones
too, count as padded with zeros; repeated rows and ids, and rows without an id, count and come back one by one; a table without
usable vectors gives no rows; where fewer dimensions vary than components are asked for, the others have whitened null, explained
0, and no part in identity_error; a deviation beyond 64 bits is null; n * x and S must stay within 64 bits (an error otherwise);
extra columns are ignored, whatever their names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import stored

SCALE, SHIFT = 1024, 100_000
#: Rows that a task turns into arrays together.
ROWS = 4096


def integers(vectors: DataFrame, scale: int, shift: int, key: str, vector: str) -> DataFrame:
    """key, x: floor(scale * entry) + shift of the usable vectors."""
    good = f"`{vector}` is not null and forall(`{vector}`, c -> c is not null and not isnan(c) and abs(cast(c as double)) < double('infinity'))"
    x = F.transform(F.col(f"`{vector}`"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift))
    return vectors.where(good).select(F.col(f"`{key}`").alias("key"), x.alias("x"))


def sums(rows: DataFrame, shift: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each dimension over all of them (a missing entry: shift)."""
    n = rows.count()
    each = rows.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum("c"), F.count("*")).collect()  # a row per dimension
    return n, [int(s) + (n - had) * shift for _, s, had in sorted(map(tuple, each))]


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of the outer products of an array column's rows with themselves."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def whitened(vectors: DataFrame, k: int = 8, scale: int = SCALE, shift: int = SHIFT, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (1 to k), n, deviation, whitened, explained, identity_error of each usable vector and component."""
    kind = vectors.schema[key].dataType.simpleString()
    spark = vectors.sparkSession
    rows = stored(integers(vectors, scale, shift, key, vector), "integers")
    n, total = sums(rows, shift)
    columns = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not total:
        return spark.createDataFrame([], columns)
    dims = len(total)
    filled = F.when(F.size("x") < dims, F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dims) - F.size("x")))).otherwise(F.col("x"))
    centred = F.zip_with(filled, F.lit(total), lambda x, s: (F.lit(n) * x - s).cast("double") / F.lit(float(n)))
    value, vector_ = np.linalg.eigh(gramian(rows.select(centred.alias("c")), "c") / n)
    value, axes = value[::-1], vector_[:, ::-1]
    k = min(k, dims)
    varies = value[:k] > max(value[0], 0.0) * dims * np.finfo(float).eps
    some = int(varies.sum())
    shared = spark.sparkContext.broadcast((n, np.array(total, np.int64), axes[:, :some] / np.sqrt(value[:some])))

    def project(parts):
        n, total, axes = shared.value
        for pdf in parts:
            for i in range(0, len(pdf), ROWS):
                part = pdf.iloc[i : i + ROWS]
                x = np.full((len(part), len(total)), shift, np.int64)
                for row, entries in zip(x, part["x"]):
                    row[: len(entries)] = entries
                off = n * x - total
                if float(np.abs(off).max(initial=0)) ** 2 * len(total) < 2.0**62:
                    deviation = (off * off).sum(1).tolist()
                else:
                    exact = (sum(int(v) ** 2 for v in row) for row in off)
                    deviation = [d if d < 1 << 63 else None for d in exact]
                yield pd.DataFrame({"key": part["key"], "deviation": pd.array(deviation, "Int64"), "w": list((off / n) @ axes)})

    out = stored(rows.mapInPandas(project, f"key {kind}, deviation long, w array<double>"), "whitened")
    error = None
    if some:
        mean = out.agg(F.array(*(F.avg(F.col("w")[i]) for i in range(some)))).first()[0]
        cov = gramian(out.select(F.zip_with("w", F.lit(mean), lambda w, m: w - m).alias("c")), "c") / n
        error = float(np.abs(cov - np.eye(some)).max())
    part = np.where(varies, value[:k] / value.sum() if value.sum() > 0 else 0.0, 0.0).tolist()
    each = out.select("key", "deviation", "w", F.posexplode(F.lit(part)).alias("i", "explained"))
    return each.select(
        F.col("key").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("w", F.col("i")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"))
