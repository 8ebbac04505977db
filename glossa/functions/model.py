"""The word-difficulty model and the review schedule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions import constants as K
from glossa.functions.lex import let


def clamp01(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def zipf_norm(zipf: Column) -> Column:
    return clamp01(F.coalesce(zipf, F.lit(0.0)) / 7)


def aoa_norm(aoa: Column, zipf: Column) -> Column:
    """From the age of acquisition; without one the frequency stands in, without both 0.4."""
    return F.when(aoa.isNotNull(), clamp01((aoa - 2) / 16)).when(zipf.isNotNull(), 1 - zipf_norm(zipf)).otherwise(0.4)


def difficulty(zipf: Column, aoa: Column) -> Column:
    return let(zipf, lambda z: K.W_ZIPF * zipf_norm(z) + K.W_AOA * aoa_norm(aoa, z))


def level(eta: Column) -> Column:
    def of(x: Column) -> Column:
        out = F.lit(K.LEVELS[-1])
        for name, t in reversed(list(zip(K.LEVELS, K.THRESHOLDS))):
            out = F.when(x < t, name).otherwise(out)
        return out

    return let(eta, of)


def confidence(zipf: Column, aoa: Column) -> Column:
    """high, medium or low, by how many features are missing."""
    missing = zipf.isNull().cast("int") + aoa.isNull().cast("int")
    return F.when(missing == 0, "high").when(missing == 1, "medium").when(F.coalesce(zipf, F.lit(0.0)) == 0, "low").otherwise("medium")


def due(box: Column, last_ms: Column, now_ms: int) -> Column:
    days = F.lit(1)
    for i, d in enumerate(K.DUE_DAYS, 1):
        days = F.when(box == i, d).otherwise(days)
    return last_ms.isNull() | (F.lit(now_ms) - last_ms >= days * K.DAY_MS)


def promoted(box: Column, correct: Column) -> Column:
    return F.when(correct, F.least(box + 1, F.lit(5))).otherwise(1)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
