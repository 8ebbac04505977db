"""Evaluation and fitting of the difficulty model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.ranking import letters, running, with_total


def split(df: DataFrame, strata: list[str], order: list[Column], blocks: list[Column], share: float = 0.8) -> DataFrame:
    """df with train: in each stratum the first max(1, round half even of share * n) rows by order (blocks: as for running)."""
    rows = running(with_total(df.withColumn("_one", F.lit(1)), strata, "_one", "_n"), strata, blocks, order, "_r")
    return rows.withColumn("train", F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share))).drop("_one", "_r", "_n")


def downsampled(df: DataFrame, group: str, level: str, order: str) -> DataFrame:
    """As many rows of each level as the rarest level of the group has, the first by order (a text)."""
    n = df.groupBy(group, level).count().groupBy(F.col(group).alias("_g")).agg(F.min("count").alias("_least"))
    ranked = running(df, [group, level], [letters(F.col(order))], [F.col(order)], "_r")
    return ranked.join(n, F.col(group).eqNullSafe(F.col("_g"))).where("_r <= _least").drop("_r", "_least", "_g")


def cut_points(df: DataFrame, value: str, level: str) -> DataFrame:
    """level, cut: the value at round half even of (cumulative share of the level * (n - 1)) among all sorted values.

    Equal values are counted, and their counts summed by whole numbers of the value; the levels, a ladder of a few, are broadcast."""
    n = F.sum("count").over(Window.partitionBy())
    shares = df.groupBy(level).count().select(level, n.alias("n"), (F.sum("count").over(Window.orderBy(level)) / n).alias("cum"))
    spots = shares.select(level, (F.bround(F.col("cum") * (F.col("n") - 1)) + 1).cast("long").alias("spot"))
    counts = running(df.groupBy(value).count().withColumn("_all", F.lit(1)), ["_all"], [F.floor(value)], [F.col(value)], "upto", "count")
    at = counts.join(F.broadcast(spots), F.col("upto") >= F.col("spot"))
    return at.groupBy(level).agg(F.min(value).alias("cut"))


def _nll(par: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Negative log likelihood of a cumulative logit model and its gradient. par: weights, first threshold, logs of the steps."""
    d = x.shape[1]
    step = np.exp(par[d + 1 :])
    theta = np.concatenate([[-np.inf], par[d] + np.concatenate([[0], np.cumsum(step)]), [np.inf]])
    eta = x @ par[:d]
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    hi, lo = s(theta[y + 1] - eta), s(theta[y] - eta)
    p = np.maximum(hi - lo, 1e-12)
    gh, gl = hi * (1 - hi) * np.isfinite(theta[y + 1]), lo * (1 - lo) * np.isfinite(theta[y])
    g = np.zeros_like(par)
    g[:d] = x.T @ (n * (gh - gl) / p)
    gt = np.bincount(y, -n * gh / p, k)[: k - 1] + np.bincount(y, n * gl / p, k)[1:]
    g[d] = gt.sum()
    g[d + 1 :] = step * np.cumsum(gt[::-1])[::-1][1:]
    return -(n * np.log(p)).sum(), g


def fit_ordinal(x: np.ndarray, y: np.ndarray, n: np.ndarray, k: int, steps: int = 500) -> np.ndarray:
    """Weights and thresholds of a cumulative logit model on grouped rows (n: their counts), by gradient descent with Adam steps."""
    par = np.concatenate([np.zeros(x.shape[1]), [-1.0], np.zeros(k - 2)])
    m = v = np.zeros_like(par)
    for i in range(1, steps + 1):
        _, g = _nll(par, x, y, n / n.sum(), k)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par - 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    d = x.shape[1]
    return np.concatenate([par[:d], par[d] + np.concatenate([[0], np.cumsum(np.exp(par[d + 1 :]))])])


def fitted(df: DataFrame, group: str, features: list[str], level: str, digits: int = 2, least_rows: int = 50, least_levels: int = 3) -> DataFrame:
    """group, name, value: a model for each group, fitted on counts of rounded features, so a group's task holds bins, not rows."""
    bins = df.groupBy(group, *(F.round(f, digits).alias(f) for f in features), level).agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf[level].unique())
        out = {"group": [], "name": [], "value": []}
        if pdf["n"].sum() >= least_rows and len(names) >= least_levels:
            y = pdf[level].map({v: i for i, v in enumerate(names)}).to_numpy()
            par = fit_ordinal(pdf[features].to_numpy(float), y, pdf["n"].to_numpy(float), len(names))
            out = {"group": [pdf[group].iloc[0]] * len(par), "name": [*features, *(f"theta{i + 1}" for i in range(len(names) - 1))], "value": par}
        return pd.DataFrame(out)

    return bins.groupBy(group).applyInPandas(fit, "group string, name string, value double")
