"""Alignment, cleaning and resampling of series with a row number t and value columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clean(c: str) -> Column:
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def align(df: DataFrame, nodes: list[tuple[str, int]], time: str = "t") -> DataFrame:
    """t and c0, c1, ...: column i at t is nodes[i][0] at t + lag; rows where every node exists.

    Equi-joins on shifted times, one shuffle on t for all of them, so series of any length stay distributed.
    """
    low = min(lag for _, lag in nodes)
    by_lag: dict[int, list[tuple[int, str]]] = {}
    for i, (column, lag) in enumerate(nodes):
        by_lag.setdefault(lag - low, []).append((i, column))
    parts = [df.select((F.col(time) - shift).alias(time), *[F.col(c).alias(f"c{i}") for i, c in cols]) for shift, cols in by_lag.items()]
    out = reduce(lambda a, b: a.join(b, time), parts)
    return out.select(time, *[f"c{i}" for i in range(len(nodes))])


def drop_missing(df: DataFrame, distinct: bool = False) -> DataFrame:
    out = df.dropna("any")
    return out.distinct() if distinct else out


def normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; unchanged if every deviation is 0, null where only its own is."""
    stats = df.agg(*[F.avg(_clean(c)).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(_clean(c)).alias(f"_s_{c}") for c in columns])
    flat = reduce(lambda a, b: a & b, [F.col(f"_s_{c}") == 0 for c in columns])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    out = {c: F.when(flat, F.col(c)).otherwise((_clean(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) for c in columns}
    return joined.withColumns(out).drop(*[f"_{p}_{c}" for p in "ms" for c in columns])


def interpolate(df: DataFrame, columns: list[str], time: str = "t", series: str | None = None) -> DataFrame:
    """Linear in time between neighbours; ends take the nearest value."""
    part = Window.partitionBy(series if series else F.lit(0)).orderBy(time)
    past, future = part.rowsBetween(Window.unboundedPreceding, 0), part.rowsBetween(0, Window.unboundedFollowing)
    out = {}
    for c in columns:
        point = F.when(_clean(c).isNotNull(), F.struct(F.col(time).alias("t"), _clean(c).alias("v")))
        a, b = F.last(point, True).over(past), F.first(point, True).over(future)
        step = a["v"] + (b["v"] - a["v"]) * (F.col(time) - a["t"]) / (b["t"] - a["t"])
        out[c] = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == b["t"]), a["v"]).otherwise(step)
    return df.withColumns(out)


def aggregate(df: DataFrame, columns: list[str], interval: int, method: str = "accumulate", time: str = "t") -> DataFrame:
    """Sums (accumulate) or means (average) of non-overlapping buckets of rows 0..; a last partial bucket goes."""
    f = F.sum if method == "accumulate" else F.avg
    bucket = F.floor(F.col(time) / interval).cast("long").alias(time)
    return df.groupBy(bucket).agg(*[f(c).alias(c) for c in columns], F.count("*").alias("_n")).filter(F.col("_n") == interval).drop("_n")


def lagged_correlations(df: DataFrame, x: str, y: str, lags: list[int], time: str = "t") -> DataFrame:
    """lag, r: Pearson correlation of x at t and y at t + lag."""
    left = df.select(F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(time).alias("_t"), _clean(x).alias("_x"))
    right = df.select(F.col(time), _clean(y).alias("_y"))
    return left.join(right, F.col("_t") + F.col("lag") == F.col(time)).groupBy("lag").agg(F.corr("_x", "_y").alias("r"))


def butterworth(order: int, cutoff: float, kind: str = "high") -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth filter by the bilinear transform; cutoff as a share of half the sampling rate."""
    warped = 4 * np.tan(np.pi * cutoff / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        zeros, poles, gain = np.array([]), warped * poles, warped**order
    else:
        zeros, gain = np.zeros(order), np.real(1 / np.prod(-poles))
        poles = warped / poles
    fs2 = 4.0
    zd, pd_ = (fs2 + zeros) / (fs2 - zeros), (fs2 + poles) / (fs2 - poles)
    k = gain * np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles))
    zd = np.r_[zd, -np.ones(len(poles) - len(zd))]
    return np.real(k * np.poly(zd)), np.real(np.poly(pd_))


def filtered(values: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    out, state = np.empty(len(values)), np.zeros(len(a) - 1)
    for i, x in enumerate(values):
        y = b[0] * x + (state[0] if len(state) else 0.0)
        for j in range(len(state)):
            state[j] = (state[j + 1] if j + 1 < len(state) else 0.0) + b[j + 1] * x - a[j + 1] * y
        out[i] = y
    return out


def butter_filter(df: DataFrame, columns: list[str], order: int, fs: float, fc: float, kind: str = "high", time: str = "t", series: str = "series_id") -> DataFrame:
    """Causal filter of each series; a recurrence, so one series is one task."""
    b, a = butterworth(order, fc / (0.5 * fs), kind)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        return pdf.assign(**{c: filtered(pdf[c].to_numpy(float), b, a) for c in columns})

    return df.groupBy(series).applyInPandas(run, df.schema)


def lagged_only(edges: DataFrame) -> DataFrame:
    return edges.filter("lag <> 0")


def reorder(matrix: DataFrame, order: list[int], axes: tuple[str, ...] = ("i",)) -> DataFrame:
    """A long matrix (i, j, value) with axes permuted: new index p is old index order[p]."""
    new = F.create_map(*[F.lit(x) for p, o in enumerate(order) for x in (o, p)])
    return matrix.withColumns({a: new[F.col(a)] for a in axes})
