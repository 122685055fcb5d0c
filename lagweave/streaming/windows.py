"""Mutual information of two columns over sliding windows of a stream (an extension beyond batch use)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions import information as info


def window_information(rows: DataFrame, x: str, y: str, k: int = 5, time: str = "ts", window: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """start, n, mi of each window; on a stream, windows close as the watermark passes. The pairs of a window are one task, as two columns of numbers."""

    def mi(a: np.ndarray, b: np.ndarray) -> float | None:
        return info.mutual_information(np.column_stack([a, b]).astype(float), 1, k) if len(a) > k else None

    source = rows.withWatermark(time, late) if rows.isStreaming else rows
    at = F.window(time, window, slide).alias("window")
    if rows.isStreaming:
        pairs = source.dropna(subset=[x, y]).groupBy(at).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("pairs"))

        @F.pandas_udf("double")
        def of_lists(xs: pd.Series, ys: pd.Series) -> pd.Series:
            return pd.Series([mi(a, b) for a, b in zip(xs, ys, strict=True)], dtype="float64")

        return pairs.select(F.col("window.start").alias("start"), F.size("pairs").alias("n"), of_lists("pairs.x", "pairs.y").alias("mi"))

    pairs = source.dropna(subset=[x, y]).select(at, F.col(x).alias("x"), F.col(y).alias("y")).select(F.col("window.start").alias("start"), "x", "y")

    def of_window(key, got):
        a, b = (got.column(c).to_numpy() for c in ("x", "y"))
        return pa.table({"start": pa.array([key[0].as_py()], key[0].type), "n": pa.array([len(a)], pa.int32()), "mi": pa.array([mi(a, b)], pa.float64())})

    return pairs.groupBy("start").applyInArrow(of_window, f"start {pairs.schema['start'].dataType.simpleString()}, n int, mi double")
