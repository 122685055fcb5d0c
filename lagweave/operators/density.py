"""Kernel densities, grids and histograms as DataFrame expressions, with the estimators built on them."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.functions import information as info

#: Points that one task holds at a time; all-pairs work is dealt out in pairs of such blocks.
POINTS = 4096


def kernel(u: Column, name: str) -> Column:
    if name == "gaussian":
        return F.exp(-u * u / 2) / math.sqrt(2 * math.pi)
    return F.when(u * u < 1, 0.75 * (1 - u * u)).otherwise(0.0)


def density(df: DataFrame, columns: list[str], rule: str = "silverman", name: str = "gaussian", key: str = "t", bandwidth: float | None = None) -> DataFrame:
    """key and p: product-kernel density at every sample, itself included; a row for each row without nulls, also of repeated keys.

    Bandwidths follow the rule per column, or are `bandwidth` in all of them.
    """
    rows, n = _rows(df, columns, key)
    if not n:
        return df.sparkSession.createDataFrame([], f"{key} long, p double")
    if bandwidth is None:
        dev = F.stddev_samp if len(columns) > 1 else F.stddev_pop
        h = _factor(n, len(columns), rule) * np.array(list(rows.agg(*[dev(c) for c in columns]).first()))
    else:
        h = np.full(len(columns), float(bandwidth))
    return _in_blocks(rows, n, columns, key, lambda points, at: info.kernel_density(points, at, h, name))


def general_density(df: DataFrame, columns: list[str], rule: str = "silverman", name: str = "gaussian", key: str = "t", matrix: np.ndarray | None = None, compat: bool = False) -> DataFrame:
    """As `density`, with a full bandwidth matrix: the sample covariance times the square of the rule's factor, or `matrix`."""
    rows, n = _rows(df, columns, key)
    if not n:
        return df.sparkSession.createDataFrame([], f"{key} long, p double")
    if matrix is None:
        cov = rows.agg(*[F.covar_samp(a, b) for a in columns for b in columns]).first()
        matrix = _factor(n, len(columns), rule) ** 2 * np.array(list(cov)).reshape(len(columns), len(columns))
    h = np.asarray(matrix, float)
    return _in_blocks(rows, n, columns, key, lambda points, at: info.general_kernel_density(points, at, h, name, compat))


def _factor(n: int, d: int, rule: str) -> float:
    return n ** (-1 / (d + 4)) * ((4 / (d + 2)) ** (1 / (d + 4)) if rule == "silverman" else 1.0)


def _rows(df: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, int]:
    rows = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    return rows, rows.count()


def _in_blocks(rows: DataFrame, n: int, columns: list[str], key: str, f) -> DataFrame:
    """key and p: mean of the kernels f(points, at) over all points, at each of the n rows.

    Points are dealt into blocks; each block of targets meets each block of points once (a stated query set in
    blocks), and the partial sums of a target are added up, so no task holds more than two blocks.
    """
    blocks = max(1, -(-n // POINTS))
    block = F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int")
    # Rows that are the same have the same density: one of them is a target, and its density is repeated.
    left = rows.groupBy("_key", *columns).agg(F.count("*").alias("_m")).withColumn("a", block).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumnsRenamed({"_key": "_other"} | {c: f"_o_{c}" for c in columns})
    right = right.withColumn("b", F.pmod(F.xxhash64("_other"), F.lit(blocks)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p = f(y[[f"_o_{c}" for c in columns]].to_numpy(), x[columns].to_numpy()) * len(y) if len(x) and len(y) else np.zeros(len(x))
        return x[["_key", *columns, "_m"]].assign(s=p)

    schema = "_key long, " + ", ".join(f"`{c}` double" for c in columns) + ", _m long, s double"
    pairs = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(sums, schema)
    each = pairs.groupBy("_key", *columns, "_m").agg((F.sum("s") / n).alias("p"))
    return each.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int")))).select(F.col("_key").alias(key), "p")


def entropy_of(densities: DataFrame, base: float = math.e) -> DataFrame:
    return densities.agg((-F.avg(F.when(F.col("p") > 0, F.ln("p")).otherwise(0.0)) / math.log(base)).alias("h"))


def weighted_information(df: DataFrame, x: list[str], y: list[str], w: list[str] | None = None, base: float = math.e, key: str = "t", **kw) -> DataFrame:
    """Mutual or conditional information from kernel densities, weighted by the joint density made to sum to 1."""
    w = w or []
    sets = {"xy": x + y + w, "x": x + w, "y": y + w} | ({"w": w} if w else {})
    parts = [density(df, cols, key=key, **kw).withColumnRenamed("p", f"p_{s}") for s, cols in sets.items()]
    all_ = reduce(lambda a, b: a.join(b, key), parts)
    ratio = F.col("p_xy") / (F.col("p_x") * F.col("p_y")) * (F.col("p_w") if w else F.lit(1.0))
    term = F.when(ratio > 0, F.col("p_xy") * F.ln(ratio) / math.log(base)).otherwise(0.0)
    return all_.agg((F.sum(term) / F.sum("p_xy")).alias("i"))


def cross_validated_bandwidth(values: np.ndarray, folds: int = 20, grid: np.ndarray | None = None) -> float:
    """Bandwidth of the largest held-out log-likelihood among 30 from 0.1 to 1."""
    grid = np.linspace(0.1, 1.0, 30) if grid is None else grid
    x, fold = values.reshape(len(values), -1), np.arange(len(values)) % folds

    def score(h):
        return sum(np.log(np.maximum(info.kernel_density(x[fold != f], x[fold == f], np.full(x.shape[1], h)), 1e-300)).sum() for f in range(folds) if (fold == f).any())

    return float(grid[int(np.argmax([score(h) for h in grid]))])


def binned(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """df with b_<column>: number 1..bins of equal-width bins from smallest to largest value."""
    ends = df.agg(*[F.min(c).alias(f"_a_{c}") for c in columns], *[F.max(c).alias(f"_z_{c}") for c in columns])
    out = df.dropna(subset=columns).crossJoin(F.broadcast(ends))  # one row
    step = {f"b_{c}": F.least(F.lit(bins), F.floor((F.col(c) - F.col(f"_a_{c}")) / F.nullif(F.col(f"_z_{c}") - F.col(f"_a_{c}"), F.lit(0.0)) * bins).cast("int") + 1) for c in columns}
    return out.withColumns({k: F.coalesce(v, F.lit(1)) for k, v in step.items()}).drop(*[f"_{p}_{c}" for p in "az" for c in columns])


def histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Occupied cells b_<column>..., n, p of the fixed-bin density; counted with partial aggregation."""
    cells = binned(df, columns, bins).groupBy(*[f"b_{c}" for c in columns]).agg(F.count("*").alias("n"))
    return cells.crossJoin(F.broadcast(cells.agg(F.sum("n").alias("_all")))).withColumn("p", F.col("n") / F.col("_all")).drop("_all")  # one row


def table_entropy(cells: DataFrame, columns: list[str], base: float = math.e) -> DataFrame:
    p = cells.groupBy(*columns).agg(F.sum("p").alias("p"))
    return p.agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0)) / math.log(base)).alias("h"))


def table_information(cells: DataFrame, x: str, y: str, base: float = math.e) -> DataFrame:
    """hx, hy, hxy, hy_x (conditional entropy) and ixy of a discrete joint table with column p."""
    h = {n: table_entropy(cells, c, base).withColumnRenamed("h", n) for n, c in (("hx", [x]), ("hy", [y]), ("hxy", [x, y]))}
    one = h["hx"].crossJoin(h["hy"]).crossJoin(h["hxy"])  # one row each
    return one.withColumn("hy_x", F.col("hxy") - F.col("hx")).withColumn("ixy", F.col("hx") + F.col("hy") - F.col("hxy"))


def atoms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the share of values that are not 0, and whether it has an atom at 0 (below 0.9)."""
    shares = F.array(*[F.struct(F.lit(c).alias("column"), F.avg((F.col(c) != 0).cast("double")).alias("nonzero")) for c in columns])
    return df.agg(shares.alias("a")).select(F.inline("a")).withColumn("atom", F.col("nonzero") < 0.9)


def grid_density(points: np.ndarray, bins: list[int], limits: list[tuple[float, float]] | None = None, atom_check: bool = True, name: str = "gaussian") -> tuple[list[np.ndarray], np.ndarray]:
    """Coordinates and probabilities on a grid, as a mixture over which dimensions are 0: each pattern of zeros has
    its share of the samples, spread by a kernel density over its other dimensions. Sums to 1."""
    d = points.shape[1]
    limits = limits or [(float(points[:, j].min()), float(points[:, j].max())) for j in range(d)]
    atom = [atom_check and (points[:, j] != 0).mean() < 0.9 for j in range(d)]
    coords = []
    for j in range(d):
        edges = np.linspace(*limits[j], bins[j] + 1 - atom[j])
        mid = (edges[:-1] + edges[1:]) / 2
        coords.append(np.r_[0.0, mid] if atom[j] else mid)
    out = np.zeros([len(c) for c in coords])
    zero = np.array([[atom[j] and x == 0 for j, x in enumerate(row)] for row in points])
    for pattern in np.unique(zero, axis=0):
        rows = points[(zero == pattern).all(1)]
        free = [j for j in range(d) if not pattern[j]]
        share = len(rows) / len(points)
        at: list = [0 if pattern[j] else (slice(1, None) if atom[j] else slice(None)) for j in range(d)]
        if not free:
            out[tuple(at)] += share
            continue
        mesh = np.stack(np.meshgrid(*[coords[j][1:] if atom[j] else coords[j] for j in free], indexing="ij"), -1)
        sub = rows[:, free]
        h = np.maximum(1.06 * sub.std(axis=0) * len(sub) ** -0.2, 1e-9)
        p = info.kernel_density(sub, mesh.reshape(-1, len(free)), h, name).reshape(mesh.shape[:-1])
        out[tuple(at)] += share * (p / p.sum() if p.sum() > 0 else np.full(p.shape, 1 / p.size))
    return coords, out / out.sum()
