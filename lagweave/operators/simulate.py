"""Benchmark dynamics. Recurrences are sequential, so each member of an ensemble is one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def noise(r: np.random.Generator, kind: str | None, c: float, a: float, b: float) -> Callable[[], float]:
    """c times a uniform number from a to b, or a normal one of mean a and deviation b; 0 without a kind."""
    if kind is None:
        return lambda: 0.0
    if kind not in ("uniform", "normal"):
        raise ValueError(f"noise is uniform or normal, not {kind}")
    return (lambda: c * r.uniform(a, b)) if kind == "uniform" else (lambda: c * r.normal(a, b))


def logistic_network(r, n: int, adjacency, lags, e: float, ez: float, a: float = 4.0, steps: int = 1000, kind: str | None = "uniform", para=(1.0, 0.0, 1.0), multiplicative: bool = False) -> np.ndarray:
    """Coupled logistic maps: (1-e) f(x_i) + (1-ez) e mean_j w_ij f(x_j) + e ez noise."""
    adj, lag = np.asarray(adjacency, float), np.asarray(lags, int)
    if adj.shape != (n, n) or lag.shape != (n, n):
        raise ValueError("adjacency and lags must be square matrices of the network's size")
    draw = noise(r, kind, *para)
    head = max(1000, int(lag.max()))
    x = np.empty((head + steps, n))
    x[:head] = [[draw() for _ in range(n)] for _ in range(head)]
    degree = np.maximum((adj != 0).sum(1), 1)
    f = lambda v: a * v * (1 - v)
    for t in range(head, head + steps):
        for i in range(n):
            own = f(x[t - 1, i])
            pulled = sum(adj[i, j] * f(x[t - lag[i, j], j] if lag[i, j] else 0.0) for j in range(n) if adj[i, j]) / degree[i]
            z = draw()
            signal = (1 - e) * own + (1 - ez) * e * pulled
            x[t, i] = signal * (1 + e * ez * z) if multiplicative else signal + e * ez * z
    return x[head:]


def _flow(r, step, init, n, dt, e, burn):
    x, out = np.array(init, float), np.empty((n + 1, len(init)))
    for i in range(burn + n + 1):
        if i >= burn:
            out[i - burn] = x
        x = x + step(x) * dt + e * r.uniform(size=len(x)) * dt
    return out


def lorenz(r, n: int, dt: float = 0.01, e: float = 0.0, init=(0.0, 1.0, 1.05), s: float = 10.0, rho: float = 28.0, b: float = 2.667) -> np.ndarray:
    return _flow(r, lambda v: np.array([s * (v[1] - v[0]), rho * v[0] - v[1] - v[0] * v[2], v[0] * v[1] - b * v[2]]), init, n, dt, e, 2000)


def ornstein_uhlenbeck(r, n: int, dt: float, theta, rho: float = 1.0, init=(1.6, 1.0, 2.4), burn: int = 3000) -> np.ndarray:
    theta = np.asarray(theta, float)
    return _flow(r, lambda v: theta @ v, init, n, dt, rho, burn)


def henon(r, n: int, e: float = 0.0, init=None, a: float = 1.4, b: float = 0.3, burn: int = 2000) -> np.ndarray:
    """n steps and the state before them; both variables carry uniform noise of size e."""
    x, y = r.uniform(0.25, 0.4, 2) if init is None else init
    out = np.empty((n + 1, 2))
    for i in range(burn + n + 1):
        if i >= burn:
            out[i - burn] = x, y
        x, y = 1 - a * x * x + y + e * r.uniform(), b * x + e * r.uniform()
    return out


def two_species(r, n: int, x0=0.4, y0=0.2, rx=3.8, ry=3.5, bxy=0.02, byx=0.1, tau: int = 0) -> np.ndarray:
    """x drives y after tau more steps; the first tau + 1 states are the initial one."""
    out = np.empty((n, 2))
    out[: tau + 1] = x0, y0
    for t in range(tau, n - 1):
        x, y = out[t]
        out[t + 1] = x * (rx - rx * x - bxy * y), y * (ry - ry * y - byx * out[t - tau, 0])
    return out


def fishery(r, n: int, rxx=3.1, rxt=-0.3, ryy=2.9, ryt=-0.36, cx=0.4, cy=0.35, compat: bool = False, burn: int = 100) -> np.ndarray:
    """Two populations and their common forcing: survivors plus the recruits of four steps before (Sugihara et al. 2012, S4).

    With compat the survivors of the second population are a share of the first, as in a historical implementation.
    """
    total = n + burn
    grow = lambda v, rate, s, push: v * rate * (1 - v) * np.exp(push * s)
    s, x, y, rx, ry = r.normal(size=total), np.zeros(total), np.zeros(total), np.zeros(total), np.zeros(total)
    x[:4], y[:4], rx[0], ry[0] = r.uniform(size=4), r.uniform(size=4), r.uniform(), r.uniform()
    for t in range(1, total):
        if t >= 4:
            x[t] = cx * x[t - 1] + max(rx[t - 4], 0.0)
            y[t] = cy * (x if compat else y)[t - 1] + max(ry[t - 4], 0.0)
        rx[t], ry[t] = grow(x[t - 1], rxx, s[t - 1], rxt), grow(y[t - 1], ryy, s[t - 1], ryt)
    return np.stack([x, y, s], axis=1)[burn:]


def common_driver(r, n: int, cwx: float, cwy: float, cxz: float, cyz: float, product: bool = False, sw=1.0, sx=1.0, sy=1.0, sz=1.0) -> np.ndarray:
    """w drives x and y, which drive z: linearly, or by their product times cxz."""
    w = sw * r.normal(size=n)
    x, y = sx * r.normal(size=n), sy * r.normal(size=n)
    x[1:] += cwx * w[:-1]
    y[1:] += cwy * w[:-1]
    z = sz * r.normal(size=n)
    z[1:] += cxz * x[:-1] * y[:-1] if product else cxz * x[:-1] + cyz * y[:-1]
    return np.stack([w, x, y, z], axis=1)


MODELS = {f.__name__: f for f in (logistic_network, lorenz, ornstein_uhlenbeck, henon, two_species, fishery, common_driver)}


def ensemble(spark: SparkSession, model: str, members: int, columns: int, seed: int = 1, **kw) -> DataFrame:
    """series_id, t, x0...: independent members of a model, each from a seed of its own."""
    names = [f"x{i}" for i in range(columns)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        member = int(pdf["member"].iloc[0])
        x = MODELS[model](np.random.default_rng([seed, member]), **kw)
        return pd.DataFrame(x, columns=names).assign(series_id=str(member), t=np.arange(len(x)))[["series_id", "t", *names]]

    schema = "series_id string, t long, " + ", ".join(f"{n} double" for n in names)
    return spark.range(members).withColumnRenamed("id", "member").groupBy("member").applyInPandas(run, schema)
