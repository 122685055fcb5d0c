"""Information over a causal network: requests are planned on the driver from the graph alone, and run as one job.

A request names the nodes of its blocks (target x, sources y, second sources z, conditions w). All requests
of a call, with their shuffled copies for significance tests, become rows of one table that is dealt out to the
executors; the series itself is shared once, within a size bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.functions import information as info
from lagweave.operators import graph as G

#: Values of a series that may be shared with the executors (512 MB).
SHARED_VALUES = 64_000_000
LEAST_ROWS = 100
#: Query rows of one task, and sums that these can have at most (log radius, 15 sets of four blocks).
QUERY_ROWS, SUMS = 2048, 16
_SUMS = [f"s{i}" for i in range(SUMS)]
RESULT = (
    "kind string, target string, source string, tau int, status string, n long, d int, value double, total double, s double, r double, "
    "uxz double, uyz double, independent boolean, upper double, lower double"
)


def name(nodes) -> str:
    return ";".join(f"{v},{lag}" for v, lag in nodes)


@dataclass
class Request:
    """kind of the row; measure: mi, cmi, pid or corr; blocks of nodes by x, y, z, w."""

    kind: str
    measure: str
    x: list
    y: list = field(default_factory=list)
    z: list = field(default_factory=list)
    w: list = field(default_factory=list)
    tau: int = 0
    test: bool = False
    source: str = ""
    #: Positions among the nodes of the columns that a test shuffles, each on its own.
    shuffle: tuple[int, ...] = (0,)

    def nodes(self) -> list:
        return [*self.x, *self.y, *self.z, *self.w]

    def key(self) -> tuple:
        return self.measure, tuple(self.x), tuple(self.y), tuple(self.z), tuple(self.w), self.test, self.shuffle


def matrix(values: np.ndarray, nodes: list) -> np.ndarray:
    """Rows of nodes (variable, lag): column i is values[r + lag_i - smallest lag, variable_i]."""
    low = min(lag for _, lag in nodes)
    rows = len(values) - (max(lag for _, lag in nodes) - low)
    return np.stack([values[lag - low : lag - low + max(rows, 0), v] for v, lag in nodes], axis=1)


def _blocks(request: Request) -> tuple[list[int] | None, dict[str, list[int]]]:
    """Order of the request's columns (None: as they are) and the blocks they make."""
    nx, ny, nz, nw = (len(b) for b in (request.x, request.y, request.z, request.w))
    d = nx + ny + nz + nw
    if request.measure == "pid":
        # First and second sources are x and y of the decomposition, the target is z.
        order = [*range(nx, nx + ny), *range(nx + ny, nx + ny + nz), *range(nx), *range(nx + ny + nz, d)]
        ends = np.cumsum([ny, nz, nx, nw])
        return order, {b: list(range(a, e)) for b, a, e in zip("xyzw", [0, *ends[:-1]], ends, strict=True) if e > a}
    return None, {"x": list(range(nx)), "y": list(range(nx, nx + ny))} | ({"w": list(range(nx + ny, d))} if nw else {})


def _sets(request: Request) -> list[str] | None:
    """Sets of blocks whose entropies the request needs; None: all."""
    if request.measure == "pid":
        return None
    return ["w", "wx", "wy", "wxy"] if request.w else ["x", "y", "xy"]


def partial(points: np.ndarray, request: Request, approach: str, k: int, rule: str, kernel: str, start: int, stop: int) -> list[float]:
    """What query rows start to stop of the sample add to the request's estimate."""
    if request.measure == "corr":
        return [float(np.corrcoef(points[:, 0], points[:, 1])[0, 1])] if not start else [0.0]
    if not request.y:
        return [0.0]
    order, blocks = _blocks(request)
    return info.entropy_sums(points if order is None else points[:, order], blocks, approach, k, rule, kernel, start, stop, _sets(request))


def finished(sums: list[float], n: int, request: Request, approach: str, k: int, base: float) -> dict:
    """The request's estimate from the sums over all n rows."""
    if request.measure == "corr" or not request.y:
        return {"value": sums[0]}
    h = info.entropies_from(sums, n, _blocks(request)[1], approach, k, base, _sets(request))
    if request.measure == "pid":
        m = info.algebra(h)
        return {"value": m["ixyz"], "total": m["ixyz"], **{c: m[c] for c in ("s", "r", "uxz", "uyz")}}
    return {"value": h["wx"] + h["wy"] - h["w"] - h["wxy"] if request.w else h["x"] + h["y"] - h["xy"]}


def information_of(df: DataFrame, blocks: dict[str, list[str]], names: list[str], approach: str = "knn", k: int = 5, base: float = math.e, rule: str = "silverman", kernel: str = "gaussian", time: str = "t") -> DataFrame:
    """One row of the measures `names` of the blocks (name: columns) of one sample, null rows left out.

    The sample is shared within SHARED_VALUES; blocks of query rows are tasks, whose sums are added up.
    """
    info.checked(blocks)
    spark, columns = df.sparkSession, [c for b in blocks.values() for c in b]
    at = {b: [columns.index(c) for c in cs] for b, cs in blocks.items()}
    points = _collected(df, columns, time)
    points = points[~np.isnan(points).any(1)]
    n, shared = len(points), spark.sparkContext.broadcast(points)

    def sums(batches):
        for b in batches:
            got = [info.entropy_sums(shared.value, at, approach, k, rule, kernel, i * QUERY_ROWS, (i + 1) * QUERY_ROWS) for i in b["id"]]
            yield pd.DataFrame([g + [0.0] * (SUMS - len(g)) for g in got], columns=_SUMS)

    def finish(batches):
        for b in batches:
            m = [info.algebra(info.entropies_from([r[c] for c in _SUMS], n, at, approach, k, base)) for _, r in b.iterrows()]
            yield pd.DataFrame([[x[c] for c in names] for x in m], columns=names)

    parts = -(-n // QUERY_ROWS)
    added = spark.range(0, parts, 1, max(1, parts)).mapInPandas(sums, ", ".join(f"{c} double" for c in _SUMS)).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return added.mapInPandas(finish, ", ".join(f"{c} double" for c in names))


def long_measures(row: DataFrame) -> DataFrame:
    """measure, value: a row per column of measures."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in row.columns])))


def shares(row: DataFrame, scale: str) -> DataFrame:
    """Measures as shares of the one named `scale`; null where that is 0."""
    return row.select(*[(F.col(c) / F.nullif(F.col(scale), F.lit(0.0))).alias(c) for c in row.columns if c != scale])


def _collected(df: DataFrame, columns: list[str], time: str) -> np.ndarray:
    """The values of a series in order of time, within SHARED_VALUES."""
    n = df.count()
    if n * len(columns) > SHARED_VALUES:
        raise ValueError(f"a series of {n} rows is beyond what is shared; aggregate it or use series of blocks")
    return df.select(time, *columns).orderBy(time).toPandas()[columns].to_numpy(float)


def estimate(points: np.ndarray, request: Request, approach: str, k: int, base: float, rule: str, kernel: str) -> dict:
    """The request's estimate from the whole sample at once."""
    return finished(partial(points, request, approach, k, rule, kernel, 0, len(points)), len(points), request, approach, k, base)


class Network:
    """Series (t, value columns), parents map and optional strengths [source, target, lag]; every method gives a DataFrame of RESULT."""

    def __init__(
        self, series: DataFrame, columns: list[str], parents: G.Parents, strengths: np.ndarray | None = None, taumax: int = 10, approach: str = "knn", k: int = 5,
        base: float = math.e, rule: str = "silverman", kernel: str = "gaussian", first_order: bool = False, ntest: int = 100, alpha: float = 0.05, seed: int = 1, time: str = "t",
    ):
        if len(columns) < 2 or len(columns) != len(parents):
            raise ValueError("a network needs at least two variables and parents for each of them")
        self.series, self.columns, self.strengths, self.taumax, self.time = series, columns, strengths, taumax, time
        self.approach, self.k, self.base, self.rule, self.kernel = approach, k, base, rule, kernel
        self.ntest, self.alpha, self.seed = ntest, alpha, seed
        self.set_parents(G.nearest_parents(parents) if first_order else parents)
        self._shared = None

    # Parents

    def set_parents(self, parents: G.Parents) -> None:
        self.parents = parents
        self.graph = G.CausalGraph(parents, self.strengths, max(4 * self.taumax, 4 * self.max_lag()) + 8)

    def max_lag(self) -> int:
        return max((-lag for ps in self.parents.values() for _, lag in ps), default=1)

    def keep_above(self, threshold: float) -> None:
        self.set_parents(G.parents_above(self.strengths, self.parents, threshold))

    def keep_strongest(self) -> None:
        self.set_parents(G.strongest_parents(self.strengths, self.parents))

    # Execution

    def _values(self):
        if self._shared is None:
            self._shared = self.series.sparkSession.sparkContext.broadcast(_collected(self.series, self.columns, self.time))
        return self._shared

    def close(self) -> None:
        """Release the shared series; results that were not yet computed cannot be computed any more."""
        if self._shared is not None:
            self._shared.destroy()
            self._shared = None

    def run(self, requests: list[Request]) -> DataFrame:
        """One row per request; equal requests are estimated once. Single shuffles of tests, and blocks of query rows, are tasks."""
        spark, values = self.series.sparkSession, self._values()
        approach, k, base, rule, kernel, seed, alpha = self.approach, self.k, self.base, self.rule, self.kernel, self.seed, self.alpha
        distinct = {r.key(): r for r in requests}
        number = {key: i for i, key in enumerate(distinct)}
        jobs = list(distinct.values())
        blocks = max(1, -(-len(values.value) // QUERY_ROWS))
        tasks = [(i, rep, block) for i, r in enumerate(jobs) for rep in range(1 + (self.ntest if r.test else 0)) for block in range(blocks if r.y and r.measure != "corr" else 1)]
        plan = spark.sparkContext.broadcast(jobs)

        def work(batches):
            for b in batches:
                out = []
                for i, rep, block in zip(b["request"], b["rep"], b["block"], strict=True):
                    r = plan.value[i]
                    nodes = r.nodes()
                    m = matrix(values.value, nodes)
                    if rep:  # before rows with missing values go, as the shuffle is of the whole column
                        rng = np.random.default_rng([seed, i, rep])
                        for c in r.shuffle:
                            m[:, c] = rng.permutation(m[:, c])
                    m = m[~np.isnan(m).any(1)]
                    start, sums = block * QUERY_ROWS, []
                    if len(m) >= LEAST_ROWS and start < len(m):
                        sums = partial(m, r, approach, k, rule, kernel, start, start + QUERY_ROWS)
                    out.append((i, rep, len(m), len(nodes), *sums, *[0.0] * (SUMS - len(sums))))
                yield pd.DataFrame(out, columns=["request", "rep", "n", "d", *_SUMS])

        def finish(batches):
            for b in batches:
                out = []
                for i, rep, n, d, *sums in b[["request", "rep", "n", "d", *_SUMS]].itertuples(index=False):
                    ok = n >= LEAST_ROWS
                    got = finished(list(sums), int(n), plan.value[i], approach, k, base) if ok else {}
                    out.append((i, rep, "ok" if ok else "too_few_rows", n, d, *[got.get(c) for c in ("value", "total", "s", "r", "uxz", "uyz")]))
                frame = pd.DataFrame(out, columns=["request", "rep", "status", "n", "d", "value", "total", "s", "r", "uxz", "uyz"])
                yield frame.astype({c: "float64" for c in ("value", "total", "s", "r", "uxz", "uyz")})

        schema = "request int, rep int, status string, n long, d int, value double, total double, s double, r double, uxz double, uyz double"
        parts = max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
        table = spark.createDataFrame(tasks, "request int, rep int, block int").repartition(parts, "request", "rep", "block")
        added = table.mapInPandas(work, "request int, rep int, n long, d int, " + ", ".join(f"{c} double" for c in _SUMS))
        added = added.groupBy("request", "rep").agg(F.max("n").alias("n"), F.max("d").alias("d"), *[F.sum(c).alias(c) for c in _SUMS])
        done = added.mapInPandas(finish, schema)
        clean = {c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in ("value", "total", "s", "r", "uxz", "uyz")}
        done = done.withColumns(clean)
        true = done.filter("rep = 0").drop("rep")
        asked = spark.createDataFrame([(number[r.key()], r.kind, name(r.x), r.source or name([*r.y, *r.z]), r.tau) for r in requests], "request int, kind string, target string, source string, tau int")
        if any(r.test for r in jobs):
            tests = done.filter("rep > 0").groupBy("request").agg(F.percentile("value", F.lit(1 - alpha)).alias("upper"), F.percentile("value", F.lit(alpha)).alias("lower"))
            true = true.join(tests, "request", "left").withColumn("independent", F.col("value") <= F.col("upper"))
        else:
            true = true.withColumns({"upper": F.lit(None).cast("double"), "lower": F.lit(None).cast("double"), "independent": F.lit(None).cast("boolean")})
        columns = [c.split()[0] for c in RESULT.split(", ")]
        return asked.join(true, "request").select(*columns)

    # Requests of single measures

    def _cmi(self, kind, x, y, w=(), tau=0, test=False, source="") -> Request:
        y, w = list(y), [n for n in w if n not in y and n not in x]
        return Request(kind, "cmi" if w else "mi", list(x), y, [], w, tau, test, source)

    def _pid(self, kind, x, y, z, w=(), tau=0, source="") -> list[Request]:
        return [Request(kind, "pid", list(x), list(y), list(z), [n for n in w if n not in (*x, *y, *z)], tau, False, source)] if y and z else []

    def total(self, target: int, test: bool = False) -> list[Request]:
        return [self._cmi("total", [(target, 0)], self.parents[target], test=test)]

    def pairwise(self, source: int, target: int, conditioned: bool = True, test: bool = False) -> list[Request]:
        own = [n for n in self.parents[target] if n[0] == source]
        rest = [n for n in self.parents[target] if n[0] != source] if conditioned else []
        return [self._cmi("pairwise", [(target, 0)], own, rest, test=test, source=str(source))]

    def two_node(self, source, target, conditioned: bool = True, causalpath: bool = True, test: bool = False) -> list[Request]:
        w = [] if not conditioned else self.graph.mitp_condition(source, target) if causalpath else self.graph.mit_condition(source, target)
        return [self._cmi("two_node", [target], [source], w, -source[1], test)]

    def three_node(self, first, second, target, conditioned: bool = True, reduce: bool = False) -> list[Request]:
        w = self.graph.mpid_condition([first], [second], target, reduce) if conditioned else []
        return self._pid("three_node", [target], [first], [second], w)

    def mitp(self, sources, target, conditioned: bool = True, reduce: bool = False, test: bool = False, tau: int = 0) -> list[Request]:
        w, linked, _ = self.graph.cit_components(sources, target, reduce, linked=True)
        return [self._cmi("mitp", [target], linked, w if conditioned else [], tau, test, name(sources))]

    def _markov(self, sources) -> list:
        return [(v, min(lag for _, lag in sources) - 1) for v in range(len(self.columns))]

    def mitp_markov(self, sources, target, conditioned: bool = True, test: bool = False, tau: int = 0) -> list[Request]:
        linked = [s for s in sources if self.graph.link(s, target)]
        return [self._cmi("mitp_markov", [target], linked, self._markov(sources) if conditioned else [], tau, test, name(sources))]

    def mpid(self, first, second, target, conditioned: bool = True, reduce: bool = False) -> list[Request]:
        return self._pid("mpid", [target], first, second, self.graph.mpid_condition(first, second, target, reduce) if conditioned else [])

    def mpid_markov(self, first, second, target, conditioned: bool = True, tau: int = 0) -> list[Request]:
        return self._pid("mpid_markov", [target], first, second, self._markov([*first, *second]) if conditioned else [], tau)

    def _history(self, target, w, ptc, tau, pid, test, f=(), prefix="", every: bool = False) -> list[Request]:
        out = [
            self._cmi(prefix + "cit", [target], ptc, [*w, *f], tau, test and every, source="immediate"),
            self._cmi(prefix + "past", [target], w, f, tau, test, source="distant"),
        ]
        if pid:
            for label, nodes, cond in (("total", self.parents[target[0]], f), ("immediate", ptc, [*w, *f]), ("past", w, f)):
                own, cross = [n for n in nodes if n[0] == target[0]], [n for n in nodes if n[0] != target[0]]
                out += self._pid(f"{prefix}pid_{label}", [target], own, cross, cond, tau, label)
        return out

    def cit(self, sources, target, tau: int = 1, reduce: bool = False, pid: bool = False, test: bool = False, nearest: bool = False, every: bool = False, most: int | None = None) -> list[Request]:
        """Total, immediate and distant information of one lag; sources are variables. A test is of the distant one, with `every` of all three.

        With `most`, of the conditions beyond the target's own parents only that many stay, those of strongest edges into the causal paths.
        """
        w, ptc, path = self.graph.cit_components([(v, -tau) for v in sources], target, reduce)
        if most is not None:
            w = self.graph.strongest_conditions(w, path, target, most)
        if nearest and w:
            w = [(v, max(lag for v2, lag in w if v2 == v)) for v in G.unique(v for v, _ in w)]
        t = self._cmi("tit", [target], self.parents[target[0]], tau=tau, test=test and every, source="total")
        return [t, *self._history(target, w, ptc, tau, pid, test, every=every)]

    def cit_markov(self, sources, target, tau: int = 1, pid: bool = False, test: bool = False) -> list[Request]:
        _, ptc, _ = self.graph.cit_components([(v, -tau) for v in sources], target)
        t = self._cmi("tit", [target], self.parents[target[0]], tau=tau, source="total")
        return [t, *self._history(target, [(v, -tau - 1) for v in range(len(self.columns))], ptc, tau, pid, test)]

    def bundled(self, first, second, target, tau: int = 5, level: int = 1, reduce: bool = True, pid: bool = True) -> list[Request]:
        """History of a bundle of variables (first and second together) given the rest; information decomposed between the two."""
        w, ptc, f, _ = self.graph.bundled_components([*first, *second], target, tau, level, reduce)
        both = [n for n in self.parents[target[0]] if n[0] in (*first, *second)]
        out = [self._cmi("bundled_tit", [target], both, f, tau, source="total"), *self._history(target, w, ptc, tau, False, False, f, "bundled_")]
        if pid:
            for label, nodes, cond in (("total", both, f), ("immediate", ptc, [*w, *f]), ("past", w, f)):
                a, b = [n for n in nodes if n[0] in first], [n for n in nodes if n[0] in second]
                out += self._pid(f"bundled_pid_{label}", [target], a, b, cond, tau, label)
        return out

    # Sweeps: the same requests for many pairs and lags, as one job

    def _pairs(self):
        n = len(self.columns)
        return [(i, j) for i in range(n) for j in range(n)]

    def correlation_set(self, tau: int = 1) -> DataFrame:
        return self.run([Request("corr", "corr", [(j, k)], [(i, 0)], tau=k, source=str(i)) for i, j in self._pairs() for k in range(tau)])

    def mi_set(self, test: bool = False) -> DataFrame:
        return self.run([self._cmi("mi", [(j, 0)], [(i, 0)], test=test, source=str(i)) for i, j in self._pairs() if i < j])

    def te_set(self, test: bool = False) -> DataFrame:
        return self.run([self._cmi("te", [(j, 0)], [(i, -1)], [(j, -1)], 1, test, str(i)) for i, j in self._pairs() if i != j])

    def pairwise_set(self, conditioned: bool = True, test: bool = False) -> DataFrame:
        n = range(len(self.columns))
        return self.run([r for i, j in self._pairs() for r in self.pairwise(i, j, conditioned, test)] + [r for j in n for r in self.total(j, test)])

    def two_node_set(self, source: int, target: int, taumax: int = 5, **kw) -> DataFrame:
        return self.run([r for k in range(1, min(taumax, self.taumax) + 1) for r in self.two_node((source, -k), (target, 0), **kw)])

    def three_node_set(self, first: int, second: int, target: int, taumax: int = 5, **kw) -> DataFrame:
        lags = range(1, min(taumax, self.taumax) + 1)
        return self.run([r for i in lags for j in lags if (first, i) != (second, j) for r in self.three_node((first, -i), (second, -j), (target, 0), **kw)])

    def mitp_set(self, taumax: int | None = None, markov: bool = False, **kw) -> DataFrame:
        f = self.mitp_markov if markov else self.mitp
        taus = range(2, (taumax or self.taumax) + 1)
        return self.run([r for i, j in self._pairs() for k in taus for r in f([(i, -m) for m in range(1, k)], (j, 0), tau=k, **kw)])

    def mpid_markov_set(self, taus: list[int], **kw) -> DataFrame:
        n = range(len(self.columns))
        return self.run([r for t in taus for a in n for b in n if a < b for j in n
                         for r in self.mpid_markov([(a, -m) for m in range(1, t)], [(b, -m) for m in range(1, t)], (j, 0), tau=t, **kw)])

    def cit_set(self, sources: list[int], targets: list[int], taumax: int, markov: bool = False, **kw) -> DataFrame:
        """The causal history over lags 1..taumax of each target."""
        if self.graph.taumax < taumax + 2 * self.max_lag() + 1:
            self.graph.taumax = taumax + 2 * self.max_lag() + 1
        f = self.cit_markov if markov else self.cit
        return self.run([r for j in targets for k in range(1, taumax + 1) for r in f(sources, (j, 0), k, **kw)])

    def bundled_set(self, first: list[int], second: list[int], target: int, taumax: int, **kw) -> DataFrame:
        if self.graph.taumax < taumax + 2 * self.max_lag() + 1:
            self.graph.taumax = taumax + 2 * self.max_lag() + 1
        return self.run([r for k in range(1, taumax + 1) for r in self.bundled(first, second, (target, 0), k, **kw)])

    def lag_functions(self, taumax: int | None = None, test: bool = False) -> DataFrame:
        """Information (mi) and momentary information transfer (mit) of every pair and lag."""
        out = []
        for i, j in self._pairs():
            for k in range(0, (taumax if taumax is not None else self.taumax) + 1):
                if k or i != j:
                    out.append(self._cmi("mi", [(j, 0)], [(i, -k)], (), k, test, str(i)))
                    out.append(self._cmi("mit", [(j, 0)], [(i, -k)], self.graph.mit_condition((i, -k), (j, 0)), k, test, str(i)))
        return self.run(out)


def network_of(series: DataFrame, columns: list[str], edges: DataFrame, strengths: DataFrame | None = None, lagged_only: bool = False, **kw) -> Network:
    """A network from tables: edges (dst, src, lag <= 0) and strengths (src, dst, lag >= 0, value), variables by their place in `columns`.

    Both tables are of variables and lags, not of rows of the series. With `lagged_only`, edges of lag 0 are left out.
    Variables without edges have no parents; strengths that are missing are 0.
    """
    rows = (edges.filter("lag <> 0") if lagged_only else edges).select("dst", "src", "lag").distinct().orderBy("dst", "src", F.desc("lag")).collect()
    parents: G.Parents = {v: [] for v in range(len(columns))}
    for dst, src, lag in rows:
        if dst not in parents or src not in parents or lag > 0:
            raise ValueError(f"edge {(dst, src, lag)} is not of the {len(columns)} variables, or its lag is above 0")
        parents[dst].append((src, lag))
    values = None
    if strengths is not None:
        cells = strengths.select("src", "dst", "lag", "value").collect()
        values = np.zeros((len(columns), len(columns), 1 + max([r["lag"] for r in cells] + [-lag for _, _, lag in rows], default=0)))
        for src, dst, lag, value in cells:
            values[src, dst, lag] = value or 0.0
    return Network(series, columns, parents, values, **kw)


def independence(df: DataFrame, x: list[str], y: list[str], w: list[str] | None = None, shuffle: list[str] | None = None, approach: str = "kde", k: int = 5, ntest: int = 100, alpha: float = 0.05, time: str = "t", **kw) -> DataFrame:
    """One row: value, independent, upper, lower of the (conditional) information of x and y against samples with shuffled columns.

    `shuffle` names the columns that are permuted, each on its own (the first of x without it). `independent` is true if
    the value is not above the upper quantile. Fewer than LEAST_ROWS complete rows give a null with status too_few_rows.
    """
    columns = [*x, *y, *(w or [])]
    missing = [c for c in shuffle or [] if c not in columns]
    if missing or len(set(columns)) < len(columns):
        raise ValueError(f"columns to shuffle that are in no block: {missing}" if missing else "a column may be in one block only")
    net = Network(df, columns, {v: [] for v in range(len(columns))}, taumax=1, approach=approach, k=k, ntest=ntest, alpha=alpha, time=time, **kw)
    at = {c: (i, 0) for i, c in enumerate(columns)}
    nodes = [[at[c] for c in block] for block in (x, y, w or [])]
    one = Request("test", "cmi" if w else "mi", nodes[0], nodes[1], [], nodes[2], 0, True, shuffle=tuple(columns.index(c) for c in shuffle or x[:1]))
    return net.run([one]).select("status", "n", "value", "independent", "upper", "lower")


def history(results: DataFrame) -> DataFrame:
    """One row per target and lag: tit, cit, past, their sizes and dimensions, decompositions and the test of past."""

    def of(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    aggs = [of(k, "value").alias(k) for k in ("tit", "cit", "past")]
    aggs += [of(k, c).alias(f"{c}_{k}") for c in ("n", "d") for k in ("tit", "cit", "past")]
    for label in ("total", "immediate", "past"):
        aggs.append(F.struct(*[of(f"pid_{label}", c).alias(c) for c in ("s", "r", "uxz", "uyz")]).alias(f"pid_{label}"))
    aggs.append(F.struct(of("past", "independent").alias("independent"), of("past", "upper").alias("upper"), of("past", "lower").alias("lower")).alias("sst"))
    return results.groupBy("target", "tau").agg(*aggs)


def estimate_parents(series: DataFrame, columns: list[str], taumax: int, k: int = 5, alpha: float = 0.05, max_conds: int = 10, initial_conds: int = 2, max_trials: int = 10, ntest: int = 100, seed: int = 1) -> G.Parents:
    """Parents by the PC step with conditional-independence tests (Runge et al. 2012): candidates that the strongest
    others make independent go; conditions grow from initial_conds. Every round is one job over all targets."""
    n = len(columns)
    net = Network(series, columns, {v: [] for v in range(n)}, taumax=taumax, k=k, ntest=ntest, alpha=alpha, seed=seed)
    alive = {v: [(s, -lag) for lag in range(1, taumax + 1) for s in range(n)] for v in range(n)}
    strength: dict[tuple, float] = {}
    for size in [0, *range(initial_conds, max_conds + 1)]:
        requests, about = [], []
        for v in range(n):
            if size and len(alive[v]) <= size:
                continue
            for c in alive[v]:
                others = sorted((o for o in alive[v] if o != c), key=lambda o: -strength.get((v, o), 0.0))
                for trial in range(1 if not size else min(max_trials, max(1, len(others) - size + 1))):
                    requests.append(net._cmi(f"{v}", [(v, 0)], [c], others[trial : trial + size], trial, True, name([c])))
                    about.append((v, c))
        if not requests:
            break
        for r in net.run(requests).collect():  # candidates of a small graph
            v, c = int(r["kind"]), tuple(int(x) for x in r["source"].split(","))
            if r["status"] == "ok":
                strength[v, c] = min(strength.get((v, c), math.inf), r["value"])
                if r["independent"] and c in alive[v]:
                    alive[v].remove(c)
    return alive
