import glob
import math
import os

import duckdb
import numpy as np
import pytest

from lagweave import queries
from lagweave.functions import information as info
from lagweave.operators import density, filters, graph, prepare, simulate
from lagweave.plans.network import Network, Request, history, independence, matrix, network_of
from lagweave.streaming.windows import window_information

SF = "/root/testdata/sf0.001"


def rows(records):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in records), key=lambda r: [str(x) for x in r])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert rows(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == rows(tuple(r[i] for i in order) for r in rel.fetchall())


def test_digamma():
    assert np.allclose(info.psi(np.array([1, 2, 5])), [-info.EULER, 1 - info.EULER, 1 + 1 / 2 + 1 / 3 + 1 / 4 - info.EULER])


def test_gaussian_information_and_symmetry():
    r = np.random.default_rng(0)
    x = r.normal(size=3000)
    y = 0.8 * x + 0.6 * r.normal(size=3000)
    m = np.stack([x, y], axis=1)
    got = info.mutual_information(m, 1, 5)
    assert abs(got + 0.5 * math.log(1 - 0.64)) < 0.05
    assert math.isclose(got, info.mutual_information(m[:, ::-1], 1, 5), abs_tol=1e-12)
    assert math.isclose(got, info.mutual_information(m[r.permutation(3000)], 1, 5), abs_tol=1e-9)
    assert math.isclose(got, info.information(m, {"x": [0], "y": [1]}, "knn", 5)["ixy"], abs_tol=1e-9)


@pytest.mark.parametrize("kind", ["spread", "copies", "steps", "rounded", "equal"])
def test_tree_search_equals_comparing_all_pairs(monkeypatch, kind):
    r = np.random.default_rng(4)
    m = np.c_[np.round(r.exponential(50, 1500), 2), r.integers(0, 300, 1500)].astype(float)
    points = {"spread": r.standard_cauchy((1500, 3)), "copies": np.repeat(m[:300], 5, axis=0), "steps": np.round(m / 20) * 0.1,
              "rounded": r.normal(size=(1500, 2)) * 1e-13 + 1e3, "equal": np.zeros((1500, 2))}[kind]
    spaces = [[j] for j in range(points.shape[1])]
    for k in (1, 5, 40):
        radius, counts = info.neighbour_statistics(points, k, spaces)
        monkeypatch.setattr(info, "TREE_POINTS", 100)
        tree_radius, tree_counts = info.neighbour_statistics(points, k, spaces)
        monkeypatch.undo()
        assert (radius == tree_radius).all() and all((a == b).all() for a, b in zip(counts, tree_counts, strict=True))


def test_tree_search_holds_few_distances(monkeypatch):
    """All pairs of 256 rows and 60,000 points are 120 MB at a time, and the whole takes minutes."""
    m = np.random.default_rng(6).normal(size=(60_000, 2))
    monkeypatch.setattr(info, "ROWS", 1 << 40)  # the search by all pairs would need 29 GB
    assert abs(info.mutual_information(m, 1, 5)) < 0.02


def test_sliding_information_of_windows(spark):
    r = np.random.default_rng(9)
    data = [(1_700_000_000 + int(t), float(a), int(b)) for t, a, b in zip(r.integers(0, 200_000, 400), r.normal(size=400), r.integers(0, 9, 400), strict=True)]
    df = spark.createDataFrame([*data, (1_700_000_000, None, 1), (1_800_000_000, 1.0, 2)], "s long, pairs double, start int").selectExpr("timestamp_seconds(s) AS ts", "pairs", "start")
    got = {int(x["start"].timestamp()): (x["n"], x["mi"]) for x in window_information(df, "pairs", "start").collect()}
    want = {}
    for s, a, b in [*data, (1_800_000_000, 1.0, 2)]:
        for first in range(s - s % 21_600 - 64_800, s + 1, 21_600):
            want.setdefault(first, []).append((a, b))
    assert set(got) == set(want)
    for first, pairs in want.items():
        n, mi = got[first]
        assert n == len(pairs)
        assert mi is None if n <= 5 else math.isclose(mi, info.mutual_information(np.array(pairs), 1, 5), abs_tol=1e-9)


def test_conditional_information_of_a_chain_vanishes():
    r = np.random.default_rng(1)
    x = r.normal(size=2000)
    w = x + r.normal(size=2000)
    y = w + r.normal(size=2000)
    assert abs(info.conditional_mutual_information(np.stack([x, y, w], axis=1), 1, 1, 5)) < 0.05


@pytest.mark.parametrize("approach", ["knn", "kde"])
def test_decomposition_sums_to_the_total(approach):
    m = np.random.default_rng(2).normal(size=(300, 4))
    m[:, 2] += m[:, 0] * m[:, 1]
    for blocks in ({"x": [0], "y": [1], "z": [2]}, {"x": [0], "y": [1], "z": [2], "w": [3]}):
        got = info.information(m, blocks, approach, 5)
        assert math.isclose(got["s"] + got["r"] + got["uxz"] + got["uyz"], got["ixyz"], abs_tol=1e-9)


def test_general_kernels_integrate_to_one():
    at = np.linspace(-6, 6, 4001)[:, None]
    for kernel in ("gaussian", "epanechnikov", "quartic"):
        p = info.general_kernel_density(np.zeros((1, 1)), at, np.eye(1), kernel)
        assert abs(p.sum() * (at[1, 0] - at[0, 0]) - 1) < 1e-3


def test_cit_components():
    full = {v: [(0, -1), (1, -1), (2, -1)] for v in range(3)}
    g = graph.CausalGraph(full, taumax=20)
    for tau in (1, 2, 3):
        w, ptc, path = g.cit_components([(v, -tau) for v in range(3)], (0, 0))
        assert sorted(w) == [(v, -tau - 1) for v in range(3)] and sorted(ptc) == [(v, -1) for v in range(3)] and len(path) == 3 * tau
    chem = graph.CausalGraph(queries.CHEM6, taumax=20)
    w, ptc, path = chem.cit_components([(v, -5) for v in range(6)], (4, 0))
    assert set(ptc) == {(1, -1), (4, -3), (4, -1)} and len(path) == 14 and len(w) == 12
    assert chem.link((1, -1), (4, 0)) == "directed" and chem.link((0, -2), (4, 0)) == "causalpath" and chem.link((5, -1), (4, 0)) is None
    with pytest.raises(ValueError):
        chem.between((0, -21), (4, 0))


def test_paths_with_neighbours():
    p = {0: [(3, -1)], 1: [(3, -1)], 2: [(0, -1), (1, -1)], 3: []}
    assert set(graph.side_path_condition(p, (0, -1), (1, -1), (2, 0), 5)) == {(3, -2)}


def test_ancestors_have_no_depth_limit(spark):
    chain = graph.dag(graph.edge_table(spark, {0: [(0, -1)]}), 1, 60)
    assert sorted(r["node"] for r in graph.ancestors(chain, 0).collect()) == list(range(1, 61))
    assert graph.ancestors(chain, 60).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_nodes_on_paths_equal_listed_paths(seed):
    r = np.random.default_rng(seed)
    p = {v: [(int(s), -int(lag)) for s in range(4) for lag in range(3) if (lag or s < v) and r.random() < 0.25] for v in range(4)}
    source, target = (int(r.integers(4)), -int(r.integers(1, 4))), (int(r.integers(4)), 0)
    found = graph.paths_with_neighbours(p, source, target, 4)
    for side in (False, True):
        use = found["causal"] + (found["contemporaneous"] if side else [])
        assert set(graph.nodes_on_paths(p, source, target, 4, side)) == {n for path in use for n in path} - {target}, (side, p, source, target)


def test_bundled_components_of_full_bundle_and_reduction():
    chem = graph.CausalGraph(queries.CHEM6, taumax=20)
    assert chem.bundled_components([0, 1], (0, 0), 1)[2] == [(0, -3), (0, -4), (0, -5)]
    w, ptc, f, outer = chem.bundled_components(list(range(6)), (4, 0), 2)
    assert f == outer == [] and all(lag < -2 for _, lag in w) and set(ptc) == {(1, -1), (4, -1)}
    assert set(chem.bundled_components([0, 1], (0, 0), 2, 2, reduce=True)[0]) <= set(chem.bundled_components([0, 1], (0, 0), 2, 2)[0])


def test_density_keeps_rows_of_repeated_keys(spark):
    rows = [(0, 0.1), (0, 0.7), (1, 0.3), (1, 0.3), (2, None)]
    got = sorted((r["t"], round(r["p"], 9)) for r in density.density(spark.createDataFrame(rows, "t long, x double"), ["x"]).collect())
    x = np.array([[v] for _, v in rows if v is not None])
    p = info.kernel_density(x, x, info.bandwidth(x))
    assert got == sorted((t, round(v, 9)) for (t, _), v in zip(rows, p, strict=False))


def test_estimates_in_blocks_equal_the_whole(monkeypatch, spark):
    from lagweave.plans import network

    monkeypatch.setattr(network, "QUERY_ROWS", 37)
    x = np.random.default_rng(3).normal(size=(240, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "t long, a double, b double, c double")
    for approach in ("knn", "kde"):
        got = network.information_of(df, {"x": ["a"], "y": ["b"], "z": ["c"]}, ["ixyz", "r", "s"], approach).first()
        want = info.information(x, {"x": [0], "y": [1], "z": [2]}, approach)
        assert [got[m] for m in ("ixyz", "r", "s")] == pytest.approx([want[m] for m in ("ixyz", "r", "s")])
    v = network.Network(df, ["a", "b", "c"], {0: [(1, -1)], 1: [], 2: []}, taumax=2).mi_set().filter("source = '0' AND target = '1,0'").first()
    assert v["value"] == pytest.approx(info.mutual_information(x[:, [1, 0]], 1, 5)) and v["n"] == 240


def test_history_tests_all_three_if_asked():
    net = Network(None, ["a", "b", "c"], queries.FULL3, taumax=3)
    tested = lambda **kw: {r.kind for r in net.cit([0, 1, 2], (0, 0), 2, **kw) if r.test}
    assert tested() == set() and tested(test=True) == {"past"} and tested(test=True, every=True) == {"tit", "cit", "past"}


def test_neighbours():
    x = np.random.default_rng(1).normal(size=(300, 2))
    index, distance = info.neighbours(x, 4, 20, 290)
    d = np.abs(x[20:290, None] - x[None]).max(2)
    assert (index[:, 0] == np.arange(20, 290)).all() and np.allclose(distance, np.sort(d, 1)[:, :4])


def test_fishery_recruits_after_four_steps():
    x = simulate.fishery(np.random.default_rng(2), 60)
    rx = 3.1 * x[:-1, 0] * (1 - x[:-1, 0]) * np.exp(-0.3 * x[:-1, 2])  # recruits made at 1..59
    assert x.shape == (60, 3) and np.allclose(x[5:, 0], 0.4 * x[4:-1, 0] + np.maximum(rx[:-4], 0))


def test_matrix_aligns_lags():
    x = np.arange(18.0).reshape(9, 2)
    m = matrix(x, [(0, -1), (0, -2), (1, 0), (1, -3)])
    assert m.shape == (6, 4)
    assert all((m[r] == [x[r + 2, 0], x[r + 1, 0], x[r + 3, 1], x[r, 1]]).all() for r in range(6))


def test_align_keeps_missing_values(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 5.0), (2, None, 6.0), (3, 4.0, 7.0)], "t long, a double, b double")
    got = prepare.align(df, [("a", 0), ("b", -1)])
    assert got.count() == 3 and prepare.drop_missing(got).count() == 1


def test_butterworth_stops_a_constant():
    b, a = prepare.butterworth(3, 0.2)
    assert abs(prepare.filtered(np.ones(400), b, a)[-1]) < 1e-6
    b, a = prepare.butterworth(3, 0.2, "low")
    assert abs(prepare.filtered(np.ones(400), b, a)[-1] - 1) < 1e-6


def test_network_tests_and_short_series(spark):
    data = simulate.lorenz(np.random.default_rng(1), 299, e=1.0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "t long, x0 double, x1 double, x2 double")
    net = Network(df, ["x0", "x1", "x2"], queries.FULL3, taumax=3, ntest=10)
    got = history(net.cit_set([0, 1, 2], [0], 2, test=True, pid=True)).orderBy("tau").collect()
    assert [r["tau"] for r in got] == [1, 2] and got[0]["tit"] == got[1]["tit"] and got[0]["sst"]["independent"] is False
    p = got[0]["pid_total"]
    assert p["s"] is not None
    short = Network(df.filter("t < 50"), ["x0", "x1", "x2"], queries.FULL3)
    assert short.run(short.total(0)).first()["status"] == "too_few_rows"
    assert net.run([Request("a", "mi", [(0, 0)], [(1, -1)]), Request("b", "mi", [(0, 0)], [(1, -1)])]).count() == 2


def test_simulators_are_seeded(spark):
    a = simulate.ensemble(spark, "henon", 2, 2, n=50).orderBy("series_id", "t").collect()
    assert a == simulate.ensemble(spark, "henon", 2, 2, n=50).orderBy("series_id", "t").collect() and len(a) == 102


def brute_cmi(m, nw, k=5):
    """Neighbour estimate of the information of columns 0 and 1 given the other nw, by all distances."""
    d = np.abs(m[:, None] - m[None])
    r = np.sort(d.max(2), axis=1)[:, k] * (1 - 1e-10)
    psi = lambda cols: np.mean([info.psi(np.array([n]))[0] for n in (d[:, :, cols].max(2) < r[:, None]).sum(1)])
    w = list(range(2, 2 + nw))
    own = info.psi(np.array([k]))[0]
    return own + psi(w) - psi([0, *w]) - psi([1, *w]) if nw else own + info.psi(np.array([len(m)]))[0] - psi([0]) - psi([1])


def brute_parents(values, ntest=100):
    alive, strength = {v: [(s, -1) for s in range(3)] for v in range(3)}, {}
    for size in [0, *range(2, 11)]:
        asked = []
        for v in range(3):
            for c in alive[v] if not size or len(alive[v]) > size else []:
                others = sorted((o for o in alive[v] if o != c), key=lambda o: -strength.get((v, o), 0.0))
                for trial in range(1 if not size else min(10, len(others) - size + 1)):
                    asked.append((v, c, others[trial : trial + size]))
        for i, (v, c, w) in enumerate(asked):
            m, null = matrix(values, [(v, 0), c, *w]), []
            got = brute_cmi(m, len(w))
            for rep in range(1, ntest + 1):
                x = m.copy()
                x[:, 0] = np.random.default_rng([1, i, rep]).permutation(x[:, 0])
                null.append(brute_cmi(x, len(w)))
            strength[v, c] = min(strength.get((v, c), math.inf), got)
            if got <= np.percentile(null, 95) and c in alive[v]:
                alive[v].remove(c)
    return alive


def test_estimated_parents_use_the_whole_series(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(520, 3))
    x[401:, 1] += 4 * x[400:-1, 0]  # a link that the first 400 rows do not have
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "t long, x0 double, x1 double, x2 double")
    monkeypatch.setattr(queries, "_daily", lambda *_: df)
    asked = {}
    real = queries.estimate_parents
    monkeypatch.setattr(queries, "estimate_parents", lambda *a, **b: asked.setdefault("found", real(*a, **b)))
    queries.estimated_parents(spark, "")
    assert asked["found"] == brute_parents(x) and (0, -1) in asked["found"][1]


def test_network_matrices_hold_all_pairs(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(160, 3))
    x[1:, 2] += x[:-1, 0]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "t long, x0 double, x1 double, x2 double")
    monkeypatch.setattr(queries, "_daily", lambda *_: df)
    te = {(r["i"], r["j"]): r["te"] for r in queries.QUERIES["network_transfer_entropy_matrix"](spark, "").collect()}
    assert sorted(te) == [(i, j) for i in range(3) for j in range(3) if i != j]
    assert all(abs(v - brute_cmi(matrix(x, [(j, 0), (i, -1), (j, -1)]), 1)) < 1e-5 for (i, j), v in te.items())
    corr = {(r["i"], r["j"], r["k"]): r["v"] for r in queries.QUERIES["network_correlation_matrix"](spark, "").collect()}
    assert len(corr) == 18
    assert all(abs(v - np.corrcoef(x[k:, j], x[: len(x) - k, i])[0, 1]) < 1e-5 for (i, j, k), v in corr.items())


def test_independence_of_a_table(spark):
    r = np.random.default_rng(4)
    x, w = r.normal(size=400), r.normal(size=400)
    cells = [(i, float(a), float(a + 0.3 * r.normal()), float(b), None) for i, (a, b) in enumerate(zip(x, w, strict=True))]
    df = spark.createDataFrame(cells, "t long, x double, y double, w double, empty double")
    for approach in ("knn", "kde"):
        linked = independence(df, ["x"], ["y"], approach=approach, ntest=20).first()
        assert not linked["independent"] and linked["value"] > linked["upper"] > linked["lower"]
        both = independence(df, ["x"], ["y"], ["w"], ["x", "y"], approach=approach, ntest=20).first()
        assert not both["independent"] and both["n"] == 400
    # With nothing but w shuffled, x and y stay as they are: all samples are about as informative as the series.
    only_w = independence(df, ["x"], ["y"], ["w"], ["w"], approach="knn", ntest=20).first()
    assert only_w["lower"] - 0.2 < only_w["value"] < only_w["upper"] + 0.2
    assert independence(df, ["x"], ["empty"], ntest=2).first()["status"] == "too_few_rows"
    for bad in ({"shuffle": ["t"]}, {"w": ["x"]}):
        with pytest.raises(ValueError):
            independence(df, ["x"], ["y"], **bad)


def test_network_of_tables_without_rows_or_with_unknown_variables(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "t long, a double, b double")
    none = spark.createDataFrame([], "dst int, src int, lag int")
    net = network_of(df, ["a", "b"], none, spark.createDataFrame([], "src int, dst int, lag int, value double"))
    assert net.parents == {0: [], 1: []} and net.strengths.shape == (2, 2, 1)
    edges = spark.createDataFrame([(0, 1, 0), (0, 1, -2), (0, 1, -2)], "dst int, src int, lag int")
    assert network_of(df, ["a", "b"], edges).parents == {0: [(1, 0), (1, -2)], 1: []}
    assert network_of(df, ["a", "b"], edges, lagged_only=True).parents == {0: [(1, -2)], 1: []}
    for row in ((0, 2, -1), (0, 1, 1)):
        with pytest.raises(ValueError):
            network_of(df, ["a", "b"], spark.createDataFrame([row], "dst int, src int, lag int"))


def test_only_the_strongest_conditions_stay():
    strengths = np.zeros((6, 6, 8))
    for s in range(6):
        strengths[s] = 0.1 * (s + 1)
    g = graph.CausalGraph(queries.CHEM6, strengths, 20)
    w, _, path = g.cit_components([(v, -3) for v in range(6)], (4, 0))
    own = [n for n in w if n in g.parents((4, 0))]
    score = {n: max(g.weight(n, c) for c in g.children(n) if c in path) for n in w if n not in own}
    kept = g.strongest_conditions(w, path, (4, 0), 2)
    gone = [n for n in w if n not in kept]
    assert set(own) <= set(kept) and len(kept) == len(own) + 2 and gone
    assert min(score[n] for n in kept if n not in own) >= max(score[n] for n in gone)
    assert g.strongest_conditions(w, path, (4, 0), 99) == w


def test_blocks_are_checked():
    info.checked({"x": [0], "y": [1], "z": [2], "w": [3]}, 4)
    for bad in ({"y": [0]}, {"x": [0], "z": [1]}, {"x": []}, {"x": [0], "y": [0]}, {"x": [4]}, {"x": [0], "q": [1]}):
        with pytest.raises(ValueError):
            info.checked(bad, 4)


def test_masked_series_and_labels(spark):
    df = spark.createDataFrame([(0, 1.0, True), (1, 2.0, False), (2, None, None)], "t long, x double, m boolean")
    got = filters.masked_series(df, "x", df["m"], keep=True).orderBy("t").collect()
    assert [tuple(r) for r in got] == [(0, None, True, 1.0), (1, 2.0, False, None), (2, None, False, None)]
    assert [r["t"] for r in filters.labelled(df, {0: "zero"}, ["t"]).orderBy("t").collect()] == ["1", "2", "zero"]


def test_full_bandwidth_equals_product_kernel_if_diagonal(spark):
    points = np.random.default_rng(5).normal(size=(60, 2))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "t long, x double, y double")
    got = dict(density.general_density(df, ["x", "y"], matrix=np.eye(2) * 0.25).collect())
    same = dict(density.density(df, ["x", "y"], bandwidth=0.5).collect())
    assert got.keys() == same.keys() and all(math.isclose(got[t], same[t], rel_tol=1e-9) for t in got)
    empty = df.filter("t < 0")
    assert not density.general_density(empty, ["x", "y"]).count() and not density.density(empty, ["x"], bandwidth=1.0).count()


def test_distances_of_rounding_are_none():
    x = np.repeat(np.arange(20.0), 10)
    noisy = x + np.tile(np.arange(10) * 1e-16, 20) * (x > 0)
    m, n = (np.stack([v, v[::-1]], axis=1) for v in (x, noisy))
    assert math.isclose(info.mutual_information(m, 1, 5), info.mutual_information(n, 1, 5), abs_tol=1e-12)
