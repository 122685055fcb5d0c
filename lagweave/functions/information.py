"""Information measures of one sample matrix in numpy: nearest-neighbour and kernel estimators, and their algebra.

Nearest neighbours follow Kraskov et al. (2004) and Frenzel and Pompe (2007): r is the k-th neighbour's
max-norm distance in the joint space, a subspace counts the points strictly nearer than r, self included.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

EULER = 0.5772156649015329
#: Query rows that are compared with all points at a time.
ROWS = 256
#: Distances this near to the radius, relatively, are the radius itself: rounding decides no count.
TIE = 1e-10
#: Samples of more points, in at most so many columns, are searched by a tree of leaves of so many points, if only single columns are counted.
TREE_POINTS, TREE_COLUMNS, LEAF = 4096, 3, 64
#: Distances that the search holds at a time.
HELD = 1 << 20
MEASURES = (
    "hx", "hy", "hz", "hw", "hxy", "hx_w", "hy_w", "hxw", "hyw", "hxyw", "ixy", "ixy_w", "ixz", "iyz", "ixyz", "ii",
    "rmmi", "isource", "rmin", "r", "s", "uxz", "uyz",
)


def psi(n: np.ndarray) -> np.ndarray:
    """Digamma at positive integers: harmonic numbers less Euler's constant."""
    n = np.asarray(n, np.int64)
    table = np.r_[0.0, 0.0, np.cumsum(1.0 / np.arange(1, max(int(n.max(initial=1)), 2)))] - EULER
    return table[n]


def neighbour_statistics(points: np.ndarray, k: int, spaces: list[list[int]], start: int = 0, stop: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Radius of each point and, for each list of columns, the number of points nearer than it; of rows start to stop only if asked."""
    n = len(points)
    if k >= n:
        raise ValueError(f"k = {k} needs more than {n} points")
    if n > TREE_POINTS and points.shape[1] <= TREE_COLUMNS and start == 0 and stop is None and all(len(c) == 1 for c in spaces):
        r = np.maximum(_radii(points, k), 1e-14)
        return r, [_nearer(points[:, c[0]], r * (1 - TIE)) for c in spaces]
    queries = points[start:stop]
    radius, counts = np.empty(len(queries)), [np.empty(len(queries), np.int64) for _ in spaces]
    for at in range(0, len(queries), ROWS):
        q = queries[at : at + ROWS]
        by_dim = [np.abs(q[:, j : j + 1] - points[None, :, j]) for j in range(points.shape[1])]
        joint = by_dim[0].copy()
        for d in by_dim[1:]:
            np.maximum(joint, d, out=joint)
        r = np.partition(joint, k, axis=1)[:, k]
        r = np.maximum(r, 1e-14)  # values that differ by rounding only are equal
        radius[at : at + ROWS] = r
        for c, cols in zip(counts, spaces, strict=True):
            near = by_dim[cols[0]]
            for j in cols[1:]:
                near = np.maximum(near, by_dim[j])
            c[at : at + ROWS] = (near < r[:, None] * (1 - TIE)).sum(1)
    return radius, counts


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.abs(queries[:, :1] - points[None, :, 0])
    for j in range(1, points.shape[1]):
        np.maximum(out, np.abs(queries[:, j : j + 1] - points[None, :, j]), out=out)
    return out


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Numbers of the points of boxes of at most `size`, cut at the median of the column of the largest spread."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own = points[at]
        half = len(at) // 2
        order = np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], half)
        todo += [at[order[:half]], at[order[half:]]]
    return out


def _radii(points: np.ndarray, k: int) -> np.ndarray:
    """The k-th neighbour's max-norm distance of each point, the same number as by comparing all pairs, in bounded memory.

    Its k-th neighbour within its leaf bounds it; then only points in boxes within that bound are compared.
    """
    leaves = _leaves(points, max(LEAF, 4 * (k + 1)))
    low, high = (np.array([f(points[at], axis=0) for at in leaves]) for f in (np.min, np.max))
    radius = np.empty(len(points))
    for own in leaves:
        bound = np.partition(_distances(points[own], points[own]), k, axis=1)[:, k]
        radius[own] = bound
        open_ = own[bound > 1e-14]  # nearer ones count as 1e-14
        if not len(open_):
            continue
        wide = radius[open_][:, None] * (1 + 1e-9)
        near, far = (np.nextafter(v, w) for v, w in (((points[open_] - wide).min(0), -np.inf), ((points[open_] + wide).max(0), np.inf)))
        others = np.concatenate([leaves[i] for i in np.flatnonzero(((low <= far) & (high >= near)).all(1))])
        others = points[others]
        others = others[((others <= far) & (others >= near)).all(1)]
        step = max(1, HELD // len(others))
        for at in range(0, len(open_), step):
            some = open_[at : at + step]
            radius[some] = np.partition(_distances(points[some], others), k, axis=1)[:, k]
    return radius


def _nearer(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For each x, the number of xs nearer than its r, itself included, by the rounded differences."""
    values, copies = np.unique(x, return_counts=True)
    before = np.r_[0, np.cumsum(copies)]

    def settled(at, inside):
        """The first place of values that is not inside, from a place near to it."""
        while len(i := np.flatnonzero((at < len(values)) & inside(np.minimum(at, len(values) - 1)))):
            at[i] += 1
        while len(i := np.flatnonzero((at > 0) & ~inside(np.maximum(at - 1, 0)))):
            at[i] -= 1
        return at

    stop = settled(np.searchsorted(values, x + r), lambda at: values[at] - x < r)
    start = settled(np.searchsorted(values, x - r), lambda at: x - values[at] >= r)
    return before[stop] - before[start]


def neighbours(points: np.ndarray, k: int, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and max-norm distances of the k nearest of each point (itself first), ties by number."""
    queries = points[start:stop]
    index, distance = np.empty((len(queries), k), np.int64), np.empty((len(queries), k))
    for at in range(0, len(queries), ROWS):
        d = np.abs(queries[at : at + ROWS, None, :] - points[None, :, :]).max(2)
        own = np.arange(len(d))
        d[own, start + at + own] = -1.0
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        index[at : at + ROWS], distance[at : at + ROWS] = best, np.maximum(np.take_along_axis(d, best, 1), 0.0)
    return index, distance


def _subsets(blocks: dict[str, list[int]]) -> dict[str, list[int]]:
    """Columns of every set of blocks, by the names of these."""
    names = ["".join(c) for m in range(1, len(blocks) + 1) for c in combinations(sorted(blocks), m)]
    return {s: [j for b in s for j in blocks[b]] for s in names}


def entropy_sums(points: np.ndarray, blocks: dict[str, list[int]], approach: str, k: int, rule: str = "silverman", kernel: str = "gaussian", start: int = 0, stop: int | None = None, names: list[str] | None = None) -> list[float]:
    """What rows start to stop add to the entropies of sets of blocks (all, or `names`): sums over rows, to be added up for all ranges.

    knn: the log radius, then psi of the neighbour count of each set but the largest; kde: minus the log density of each set.
    """
    cols = _subsets(blocks)
    if names is not None:
        cols = {s: cols[s] for s in names}
    if approach == "knn":
        part = [c for s, c in cols.items() if len(s) < len(blocks)]
        radius, counts = neighbour_statistics(points, k, part, start, stop)
        return [float(np.log(radius).sum()), *[float(psi(c).sum()) for c in counts]]
    if approach != "kde":
        raise ValueError(f"approach {approach} is neither knn nor kde")
    out = []
    for c in cols.values():
        sub = points[:, c]
        p = kernel_density(sub, sub[start:stop], bandwidth(sub, rule), kernel)
        out.append(float(-np.where(p > 0, np.log(np.where(p > 0, p, 1)), 0).sum()))
    return out


def entropies_from(sums: list[float], n: int, blocks: dict[str, list[int]], approach: str, k: int, base: float = np.e, names: list[str] | None = None) -> dict[str, float]:
    """Entropies of sets of blocks (all, or `names`) from the sums of all n rows."""
    cols = _subsets(blocks)
    if names is not None:
        cols = {s: cols[s] for s in names}
    if approach == "kde":
        return {s: v / n / np.log(base) for s, v in zip(cols, sums, strict=False)}
    at, out = iter(sums[1:]), {}
    for s, c in cols.items():
        mean_psi = psi(np.array([k]))[0] if len(s) == len(blocks) else next(at) / n
        out[s] = float((psi(np.array([n]))[0] - mean_psi + len(c) * sums[0] / n) / np.log(base))
    return out


def knn_entropies(points: np.ndarray, blocks: dict[str, list[int]], k: int, base: float = np.e) -> dict[str, float]:
    return entropies_from(entropy_sums(points, blocks, "knn", k), len(points), blocks, "knn", k, base)


def bandwidth(points: np.ndarray, rule: str = "silverman") -> np.ndarray:
    n, d = points.shape
    h = n ** (-1 / (d + 4)) * ((4 / (d + 2)) ** (1 / (d + 4)) if rule == "silverman" else 1.0)
    return h * points.std(axis=0, ddof=1 if d > 1 else 0)


def kernel_density(points: np.ndarray, at: np.ndarray, h: np.ndarray, kernel: str = "gaussian") -> np.ndarray:
    """Product-kernel density of `points` at each row of `at`."""
    out = np.empty(len(at))
    for i in range(0, len(at), ROWS):
        p = np.ones((len(at[i : i + ROWS]), len(points)))
        for j in range(points.shape[1]):
            u = (at[i : i + ROWS, j : j + 1] - points[None, :, j]) / h[j]
            p *= (np.exp(-u * u / 2) / np.sqrt(2 * np.pi) if kernel == "gaussian" else np.where(np.abs(u) < 1, 0.75 * (1 - u * u), 0.0)) / h[j]
        out[i : i + ROWS] = p.mean(1)
    return out


def general_kernel_density(points: np.ndarray, at: np.ndarray, matrix: np.ndarray, kernel: str = "gaussian", compat: bool = False) -> np.ndarray:
    """Density with a full bandwidth matrix; kernels integrate to 1 unless compat keeps their historical constants."""
    from math import gamma, pi

    d = points.shape[1]
    inv, det = np.linalg.inv(matrix), np.linalg.det(matrix)
    ball = pi ** (d / 2) / gamma(d / 2 + 1)
    out = np.empty(len(at))
    for i in range(0, len(at), ROWS):
        diff = at[i : i + ROWS, None, :] - points[None, :, :]
        q = np.einsum("nmi,ij,nmj->nm", diff, inv, diff)
        if kernel == "gaussian":
            v = np.exp(-q / 2) / np.sqrt((2 * pi) ** d)
        elif kernel == "epanechnikov":
            v = np.where(q <= 1, (d + 2) / (2 * (1.0 if compat and d == 1 else ball)) * (1 - q), 0.0)
        else:
            c = 4 / pi if compat else (d + 2) * (d + 4) / (8 * ball)
            v = np.where(q <= 1, c * (1 - q) ** 2, 0.0)
        out[i : i + ROWS] = v.mean(1) / np.sqrt(det)
    return out


def kde_entropies(points: np.ndarray, blocks: dict[str, list[int]], rule: str, kernel: str, base: float = np.e) -> dict[str, float]:
    return entropies_from(entropy_sums(points, blocks, "kde", 0, rule, kernel), len(points), blocks, "kde", 0, base)


def algebra(h: dict[str, float]) -> dict[str, float]:
    """All measures that the entropies of the blocks (w condition, x, y, z) allow, partial information included."""
    w = "w" if "w" in h else ""

    def e(s: str) -> float:
        return h["".join(sorted(s + w))]

    hw = h.get("w", 0.0)
    out = {"h" + "".join(sorted(k, key="xyzw".index)): v for k, v in h.items()}
    for a in "xyz":
        if w and a in h:
            out[f"h{a}_w"] = e(a) - hw
    for a, b in ("xy", "xz", "yz"):
        if a in h and b in h:
            out[f"i{a}{b}"] = h[a] + h[b] - h["".join(sorted(a + b))]
            if w:
                out[f"i{a}{b}_w"] = e(a) + e(b) - hw - e(a + b)
    if {"x", "y", "z"} <= set(h):
        tail = "_w" if w else ""
        total = e("xy") + e("z") - hw - e("xyz")
        ii = total - out[f"ixz{tail}"] - out[f"iyz{tail}"]
        if w:  # conditional informations below 0 by rounding only are 0
            out |= {m: 0.0 for m in ("ixy_w", "ixz_w", "iyz_w", "hx_w", "hy_w") if out[m] < 0 and abs(out[m]) < 1e-5 * abs(hw)}
        ixy, ixz, iyz = (out[f"i{p}{tail}"] for p in ("xy", "xz", "yz"))
        rmmi, source, rmin = min(ixz, iyz), ixy / min(e("x") - hw, e("y") - hw), (-ii if ii < 0 else 0.0)
        r = rmin + source * (rmmi - rmin)
        out |= {"ixyz": total, "ii": ii, "rmmi": rmmi, "isource": source, "rmin": rmin, "r": r, "s": r + ii, "uxz": ixz - r, "uyz": iyz - r}
    return out


def information(points: np.ndarray, blocks: dict[str, list[int]], approach: str = "knn", k: int = 5, base: float = np.e, rule: str = "silverman", kernel: str = "gaussian") -> dict[str, float]:
    if approach == "knn":
        return algebra(knn_entropies(points, blocks, k, base))
    if approach == "kde":
        return algebra(kde_entropies(points, blocks, rule, kernel, base))
    raise ValueError(f"approach {approach} is neither knn nor kde")


def checked(blocks: dict[str, list], width: int | None = None) -> None:
    """Raises unless the blocks are x, y, z, w in this order of need, not empty, without common columns and within `width` columns."""
    columns = [c for b in blocks.values() for c in b]
    if not set(blocks) <= set("wxyz") or "x" not in blocks or ("z" in blocks and "y" not in blocks):
        raise ValueError(f"blocks {sorted(blocks)} are not x, then y, then z, and w")
    if not all(blocks.values()) or len(set(columns)) < len(columns):
        raise ValueError("a block is empty, or a column is in two blocks")
    if width is not None and any(not 0 <= c < width for c in columns):
        raise ValueError(f"a column is outside the {width} of the sample")


def normalized(m: dict[str, float], magnitude: bool = False) -> dict[str, float]:
    """Measures as shares of their scale: informations of the joint entropy or, of the magnitude kind, of the total information."""
    scale = m.get("ixyz") if magnitude and "ixyz" in m else m.get("hxyz", m.get("hxy", m.get("hx")))
    return {k: (v / scale if scale else float("nan")) for k, v in m.items() if k[0] in "irsu"}


def mutual_information(points: np.ndarray, nx: int, k: int) -> float:
    d = points.shape[1]
    _, (cx, cy) = neighbour_statistics(points, k, [list(range(nx)), list(range(nx, d))])
    return float(psi(np.array([len(points)]))[0] + psi(np.array([k]))[0] - psi(cx).mean() - psi(cy).mean())


def conditional_mutual_information(points: np.ndarray, nx: int, ny: int, k: int) -> float:
    d = points.shape[1]
    x, y, w = list(range(nx)), list(range(nx, nx + ny)), list(range(nx + ny, d))
    _, (cxw, cyw, cw) = neighbour_statistics(points, k, [x + w, y + w, w])
    return float(psi(cw).mean() + psi(np.array([k]))[0] - psi(cxw).mean() - psi(cyw).mean())
