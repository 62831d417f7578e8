"""Clustering of the units of each flow; label -1 is noise.

DBSCAN over an edge table is distributed. The others are NumPy kernels that get one flow at a time, as a
matrix of features or of distances. Up to ``MOST_UNITS`` units distances are held; beyond that ``Rows`` computes
them from the features as they are asked for, so that memory grows with a flow's units and not with their
square, while time still does. Labels are numbered by their first unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components

#: Bytes that one flow's matrices may take in a task, and how many of its size the kernels hold at once.
MATRIX_BYTES = 1 << 30
MATRICES = 4
#: Hence the largest flow whose matrix of distances is held.
MOST_UNITS = int((MATRIX_BYTES / MATRICES / 8) ** 0.5)


def dbscan_edges(units: DataFrame, edges: DataFrame, unit: str, eps: float, min_samples: int) -> DataFrame:
    """(unit, cluster): DBSCAN over pairs (unit_a, unit_b, d); an absent pair is far. A cluster is named by its smallest core unit.

    Core units have ``min_samples`` units within ``eps``, themselves included; a border unit joins the
    cluster with the smallest name among its core neighbours. Runs jobs.
    """
    a, b = f"{unit}_a", f"{unit}_b"
    near = edges.where(F.col("d") <= eps)
    both = near.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(near.select(F.col(b).alias("u"), F.col(a).alias("v")))
    core = units.join(both.groupBy("u").agg(F.count(F.lit(1)).alias("n")), units[unit] == F.col("u"), "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select(F.col(unit).alias("core"))
    cu, cv = core.withColumnRenamed("core", "u"), core.withColumnRenamed("core", "v")
    inner = both.join(cu, "u", "left_semi").join(cv, "v", "left_semi").select("u", "v")
    roots = components(inner)
    named = core.join(roots, core["core"] == roots["node"], "left").select(F.col("core"), F.coalesce("root", "core").alias("cluster"))
    border = both.join(named.withColumnRenamed("core", "v"), "v").groupBy("u").agg(F.min("cluster").alias("edge_cluster"))
    j = units.join(named, units[unit] == named["core"], "left").join(border, units[unit] == border["u"], "left")
    return j.select(unit, F.coalesce("cluster", "edge_cluster", F.lit(-1)).cast("long").alias("cluster"))


def by_first(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered from 0 by the first unit of each; negatives are noise."""
    out, seen = np.full(len(labels), -1), {}
    for i, x in enumerate(labels.tolist()):
        if x >= 0:
            out[i] = seen.setdefault(x, len(seen))
    return out


def distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    d = np.sqrt(np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


#: Distances that a kernel looks at in one step.
_CELLS = 4 << 20


class Rows:
    """Distances of feature vectors, row by row where they are asked for: d[i], or d[a:b].

    From differences, so that a pair has the same distance from both sides and in every row it is part of.
    """

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, float)

    def __len__(self) -> int:
        return len(self.x)

    def _row(self, i: int) -> np.ndarray:
        y = self.x - self.x[i]
        return np.sqrt(np.einsum("ij,ij->i", y, y))

    def __getitem__(self, i: int | slice) -> np.ndarray:
        return np.array([self._row(k) for k in range(*i.indices(len(self)))]) if isinstance(i, slice) else self._row(i)


class SparseRows:
    """Rows of a table of pairs (places i, j and d): an absent pair is ``far``."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, far: float):
        u, v, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])
        order = np.argsort(u, kind="stable")
        self.n, self.far, self.at, self.d = n, far, v[order], d[order]
        self.starts = np.searchsorted(u[order], np.arange(n + 1))

    def __len__(self) -> int:
        return self.n

    def _row(self, i: int) -> np.ndarray:
        row, of = np.full(self.n, self.far), slice(self.starts[i], self.starts[i + 1])
        row[self.at[of]] = self.d[of]
        row[i] = 0
        return row

    def __getitem__(self, i: int | slice) -> np.ndarray:
        return np.array([self._row(k) for k in range(*i.indices(self.n))]) if isinstance(i, slice) else self._row(i)


def parts(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows of ``width`` numbers, each of ``_CELLS`` numbers at most, a row at least."""
    step = max(1, _CELLS // max(1, width))
    return (slice(a, min(n, a + step)) for a in range(0, n, step))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((x[p, None, :] - centres[None]) ** 2).sum(2).argmin(1) for p in parts(len(x), centres.size)])


def kth_least(d: np.ndarray | Rows | SparseRows, k: int) -> np.ndarray:
    """Each unit's ``k``-th least distance, its own 0 included."""
    return np.concatenate([np.partition(d[p], k - 1, axis=1)[:, k - 1] for p in parts(len(d), len(d))])


def spread_seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` units, each drawn with the square of its distance to the ones before."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(min(k, len(x)) - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(centres)


def kmeans(x: np.ndarray, n_clusters: int = 8, seed: int = 0, iterations: int = 100) -> np.ndarray:
    c = spread_seeds(x, n_clusters, np.random.default_rng(seed))
    for _ in range(iterations):
        lab = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1) if len(x) * len(c) * x.shape[1] < 5e7 else np.concatenate([((p[:, None, :] - c[None]) ** 2).sum(2).argmin(1) for p in np.array_split(x, 64)])
        new = np.array([x[lab == k].mean(0) if (lab == k).any() else c[k] for k in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return lab


def minibatch_kmeans(x: np.ndarray, n_clusters: int = 8, batch_size: int = 256, seed: int = 0, iterations: int = 200) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = spread_seeds(x, n_clusters, rng)
    n = np.zeros(len(c))
    for _ in range(iterations):
        part = x[rng.integers(len(x), size=min(batch_size, len(x)))]
        lab = ((part[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        for k in np.unique(lab):
            m = lab == k
            n[k] += m.sum()
            c[k] += (part[m].mean(0) - c[k]) * m.sum() / n[k]
    return nearest_centre(x, c)


def dbscan(d: np.ndarray | Rows | SparseRows, eps: float = 0.5, min_samples: int = 5) -> np.ndarray:
    if not len(d):
        return np.zeros(0, int)
    core = np.concatenate([(d[p] <= eps).sum(1) for p in parts(len(d), len(d))]) >= min_samples
    lab, k = np.full(len(d), -1), 0
    for i in range(len(d)):
        if core[i] and lab[i] < 0:
            stack = [i]
            lab[i] = k
            while stack:
                j = stack.pop()
                if core[j]:
                    new = np.flatnonzero((d[j] <= eps) & (lab < 0))
                    lab[new] = k
                    stack += new.tolist()
            k += 1
    return lab


def optics_order(d: np.ndarray | Rows | SparseRows, min_samples: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, reachability, core distance)."""
    n = len(d)
    core = kth_least(d, min(min_samples, n)) if n >= min_samples and n else np.full(n, np.inf)
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        open_ = np.flatnonzero(~done)
        i = open_[np.argmin(reach[open_])]
        done[i] = True
        order.append(i)
        if np.isfinite(core[i]):
            reach = np.where(done, reach, np.minimum(reach, np.maximum(core[i], d[i])))
    return np.array(order), reach, core


def optics(d: np.ndarray | Rows | SparseRows, min_samples: int = 5, xi: float = 0.05, min_cluster_size: float | None = None) -> np.ndarray:
    """Clusters from the reachability plot by steep areas: the smallest xi-clusters win over those that hold them."""
    order, reach, _ = optics_order(d, min_samples)
    r = np.append(reach[order], np.inf)
    n = len(order)
    least = min_samples if min_cluster_size is None else max(2, int(min_cluster_size * n)) if min_cluster_size < 1 else int(min_cluster_size)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(np.isinf(r[:-1]) & np.isinf(r[1:]), 1.0, np.where(r[1:] == 0, np.inf, r[:-1] / r[1:]))
    down, up = ratio >= 1 / (1 - xi), ratio <= 1 - xi

    def area(flag: np.ndarray, other: np.ndarray, i: int) -> int:
        end, calm = i, 0
        for j in range(i, n):
            if flag[j]:
                end, calm = j, 0
            elif other[j] or (r[j] < r[j + 1] if flag is down else r[j] > r[j + 1]):
                break
            else:
                calm += 1
                if calm > min_samples:
                    break
        return end

    starts, found, mib, i = [], [], 0.0, 0
    while i < n:
        mib = max(mib, r[i])
        if down[i]:
            starts = [s for s in starts if mib <= s["top"] * (1 - xi)]
            for s in starts:
                s["mib"] = max(s["mib"], mib)
            e = area(down, up, i)
            starts.append({"a": i, "b": e, "top": r[i], "mib": 0.0})
            i, mib = e + 1, r[e + 1] if e + 1 < len(r) else 0.0
        elif up[i]:
            starts = [s for s in starts if mib <= s["top"] * (1 - xi)]
            for s in starts:
                s["mib"] = max(s["mib"], mib)
            e = area(up, down, i)
            i, mib = e + 1, r[e + 1] if e + 1 < len(r) else 0.0
            top = r[e + 1] if e + 1 < len(r) else np.inf
            for s in starts:
                if s["mib"] > top * (1 - xi):
                    continue
                a, b = s["a"], e
                if s["top"] * (1 - xi) >= top:
                    while a < s["b"] and r[a + 1] > top:
                        a += 1
                elif top * (1 - xi) >= s["top"]:
                    while b > a and r[b] > s["top"]:
                        b -= 1
                if b - a + 1 >= least:
                    found.append((a, b))
        else:
            i += 1
    lab, k = np.full(n, -1), 0
    for a, b in sorted(set(found), key=lambda c: c[1] - c[0]):
        if (lab[a : b + 1] < 0).all():
            lab[a : b + 1] = k
            k += 1
    out = np.full(n, -1)
    out[order] = lab
    return out


def hdbscan(d: np.ndarray | Rows | SparseRows, min_cluster_size: int = 5, min_samples: int | None = None, method: str = "eom", details: dict | None = None) -> np.ndarray:
    """Clusters of most stability in the condensed tree of the mutual-reachability spanning tree.

    ``details`` gets the tree's edges (mst), the membership probabilities and each cluster's persistence.
    """
    n = len(d)
    if n < 2:
        return np.full(n, -1)
    k = min(min_samples or min_cluster_size, n)
    core = kth_least(d, k)
    inside, best, link, mst = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(d[at], np.maximum(core[at], core))
        closer = ~inside & (reach < best)
        best[closer], link[closer] = reach[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        mst.append((int(link[at]), at, float(best[at])))
    # Single linkage: node n + i joins two nodes at mst weight i.
    parent, size, kids = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, (a, b, w) in enumerate(sorted(mst, key=lambda e: e[2])):
        a, b = find(a), find(b)
        parent[a] = parent[b] = n + i
        size[n + i] = size[a] + size[b]
        kids[n + i] = (a, b, w)

    def leaves(a: int) -> list[int]:
        out, stack = [], [a]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += kids[x][:2]
        return out

    clusters = [{"birth": 0.0, "parent": -1, "points": [], "children": []}]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        if node < n:
            clusters[c]["points"].append((node, np.inf))
            continue
        a, b, w = kids[node]
        lam = 1 / w if w > 0 else np.inf
        big = [x for x in (a, b) if size[x] >= min_cluster_size]
        if len(big) == 2:
            for x in (a, b):
                clusters.append({"birth": lam, "parent": c, "points": [], "children": []})
                clusters[c]["children"].append(len(clusters) - 1)
                clusters[c].setdefault("splits", []).append((lam, size[x]))
                stack.append((x, len(clusters) - 1))
        else:
            for x in (a, b):
                if big and x == big[0]:
                    stack.append((x, c))
                else:
                    clusters[c]["points"] += [(p, lam) for p in leaves(x)]
    finite = [lam for c in clusters for _, lam in c["points"] if np.isfinite(lam)]
    top = max(finite, default=1.0)
    stable = []
    for c in clusters:
        gone = [(min(lam, top), 1) for _, lam in c["points"]] + [(min(lam, top), s) for lam, s in c.get("splits", [])]
        stable.append(sum((lam - min(c["birth"], top)) * s for lam, s in gone))
    chosen = [not c["children"] for c in clusters]
    if method == "eom":
        value = list(stable)
        for i in range(len(clusters) - 1, 0, -1):
            if clusters[i]["children"]:
                under = sum(value[j] for j in clusters[i]["children"])
                chosen[i] = stable[i] >= under
                value[i] = max(stable[i], under)
    chosen[0] = False
    lab, prob = np.full(n, -1), np.zeros(n)
    picked = []
    stack = [0]
    while stack:
        i = stack.pop()
        if chosen[i]:
            picked.append(i)
            members, todo = [], [i]
            while todo:
                j = todo.pop()
                members += clusters[j]["points"]
                todo += clusters[j]["children"]
            most = max((min(lam, top) for _, lam in members), default=1.0)
            for p, lam in members:
                lab[p], prob[p] = i, min(lam, top) / most if most > 0 else 1.0
        else:
            stack += clusters[i]["children"]
    if details is not None:
        details |= {"mst": mst, "probability": prob, "persistence": {i: stable[i] for i in picked}, "core": core}
    return lab


def linkage_chain(d: np.ndarray | Rows | SparseRows, n_clusters: int, linkage: str) -> np.ndarray:
    """The same merging by a chain of nearest neighbours, over one half of the matrix: 4 bytes times n squared."""
    n = len(d)
    m = np.empty(n * (n - 1) // 2)
    base = np.arange(n) * (2 * n - np.arange(n) - 1) // 2 - np.arange(n) - 1  # where row i's column j is, less j
    for p in parts(n, n):
        for i, row in zip(range(p.start, p.stop), d[p], strict=True):
            m[base[i] + i + 1 : base[i] + n] = row[i + 1 :] ** 2 if linkage == "ward" else row[i + 1 :]
    alive, size, first, merges, chain = np.arange(n), np.ones(n), 0, [], []
    gone = np.zeros(n, bool)

    def places(i: int) -> np.ndarray:
        other = alive[alive != i]
        return other, np.where(other < i, base[other] + i, base[i] + other)

    while len(merges) < n - 1:
        if not chain:
            while gone[first]:
                first += 1
            chain.append(first)
        i = chain[-1]
        other, at = places(i)
        row = m[at]
        k = int(row.argmin())
        if len(chain) > 1:
            back = int(np.searchsorted(other, chain[-2]))
            if row[back] <= row[k]:
                j = chain[-2]
                del chain[-2:]
                h = row[back]
                i, j = min(i, j), max(i, j)
                merges.append((float(h), i, j))
                gone[j] = True
                ours, to = places(i)
                to = to[ours != j]
                theirs, by = places(j)
                by = by[theirs != i]
                o = ours[ours != j]
                a, b = m[to], m[by]
                if linkage == "single":
                    m[to] = np.minimum(a, b)
                elif linkage == "complete":
                    m[to] = np.maximum(a, b)
                elif linkage == "ward":
                    m[to] = ((size[i] + size[o]) * a + (size[j] + size[o]) * b - size[o] * h) / (size[i] + size[j] + size[o])
                else:
                    m[to] = (size[i] * a + size[j] * b) / (size[i] + size[j])
                size[i] += size[j]
                alive = alive[alive != j]
                continue
        chain.append(int(other[k]))
    return cut_tree(n, merges, n_clusters)


def agglomerative(d: np.ndarray | Rows | SparseRows, n_clusters: int = 2, linkage: str = "average") -> np.ndarray:
    """Lance-Williams merging; 'ward' takes Euclidean distances."""
    if isinstance(d, Rows):
        return ward_chain(d.x, n_clusters) if linkage == "ward" else linkage_chain(d, n_clusters, linkage)
    n = len(d)
    m = (d**2 if linkage == "ward" else d).astype(float).copy()
    np.fill_diagonal(m, np.inf)
    size, lab, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - min(n_clusters, n)):
        i, j = np.unravel_index(m.argmin(), m.shape)
        i, j = min(i, j), max(i, j)
        if linkage == "single":
            row = np.minimum(m[i], m[j])
        elif linkage == "complete":
            row = np.maximum(np.where(np.isinf(m[i]), -np.inf, m[i]), np.where(np.isinf(m[j]), -np.inf, m[j]))
        elif linkage == "ward":
            row = ((size[i] + size) * m[i] + (size[j] + size) * m[j] - size * m[i, j]) / (size[i] + size[j] + size)
        else:
            row = (size[i] * m[i] + size[j] * m[j]) / (size[i] + size[j])
        alive[j] = False
        m[i], m[:, i] = row, row
        m[j], m[:, j] = np.inf, np.inf
        m[~alive, i] = m[i, ~alive] = m[i, i] = np.inf
        size[i] += size[j]
        lab[lab == j] = i
    return lab


def ward_chain(x: np.ndarray, n_clusters: int) -> np.ndarray:
    """Ward's merging of points by a chain of nearest neighbours: clusters are centroids, no matrix is held.

    Each merge is of two clusters that are each other's nearest, which gives the tree that merging the nearest
    of all gives; cut where ``n_clusters`` are left.
    """
    n = len(x)
    c, size, alive, first = x.astype(float).copy(), np.ones(n), np.ones(n, bool), 0
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            while not alive[first]:
                first += 1
            chain.append(first)
        i = chain[-1]
        d = ((c - c[i]) ** 2).sum(1) * (2 * size * size[i] / (size + size[i]))
        d[~alive] = d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            del chain[-2:]
            i, j = min(i, j), max(i, j)
            merges.append((float(d[j] if np.isfinite(d[j]) else d[i]), i, j))
            c[i] = (size[i] * c[i] + size[j] * c[j]) / (size[i] + size[j])
            size[i] += size[j]
            alive[j] = False
        else:
            chain.append(j)
    return cut_tree(n, merges, n_clusters)


def cut_tree(n: int, merges: list[tuple[float, int, int]], n_clusters: int) -> np.ndarray:
    """Labels after the least of the (height, i, j) merges, as many as leave ``n_clusters``; i, j are members."""
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for _, i, j in sorted(merges, key=lambda m: m[0])[: n - min(n_clusters, n)]:
        parent[find(j)] = find(i)
    return np.array([find(i) for i in range(n)])


def birch(x: np.ndarray, n_clusters: int | None = 3, threshold: float = 0.5) -> np.ndarray:
    """Subclusters of bounded radius in one pass, then Ward merging of their centroids."""
    sums, squares, n, owner, most = np.empty((64, x.shape[1])), np.empty(64), np.empty(64), np.zeros(len(x), int), 0
    centres = np.empty_like(sums)
    for i, p in enumerate(x.astype(float)):
        if most:
            k = int(((centres[:most] - p) ** 2).sum(1).argmin())
            t, q, m = sums[k] + p, squares[k] + p @ p, n[k] + 1
            if np.sqrt(max(0.0, q / m - (t / m) @ (t / m))) <= threshold:
                sums[k], squares[k], n[k], owner[i], centres[k] = t, q, m, k, t / m
                continue
        if most == len(n):
            sums, centres = np.concatenate([sums, sums]), np.concatenate([centres, centres])
            squares, n = np.concatenate([squares, squares]), np.concatenate([n, n])
        sums[most], centres[most], squares[most], n[most], owner[i] = p, p, p @ p, 1, most
        most += 1
    if n_clusters is None or most <= n_clusters:
        return owner
    if most <= MOST_UNITS // 4:  # merging by a whole matrix takes time with the cube
        return agglomerative(distances(centres[:most]), n_clusters, "ward")[owner]
    return ward_chain(centres[:most], n_clusters)[owner]


def top_vectors(n: int, times: Callable[[np.ndarray], np.ndarray], k: int, block: int = 32, seed: int = 0) -> np.ndarray:
    """Eigenvectors of the ``k`` largest eigenvalues, ascending, of a symmetric matrix known by its products: block Krylov to 1e-10."""
    block = min(max(block, 2 * k), n)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, block)))[0]
    image = times(basis)
    while True:
        w, y = np.linalg.eigh((lambda h: (h + h.T) / 2)(basis.T @ image))
        v, mv = basis @ y[:, -k:], image @ y[:, -k:]
        if basis.shape[1] >= n or np.abs(mv - v * w[-k:]).max() <= 1e-10 * max(1.0, abs(w[-1])):
            return v
        new = image[:, -block:]
        for _ in range(2):  # twice, so that it is orthogonal to rounding
            new = new - basis @ (basis.T @ new)
        new = np.linalg.qr(new)[0]
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0][:, : n - basis.shape[1]]
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])


def spectral(d: np.ndarray | Rows | SparseRows, n_clusters: int = 8, gamma: float = 1.0, seed: int = 0) -> np.ndarray:
    if not isinstance(d, Rows):
        a = np.exp(-gamma * d**2)
        deg = np.sqrt(a.sum(1))
        _, v = np.linalg.eigh(a / deg[:, None] / deg[None, :])
        return kmeans(v[:, -n_clusters:] / deg[:, None], n_clusters, seed)
    n, x, s = len(d), d.x, (d.x * d.x).sum(1)

    def times(m: np.ndarray) -> np.ndarray:
        return np.concatenate([np.exp(-gamma * np.maximum(s[p, None] + s - 2 * x[p] @ x.T, 0)) @ m for p in parts(n, n)])

    deg = np.sqrt(times(np.ones((n, 1))))
    v = top_vectors(n, lambda m: times(m / deg) / deg, n_clusters)
    return kmeans(v / deg, n_clusters, seed)


def gmm(x: np.ndarray, n_components: int = 2, seed: int = 0, iterations: int = 100, details: dict | None = None) -> np.ndarray:
    """Full-covariance mixture by expectation maximisation; ``details`` gets bic and aic."""
    n, p = x.shape
    lab = kmeans(x, n_components, seed)
    resp = np.eye(n_components)[lab]
    last = -np.inf
    for _ in range(iterations):
        w = resp.sum(0) + 1e-10
        mu = resp.T @ x / w[:, None]
        log = np.empty((n, n_components))
        for k in range(n_components):
            y = x - mu[k]
            cov = (resp[:, k, None] * y).T @ y / w[k] + 1e-6 * np.eye(p)
            chol = np.linalg.cholesky(cov)
            z = np.linalg.solve(chol, y.T)
            log[:, k] = np.log(w[k] / n) - 0.5 * (z * z).sum(0) - np.log(np.diag(chol)).sum() - 0.5 * p * np.log(2 * np.pi)
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        resp = np.exp(log - total[:, None])
        if abs(total.mean() - last) < 1e-3:
            break
        last = total.mean()
    if details is not None:
        free = n_components * (p + p * (p + 1) / 2) + n_components - 1
        details |= {"bic": free * np.log(n) - 2 * total.sum(), "aic": 2 * free - 2 * total.sum()}
    return resp.argmax(1)


def mean_shift(x: np.ndarray, bandwidth: float | None = None, quantile: float = 0.3, iterations: int = 300) -> np.ndarray:
    x = x.astype(float)
    h = bandwidth or float(kth_least(distances(x) if len(x) <= MOST_UNITS else Rows(x), max(1, int(len(x) * quantile))).mean()) or 1.0
    modes, s, live = x.copy(), (x * x).sum(1), np.arange(len(x))

    def near(m: np.ndarray) -> np.ndarray:
        if len(x) <= MOST_UNITS:
            return ((m[:, None, :] - x[None]) ** 2).sum(2) <= h * h
        return (m * m).sum(1)[:, None] + s - 2 * m @ x.T <= h * h

    steps = lambda n: parts(n, x.size if len(x) <= MOST_UNITS else len(x))
    for _ in range(iterations):
        moved = np.zeros(len(live))
        for p in steps(len(live)):
            at = near(modes[live[p]])
            new = (at @ x) / np.maximum(at.sum(1), 1)[:, None]
            moved[p] = np.abs(new - modes[live[p]]).max(1)
            modes[live[p]] = new
        if moved.max(initial=0.0) < 1e-3 * h:
            break
        live = live[moved > 0]  # a mode that did not move has come to rest
    weight = np.concatenate([near(modes[p]).sum(1) for p in steps(len(x))])
    centres = np.empty((0, x.shape[1]))
    for i in np.argsort(-weight, kind="stable"):
        if (np.sqrt(((modes[i] - centres) ** 2).sum(1)) >= h).all():
            centres = np.vstack([centres, modes[i]])
    return nearest_centre(x, centres)


def median_of(blocks: Callable[[], Iterator[np.ndarray]], n: int) -> float:
    """The median of ``n`` numbers from 0 up that come in blocks, read again for each 16 of their bits, which are ordered as they are."""

    def ranked(k: int) -> float:
        head = 0
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16, np.int64)
            for block in blocks():
                bits = np.ascontiguousarray(block).view(np.int64).ravel()
                counts += np.bincount((bits if shift == 48 else bits[bits >> (shift + 16) == head]) >> shift & 0xFFFF, minlength=1 << 16)
            least = np.cumsum(counts)
            at = int(np.searchsorted(least, k, side="right"))
            k -= int(least[at] - counts[at])
            head = head << 16 | at
        return float(np.array(head, np.int64).view(float))

    low = ranked((n - 1) // 2)
    return low if n % 2 else (low + ranked(n // 2)) / 2


def merged(*places: np.ndarray) -> np.ndarray:
    """Ascending places without repeats, from runs of them."""
    both = np.sort(np.concatenate(places), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def put_in(at: np.ndarray, values: np.ndarray, more_at: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers at ascending places, and more of them added at others."""
    both = merged(at, more_at)
    out = np.zeros(len(both))
    out[np.searchsorted(both, at)] = values
    out[np.searchsorted(both, more_at)] += more
    return both, out


def affinity_propagation(x: np.ndarray, damping: float = 0.7, preference: float | None = None, iterations: int = 200) -> np.ndarray:
    """Exemplars found on all units; every unit goes to the nearest exemplar.

    Half of the similarities is held if it fits ``MATRIX_BYTES``, or they are computed as they are asked for. A responsibility is its
    similarity times ``grown``, less a number of its row (``less``), and more by ``extra`` where it was ever the first of its row. An
    availability is a number of its column (``common``), and less by ``under`` where its responsibility was ever positive. Only such pairs are held.
    """
    n, x = len(x), np.ascontiguousarray(x, float)
    if n < 2:
        return np.full(n, -1)
    square = (x * x).sum(1)
    left, right = np.column_stack([2 * x, -square, -np.ones(n)]), np.vstack([x.T, np.ones(n), square])
    blocks = [(p, np.arange(p.stop - p.start), np.arange(p.start, p.stop)) for p in parts(n, max(n, _CELLS // 64))]
    buffers = [np.empty((len(blocks[0][1]), n)) for _ in range(2)]

    held = [left[p] @ right[:, p.start :] for p, _, _ in blocks] if n * n * 4 <= MATRIX_BYTES else []

    def similar(k: int, diagonal: float) -> np.ndarray:
        p, i, own = blocks[k]
        s = buffers[0][: len(i)]
        if held:
            s[:, p.start :] = held[k]
            for (q, _, _), rows in zip(blocks[:k], held, strict=False):
                s[:, q] = rows[:, p.start - q.start : p.stop - q.start].T
        else:
            np.matmul(left[p], right, out=s)
        s[i, own] = diagonal
        return s

    if preference is None:
        preference = -median_of(lambda: (np.maximum(-similar(k, 0.0), 0) + 0.0 for k in range(len(blocks))), n * n)
    share, grown, less, common = 1 - damping, 0.0, np.zeros(n), np.zeros(n)
    r_own, a_own, total = np.zeros(n), np.zeros(n), np.zeros(n)
    none = np.zeros(0, np.int64), np.zeros(0)
    extra, under, positive = [none] * len(blocks), [none] * len(blocks), [none] * len(blocks)
    for _ in range(iterations):
        grown, sums, low = damping * grown + share, np.zeros(n), np.minimum(total, 0)
        for k, (p, i, own) in enumerate(blocks):
            s = similar(k, preference)
            at, r = positive[k]
            drop = np.minimum(total[at % n] - r, 0) - low[at % n]
            at, drop = put_in(under[k][0], damping * under[k][1], at, share * drop)
            under[k] = at.astype(np.int32), drop
            v = np.add(s, common, out=buffers[1][: len(i)])
            v.reshape(-1)[at] += drop
            v[i, own] = a_own[p] + preference
            first = v.argmax(1)
            top = v[i, first]
            v[i, first] = -np.inf
            less[p] = damping * less[p] + share * top
            second = v[i, v.argmax(1)]
            at, more = extra[k] = put_in(extra[k][0], damping * extra[k][1], i * n + first, share * (top - second))
            most = merged(np.flatnonzero(s > less[p, None] / grown), at, i * n + own)
            r = grown * s.reshape(-1)[most] - less[p][most // n]
            r[np.searchsorted(most, at)] += more
            mine = np.searchsorted(most, i * n + own)
            r_own[p], r[mine] = r[mine], 0
            keep = r > 0
            positive[k] = most[keep].astype(np.int32), r[keep]
            sums += np.bincount(most[keep] % n, r[keep], n)
        total = sums + r_own
        a_own = damping * a_own + share * sums
        common = damping * common + share * np.minimum(total, 0)
    exemplars = np.flatnonzero(a_own + r_own > 0)
    return nearest_centre(x, x[exemplars]) if len(exemplars) else np.full(n, -1)


def classical_mds(d: np.ndarray, dims: int = 8) -> np.ndarray:
    """Coordinates whose Euclidean distances approximate ``d``."""
    n = len(d)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    w, v = w[::-1][:dims], v[:, ::-1][:, :dims]
    return v * np.sqrt(np.maximum(w, 0))


#: name -> (kernel, what it takes: 'x' features or 'd' distances)
REGISTRY: dict[str, tuple[Callable[..., np.ndarray], str]] = {
    "kmeans": (kmeans, "x"),
    "minibatch_kmeans": (minibatch_kmeans, "x"),
    "dbscan": (dbscan, "d"),
    "optics": (optics, "d"),
    "hdbscan": (hdbscan, "d"),
    "agglomerative": (agglomerative, "d"),
    "birch": (birch, "x"),
    "spectral": (spectral, "d"),
    "gmm": (gmm, "x"),
    "meanshift": (mean_shift, "x"),
    "affinity_propagation": (affinity_propagation, "x"),
}
ALIASES = {"mini_batch_kmeans": "minibatch_kmeans", "mean_shift": "meanshift", "gaussian_mixture": "gmm", "affinity": "affinity_propagation"}


def clusterer(name: str, **params) -> Callable[[np.ndarray, bool], np.ndarray]:
    """A fit of (matrix, whether it holds distances) -> labels, by name; 'two_stage' takes first, second and their params."""
    name = ALIASES.get(name, name)
    if name == "two_stage":
        return two_stage(**params)
    if name not in REGISTRY:
        raise ValueError(f"unknown clusterer {name!r}; one of {', '.join([*REGISTRY, 'two_stage'])}")
    kernel, takes = REGISTRY[name]

    def fit(m: np.ndarray, precomputed: bool = False) -> np.ndarray:
        if takes == "d":
            return by_first(kernel(m if precomputed else distances(m) if len(m) <= MOST_UNITS else Rows(m), **params))
        return by_first(kernel(classical_mds(m) if precomputed else m, **params))

    return fit


def two_stage(first: str, second: str, first_params: dict | None = None, second_params: dict | None = None) -> Callable[[np.ndarray, bool], np.ndarray]:
    """The second clusterer inside each cluster of the first; noise stays noise, clusters of one are kept whole, nesting is refused."""
    if "two_stage" in (first, second):
        raise ValueError("two_stage cannot be nested")

    def fit(m: np.ndarray, precomputed: bool = False) -> np.ndarray:
        a = clusterer(first, **(first_params or {}))(m, precomputed)
        out, offset = np.full(len(a), -1), 0
        for k in range(a.max() + 1):
            at = np.flatnonzero(a == k)
            params = dict(second_params or {})
            if "min_samples" in params:
                params["min_samples"] = min(params["min_samples"], len(at))
            lab = clusterer(second, **params)(m[np.ix_(at, at)] if precomputed else m[at], precomputed) if len(at) >= 2 else np.zeros(len(at), int)
            out[at] = np.where(lab >= 0, lab + offset, -1)
            offset += max(lab.max() + 1, 0)
        return out

    return fit


def audit(name: str, n_clusters: int = 4, **params) -> Callable[[np.ndarray, bool], np.ndarray]:
    """k-means, agglomerative or HDBSCAN over standardised features; HDBSCAN that finds fewer than two clusters gives way to k-means."""
    if name not in ("kmeans", "agglomerative", "hdbscan"):
        raise ValueError(f"{name!r} is none of kmeans, agglomerative, hdbscan")

    def fit(m: np.ndarray, precomputed: bool = False) -> np.ndarray:
        spread = m.std(0)
        z = (m - m.mean(0)) / np.where(spread > 0, spread, 1)
        if name == "hdbscan":
            lab = clusterer("hdbscan", **params)(z)
            if lab.max(initial=-1) >= 1:
                return lab
        k = min(n_clusters, len(z))
        return clusterer("agglomerative" if name == "agglomerative" else "kmeans", n_clusters=k)(z)

    return fit


def flow_labels(key: tuple, b: pd.DataFrame, keys: Sequence[str], unit: str, vector: str, name: str, max_clusters: int | None = None, **params) -> pd.DataFrame:
    """(keys, unit, cluster_id) of one flow's rows, units in order."""
    b = b.sort_values(unit)
    lab = clusterer(name, **params)(np.array(b[vector].tolist(), float), False)
    if max_clusters is not None:
        lab = np.where(lab < max_clusters, lab, -1)
    return b[[*keys, unit]].assign(cluster_id=lab.astype(np.int32))


def cluster_flows(features: DataFrame, keys: Sequence[str], unit: str, vector: str, name: str, max_clusters: int | None = None, overrides: dict[tuple, dict] | None = None, **params) -> DataFrame:
    """(keys, unit, cluster_id) by a named clusterer over each flow's feature vectors, units in order.

    ``overrides`` replaces parameters for single flows; clusters beyond ``max_clusters`` become noise.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in features.select(*keys, unit).dtypes) + ", cluster_id int"

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        return flow_labels(key, b, keys, unit, vector, name, max_clusters, **{**params, **(overrides or {}).get(tuple(key), {})})

    return features.withColumn(vector, F.col(vector).cast("array<double>")).select(*keys, unit, vector).groupBy(*keys).applyInPandas(run, schema)
