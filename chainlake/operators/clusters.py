"""Clustering kernels (numpy, one group at a time) and relational cluster measures."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = 2048) -> DataFrame:
    """JN-18: for each query vector the nearest other row: (key, nearest); distances to 9 digits, ties: the smaller key.

    The queries are a stated set. Both sides are packed into blocks of bounded size; each block of queries meets each
    block of rows in one matrix product, and the best of every pair of blocks is combined. Nothing is collected. Rows with a null key
    or vector are left out; a query without another row has no nearest.
    """
    import pandas as pd

    def packed(df: DataFrame, name: str) -> DataFrame:
        x = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
        n = F.lit(max(1, -(-x.count() // block)))
        return x.groupBy(F.pmod(F.xxhash64("k"), n).alias("b")).agg(F.collect_list("k").alias(f"{name}_keys"), F.flatten(F.collect_list("v")).alias(f"{name}_values")).drop("b")

    schema = f"{key} bigint, nearest bigint, d double"

    def scan(batches):
        for batch in batches:
            for qk, qv, rk, rv in zip(batch["q_keys"], batch["q_values"], batch["r_keys"], batch["r_values"], strict=True):
                x, y = np.asarray(qv).reshape(len(qk), -1), np.asarray(rv).reshape(len(rk), -1)
                d = np.empty((len(qk), len(rk)))
                for s in range(0, len(rk), 64):  # differences, not products: equal points are at distance 0
                    d[:, s : s + 64] = np.sqrt(((x[:, None, :] - y[None, s : s + 64, :]) ** 2).sum(axis=2)).round(9)
                d[np.asarray(qk)[:, None] == np.asarray(rk)[None, :]] = np.inf
                order = np.argsort(rk, kind="stable")
                at = order[d[:, order].argmin(axis=1)]
                best = d[np.arange(len(qk)), at]
                ok = np.isfinite(best)
                yield pd.DataFrame({key: np.asarray(qk)[ok], "nearest": np.asarray(rk)[at][ok], "d": best[ok]})

    pairs = packed(rows, "r").join(packed(queries, "q"))  # blocks, not rows: a stated query set against all rows
    best = pairs.mapInPandas(scan, schema)
    return best.groupBy(key).agg(F.min_by("nearest", F.struct("d", "nearest")).alias("nearest"))


class ContactSets:
    """Different contact sets of one pair, with the Jaccard distances between them made row by row, so memory grows with the sets and not with their square.

    A distance is rounded as in a matrix of them: 1 - common / union in single precision. Few sets get a matrix (dense()).
    """

    dense_limit = 3000

    def __init__(self, cells: list[np.ndarray]):
        self.count = np.array([len(c) for c in cells], dtype=np.int64)
        self.codes, self.at = np.unique(np.concatenate(cells), return_inverse=True)  # the mask's columns, in order
        self.of = np.repeat(np.arange(len(cells)), self.count)
        self.size = self.count.astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self._columns = None

    def __len__(self) -> int:
        return len(self.count)

    def mask(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Rows low..high of the 0/1 matrix of sets and cells."""
        high = len(self) if high is None else min(high, len(self))
        some = slice(self.start[low], self.start[high])
        out = np.zeros((high - low, len(self.codes)), dtype=np.float32)
        out[self.of[some] - low, self.at[some]] = 1
        return out

    def dense(self) -> np.ndarray:
        return np.stack([self.row(x) for x in range(len(self))])

    def common(self, x: int, low: int = 0) -> np.ndarray:
        """Number of cells that each set (from low on) has in common with set x."""
        if self._columns is None:
            self._columns = np.zeros((len(self.codes), len(self)), dtype=np.uint8)
            self._columns[self.at, self.of] = 1
        mine = self._columns[:, low:][self.at[self.start[x] : self.start[x + 1]]]
        return mine.sum(axis=0, dtype=np.uint8 if len(mine) < 256 else np.int32)

    def row(self, x: int, low: int = 0) -> np.ndarray:
        both = self.common(x, low).astype(np.float32)
        out = np.float32(1) - both / np.maximum(self.size[low:] + self.size[x] - both, np.float32(1))
        out[x - low] = 0
        return out

    def rows(self, block: int = 128):
        """(first row, rows) of the whole matrix, some rows at a time."""
        for low in range(0, len(self), block):
            yield low, np.stack([self.row(x) for x in range(low, min(low + block, len(self)))])

    def values(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different distances of all points to all points in order, and how many points are so far from one another."""
        top = int(self.count.max()) + 1
        n = np.zeros(top * 2 * top, dtype=np.int64)
        for x in range(len(self)):
            both = self.common(x).astype(np.int64)
            code = both * (2 * top) + self.count + self.count[x] - both
            n += int(weights[x]) * np.bincount(code, weights=weights, minlength=len(n)).astype(np.int64)
        code = np.flatnonzero(n)
        both, union = (code // (2 * top)).astype(np.float32), (code % (2 * top)).astype(np.float32)
        values, at = np.unique(np.float32(1) - both / np.maximum(union, np.float32(1)), return_inverse=True)
        return values, np.bincount(at, weights=n[code]).astype(np.int64)

    def means(self, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Share of each cell in each cluster's sets, in order of the labels."""
        keys, own = np.unique(labels, return_inverse=True)
        sums = np.bincount(own[self.of] * len(self.codes) + self.at, weights=weights.astype(float)[self.of], minlength=len(keys) * len(self.codes)).reshape(len(keys), -1)
        return list(sums / np.bincount(own, weights=weights)[:, None])


def streamed_agglomerations(sets: ContactSets, ks: list[int], linkage: str = "average", weights: np.ndarray | None = None, cache_mb: int = 160) -> dict[int, np.ndarray]:
    """CLU-1: agglomerations() of sets whose distances don't fit in memory.

    No linkage needs the matrix: a distance of two clusters is a sum, the least or the largest of their members' distances (for
    Ward's, with the scatter within each). Rows of clusters with many members are kept, the others made again from their members. A
    remembered nearest whose cluster has changed is only a lower bound, as merging brings no cluster nearer to a third, and is looked for
    again when it comes first. Distances are compared to 12 digits, so equal ones are ties.
    """
    n = len(sets)
    wanted = {max(1, min(k, n)) for k in ks}
    w = np.ones(n) if weights is None else weights.astype(float)
    adds = linkage not in ("single", "complete")
    pick = {"single": np.minimum, "complete": np.maximum}.get(linkage)
    held = np.float64 if adds else np.float32
    least = max(2, -(-n * n * np.dtype(held).itemsize // (cache_mb << 20)))  # members from which a cluster's row is kept
    total, scatter_in, parent = w.copy(), np.zeros(n), np.arange(n)
    alive, members, kept = np.ones(n, dtype=bool), [[x] for x in range(n)], {}

    def point_row(x: int) -> np.ndarray:
        d = sets.row(x)
        if linkage == "ward":
            return d.astype(float) ** 2 * ((w[x] + w) / 2)
        return w[x] * d.astype(float) if adds else d

    def points(c: int) -> np.ndarray:
        """Of a cluster with all points: the sum (weighted by its members), least or largest."""
        if c in kept:
            return kept[c]
        out = point_row(members[c][0])
        for x in members[c][1:]:
            out = out + point_row(x) if adds else pick(out, point_row(x))
        return out

    live, place = np.arange(n), np.arange(n)  # the clusters that may be alive, and the place of each among them

    def distances(c: int, row: np.ndarray | None = None) -> np.ndarray:
        """Of a cluster with all of live; infinite where there is none or itself."""
        row = points(c) if row is None else row
        if adds:
            sums = np.bincount(place[parent], weights=row if linkage == "ward" else row * w, minlength=len(live))
            mean = sums / (total[c] * total[live])
            if linkage == "ward":
                mean = 2 * total[c] * total[live] / (total[c] + total[live]) * (mean - scatter_in[c] - scatter_in[live])
        else:
            mean = np.full(len(live), np.inf if linkage == "single" else -np.inf)
            pick.at(mean, place[parent], row.astype(float))
        mean = mean.round(12)
        mean[~alive[live]] = np.inf
        mean[place[c]] = np.inf
        return mean

    near, low, stale = np.zeros(n, dtype=int), np.full(n, np.inf), np.zeros(n, dtype=bool)
    for x in range(n if n > 1 else 0):
        d = (sets.row(x).astype(float) ** (2 if linkage == "ward" else 1)).round(12)
        d[x] = np.inf
        near[x] = d.argmin()
        low[x] = d[near[x]]
    out: dict[int, np.ndarray] = {}
    for left in range(n, 0, -1):
        if left in wanted:
            _, out[left] = np.unique(parent, return_inverse=True)
        if left == min(wanted):
            break
        if left < 0.8 * len(live):
            live = np.flatnonzero(alive)
            place[live] = np.arange(len(live))
        i = int(live[low[live].argmin()])
        while stale[i]:
            d = distances(i)
            at = int(d.argmin())
            near[i], low[i], stale[i] = live[at], d[at], False
            i = int(live[low[live].argmin()])
        i, j = min(i, int(near[i])), max(i, int(near[i]))
        row = points(i) + points(j) if adds else pick(points(i), points(j))
        if linkage == "ward":
            between = float(row[members[i]].sum() - total[i] ** 2 * scatter_in[i] * 2)
            scatter_in[i] = (total[i] ** 2 * scatter_in[i] + total[j] ** 2 * scatter_in[j] + between) / (total[i] + total[j]) ** 2
        parent[members[j]] = i
        members[i] += members[j]
        members[j] = []
        kept.pop(i, None)
        kept.pop(j, None)
        if len(members[i]) >= least:
            kept[i] = row
        total[i] += total[j]
        alive[j] = False
        low[j] = np.inf
        new = distances(i, row)
        own, known, changed = low[live], ~stale[live], (near[live] == i) | (near[live] == j)
        closer = alive[live] & ((new < own) | (known & (new == own) & ((i < near[live]) | changed)))
        stale[live[changed & ~closer]] = True
        near[live[closer]], low[live[closer]], stale[live[closer]] = i, new[closer], False
        at = int(new.argmin())
        near[i], low[i], stale[i] = live[at], new[at], False
    return out


def agglomerations(distance: np.ndarray, ks: list[int], linkage: str = "average", weights: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """CLU-1: labels of k clusters for each k, from one run of Lance-Williams updates of a distance matrix; ties: the smallest pair of positions.

    A weight says how many equal points a row stands for. Every row remembers its nearest other, so a merge looks through
    the rows once and not through the matrix.
    """
    if isinstance(distance, ContactSets):
        return streamed_agglomerations(distance, ks, linkage, weights)
    n = len(distance)
    wanted = {max(1, min(k, n)) for k in ks}
    d = distance.astype(float).copy()
    if linkage == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    size, parent = np.ones(n) if weights is None else weights.astype(float), np.arange(n)
    alive = np.ones(n, dtype=bool)
    near = d.argmin(axis=1) if n else np.empty(0, dtype=int)
    low = d[np.arange(n), near] if n else np.empty(0)
    out: dict[int, np.ndarray] = {}
    for left in range(n, 0, -1):
        if left in wanted:
            _, out[left] = np.unique(parent, return_inverse=True)  # a cluster's number is the order of its first member
        if left == min(wanted):
            break
        i = int(low.argmin())
        j = int(near[i])
        if not np.isfinite(low[i]):
            rest = np.flatnonzero(alive)
            i, j = int(rest[0]), int(rest[1])
        i, j = min(i, j), max(i, j)
        a, b, s, t = d[i], d[j], size[i], size[j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "ward":
            new = ((s + size) * a + (t + size) * b - size * d[i, j]) / (s + t + size)
        else:
            new = (s * a + t * b) / (s + t)
        new[[i, j]] = np.inf
        new[~alive] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += t
        parent[parent == j] = i
        stale = np.flatnonzero(alive & ((near == i) | (near == j)))
        closer = alive & ((new < low) | ((new == low) & (i < near)))
        near[closer], low[closer] = i, new[closer]
        for r in {*stale.tolist(), i}:
            near[r] = d[r].argmin()
            low[r] = d[r, near[r]]
        low[j] = np.inf
    return out


def agglomerate(distance: np.ndarray, k: int, linkage: str = "average", weights: np.ndarray | None = None) -> np.ndarray:
    """CLU-1: agglomerations() for one number of clusters."""
    k = max(1, min(k, len(distance)))
    return agglomerations(distance, [k], linkage, weights)[k]


def cluster_sums(sets: ContactSets, cuts: list[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
    """For each cut the sums of every set's distances to the sets of each cluster, all from one pass."""
    member = np.concatenate([(labels[:, None] == np.unique(labels)) * weights.astype(float)[:, None] for labels in cuts], axis=1)
    sums = np.concatenate([rows.astype(float) @ member for _, rows in sets.rows()])
    return np.split(sums, np.cumsum([len(np.unique(labels)) for labels in cuts])[:-1], axis=1)


def silhouette(distance: np.ndarray | ContactSets, labels: np.ndarray, weights: np.ndarray | None = None, sums: np.ndarray | None = None) -> float:
    """CLU-2: mean silhouette of all points, a row standing for weight equal ones; single points count 0; -1 where it isn't defined. sums: cluster_sums() where they are there."""
    w = np.ones(len(labels)) if weights is None else weights.astype(float)
    ks = np.unique(labels)
    streamed = isinstance(distance, ContactSets)
    if len(ks) < 2 or len(ks) >= w.sum() or not (streamed or np.isfinite(distance).all()):
        return -1.0
    if streamed:
        means = cluster_sums(distance, [labels], w)[0] if sums is None else sums
    else:
        means = np.stack([distance[:, labels == k] @ w[labels == k] for k in ks], axis=1)
    sizes = np.array([w[labels == k].sum() for k in ks])
    own = np.searchsorted(ks, labels)
    at = np.arange(len(labels))
    a = means[at, own] / np.maximum(sizes[own] - 1, 1)
    others = means / sizes
    others[at, own] = np.inf
    b = others.min(axis=1)
    s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0)
    return float(w @ s / w.sum())


def best_count(
    distance: np.ndarray | ContactSets, valency: int, linkage: str = "average", extra: int = 3, fewer: int = 2, improvement: float = 0.0, weights: np.ndarray | None = None, score: str = "silhouette"
) -> np.ndarray:
    """CLU-2: labels with the number of clusters that a score favours around the valency; the valency unless one is better. Equal points (weights) stay together.

    score: silhouette, calinski_harabasz, davies_bouldin (smaller is better, so its negative counts) or gap; all but the first
    take the points of a classical scaling of the distances.
    """
    return best_counts(distance, valency, [score], linkage, extra, fewer, improvement, weights)[0]


def best_counts(
    distance: np.ndarray | ContactSets, valency: int, scores: list[str], linkage: str = "average", extra: int = 3, fewer: int = 2, improvement: float = 0.0, weights: np.ndarray | None = None, cuts: dict[int, np.ndarray] | None = None
) -> list[np.ndarray]:
    """CLU-2: best_count() by each of several scores, from one linkage and one scaling. cuts: labels by number of clusters where a linkage has run."""
    n = len(distance)
    base, tried = tried_counts(n, valency, extra, fewer)
    cuts = cuts or agglomerations(distance, [base, *tried], linkage, weights)
    cuts = {k: cuts[k] for k in {base, *tried}}
    points = None if set(scores) == {"silhouette"} else classical_scaling(distance, weights=weights)
    sums: dict[int, np.ndarray] = {}
    if isinstance(distance, ContactSets) and "silhouette" in scores:
        sums = dict(zip(cuts, cluster_sums(distance, list(cuts.values()), np.ones(n) if weights is None else weights), strict=True))
    return [_best_cut(distance, cuts, sums, points, base, tried, improvement, weights, score) for score in scores]


def tried_counts(n: int, valency: int, extra: int = 3, fewer: int = 2) -> tuple[int, range]:
    """CLU-2: the number of clusters that a valency stands for among n points, and those tried besides."""
    base = max(1, min(valency, n))
    low, high = (max(2, base - fewer) if base > 2 else base), min(base + extra, n)
    return base, range(max(2, low), high + 1)


def _best_cut(distance, cuts: dict[int, np.ndarray], sums: dict[int, np.ndarray], points: np.ndarray | None, base: int, ks: range, improvement: float, weights: np.ndarray | None, score: str) -> np.ndarray:
    def value(k: int) -> float:
        labels = cuts[k]
        if score == "silhouette":
            return silhouette(distance, labels, weights, sums.get(k))
        if score == "calinski_harabasz":
            return calinski_harabasz(points, labels, weights)
        if score == "davies_bouldin":
            return -davies_bouldin(points, labels, weights)
        return gap_statistic(points, labels, lambda x, k: kmeans(x, k, starts=1)[0])

    best = cuts[base]
    top = value(base)
    for k in ks:
        s = value(k)
        if s > top + abs(top) * improvement and s > top:
            best, top = cuts[k], s
    return best


def largest_eigen(sets: ContactSets, w: np.ndarray, dims: int, tolerance: float = 1e-7, most: int = 160, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, and their vectors, of the centred and weighted squares of distances that no matrix holds.

    A block Krylov space grows by passes over the rows until the residual of each vector is below the tolerance (of the
    largest value); a space of `most` columns starts anew from its best ones.
    """
    n, root = len(sets), np.sqrt(w)

    def squares(x: np.ndarray) -> np.ndarray:
        return np.concatenate([rows.astype(float) ** 2 @ x for _, rows in sets.rows()])

    to_mean = squares(w[:, None])[:, 0] / w.sum()
    whole = w @ to_mean / w.sum()

    def times(v: np.ndarray) -> np.ndarray:
        u = root[:, None] * v
        level = u.sum(axis=0)
        return -0.5 * root[:, None] * (squares(u) - to_mean @ u - to_mean[:, None] * level + whole * level)

    block = min(n, dims + 8)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, block)))[0]
    image = times(basis)
    for _ in range(100):
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        first = turn[:, :dims]
        left = np.linalg.norm(image @ first - (basis @ first) * values[:dims], axis=0)
        if basis.shape[1] >= n or left.max() <= tolerance * max(abs(values[0]), 1e-300):
            break
        new = image[:, -block:]
        if basis.shape[1] + block > most:
            new = image @ turn[:, :block] - (basis @ turn[:, :block]) * values[:block]  # the residuals lead on
            basis, image = basis @ turn[:, : 3 * block], image @ turn[:, : 3 * block]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
            new, size = np.linalg.qr(new)
        new = new[:, : n - basis.shape[1]]
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, times(new)], axis=1)
    return values[:dims], basis @ turn[:, :dims]


def classical_scaling(distance: np.ndarray | ContactSets, dims: int = 8, weights: np.ndarray | None = None, signed: bool = True) -> np.ndarray:
    """Points whose distances come near the given ones, by the largest eigenvalues of the centred squares."""
    n = len(distance)
    w = np.ones(n) if weights is None else weights.astype(float)
    root = np.sqrt(w)
    if isinstance(distance, ContactSets):
        values, vectors = largest_eigen(distance, w, dims)
    else:
        centre = np.eye(n) - w / w.sum()
        values, vectors = np.linalg.eigh(-0.5 * root[:, None] * (centre @ distance**2 @ centre.T) * root)
    top = np.argsort(-values)[: min(dims, n)]
    vectors = vectors[:, top] / root[:, None]
    if signed or isinstance(distance, ContactSets):
        vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(top))] < 0, -1, 1)  # a sign of its own for each axis
    return vectors * np.sqrt(np.maximum(values[top], 0))


def kmeans(points: np.ndarray, k: int, seed: int = 42, rounds: int = 100, starts: int = 10) -> tuple[np.ndarray, float]:
    """CLU-7: labels and inertia of the best of several seeded k-means++ runs."""
    best, least = np.zeros(len(points), dtype=int), np.inf
    rng = np.random.default_rng(seed)
    for _ in range(starts):
        centres = points[[rng.integers(len(points))]]
        while len(centres) < k:
            d = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(points), 1 / len(points))
            centres = np.vstack([centres, points[rng.choice(len(points), p=p)]])
        for _ in range(rounds):
            d = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
            labels = d.argmin(axis=1)
            new = np.stack([points[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        inertia = float(d.min(axis=1).sum())
        if inertia < least - 1e-12:
            best, least = labels, inertia
    return best, least


def curve_clusters(points: np.ndarray, most: int = 10, seed: int = 42) -> np.ndarray:
    """CLU-7: k-means of curves with the k of 2..most that has the best silhouette; one cluster for fewer than three curves."""
    n = len(points)
    if n < 3:
        return np.zeros(n, dtype=int)
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    best, score = np.zeros(n, dtype=int), -np.inf
    for k in range(2, min(n - 1, most) + 1):
        labels, _ = kmeans(points, k, seed)
        s = silhouette(distance, labels)
        if s > score:
            best, score = labels, s
    order = {c: i for i, c in enumerate(dict.fromkeys(best.tolist()))}
    return np.array([order[c] for c in best])


def distance_quantile(distance: np.ndarray, q: float, weights: np.ndarray) -> float:
    """np.quantile of the distances of all points to all points, row i standing for weights[i] equal points."""
    if isinstance(distance, ContactSets):
        values, counts = distance.values(weights)
        upto = np.cumsum(counts)
        at = q * (int(upto[-1]) - 1)
        low, high = (float(values[np.searchsorted(upto, k, side="right")]) for k in (np.floor(at), np.ceil(at)))
        return low + (high - low) * (at - np.floor(at))
    order = np.argsort(distance, axis=None)
    upto = np.cumsum(np.outer(weights, weights).ravel()[order])
    at = q * (int(upto[-1]) - 1)
    low, high = (float(distance.flat[order[np.searchsorted(upto, k, side="right")]]) for k in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def dbscan(distance: np.ndarray, eps: float, least: int = 2, weights: np.ndarray | None = None) -> np.ndarray:
    """CLU-1: density clusters of a distance matrix; -1 is noise. A row counts weight times as a neighbour."""
    if isinstance(distance, ContactSets):
        near = lambda x: distance.row(x) <= eps
        core = np.array([(near(x).sum() if weights is None else near(x) @ weights) >= least for x in range(len(distance))], dtype=bool)
    else:
        mask = distance <= eps
        near = mask.__getitem__
        core = (mask.sum(axis=1) if weights is None else mask @ weights) >= least
    labels = np.full(len(distance), -1)
    label = 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        todo = [int(i)]
        labels[i] = label
        while todo:
            x = todo.pop()
            if core[x]:
                for y in np.flatnonzero(near(x) & (labels < 0)):
                    labels[y] = label
                    todo.append(int(y))
        label += 1
    return labels


def smacof(distance: np.ndarray, dims: int = 2, seed: int = 42, rounds: int = 300, eps: float = 1e-6, starts: int = 4, weights: np.ndarray | None = None) -> np.ndarray:
    """CLU-9: multidimensional scaling by majorisation of the stress.

    Starts from classical scaling and from random points, and keeps the lowest stress, for a single start
    may end in a local optimum. A row stands for weight equal points, which share one place.
    """
    found = smacof_starts(distance, range(starts + 1), dims, seed, rounds, eps, weights)
    return min(found, key=lambda f: f[1])[0]


def smacof_starts(
    distance: np.ndarray | ContactSets, starts: Iterable[int], dims: int = 2, seed: int = 42, rounds: int = 300, eps: float = 1e-6, weights: np.ndarray | None = None, room: int = 1 << 17
) -> list[tuple[np.ndarray, float, float]]:
    """CLU-9: smacof() from each of these starts (0: classical scaling, else random points): places, the stress by which it ended, and the stress of the places as a share of the squared distances.

    Where matrices of all points take up to `room` values, as many starts go through their rounds together; those of more points go one after another, each pair of points once a round.
    """
    n, starts = len(distance), list(starts)
    w = np.ones(n) if weights is None else weights.astype(float)
    first = np.empty((len(starts), n, dims))
    for k, start in enumerate(starts):
        if start:
            first[k] = np.random.default_rng(seed).random((start, n, dims))[-1]
        else:
            x = classical_scaling(distance, dims, w, signed=False)
            first[k] = np.concatenate([x, np.zeros((n, dims - x.shape[1]))], axis=1)
    if n * n <= room:
        dense = distance.dense() if isinstance(distance, ContactSets) else distance
        squares = float(w @ (dense.astype(float) ** 2 @ w))
        step = lambda x: stress_steps(dense, x, w)
        some = max(1, room // (n * n))
        groups = [first[k : k + some] for k in range(0, len(starts), some)]
    else:
        pairs = PairBlocks(distance, w)
        squares = pairs.squares
        step = lambda x: tuple(v[None] for v in pairs.step(x[0]))
        groups = [x[None] for x in first]
    found = []
    for x in groups:
        going, last, base = np.arange(len(x)), np.inf, 1.0
        now, stress = x.copy(), np.empty(len(x))
        for _ in range(rounds):
            value, better = step(now)
            on = ~(last - value < eps * np.maximum(base, 1e-12))
            if not on.all():
                x[going[~on]], stress[going[~on]] = now[~on], value[~on]
                going, value, better = going[on], value[on], better[on]
                if not len(going):
                    break
            now, last, base = better, value, value
        else:
            x[going], stress[going] = now, last
        found += zip(x, stress.tolist(), (2 * step(x)[0] / max(squares, 1e-12)).tolist(), strict=True)
    return found


def stress_steps(distance: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CLU-9: stress of each of several sets of places, and the places that majorisation makes of them."""
    n = len(w)
    d = x[:, :, None, 0] - x[:, None, :, 0]
    d *= d
    for k in range(1, x.shape[2]):
        gap = x[:, :, None, k] - x[:, None, :, k]
        gap *= gap
        d += gap
    np.sqrt(d, out=d)
    gap = d - distance
    gap *= gap
    stress = (gap @ w) @ w / 2
    d.reshape(len(x), -1)[:, :: n + 1] = np.inf
    if d.min() <= 1e-12:
        d[d <= 1e-12] = np.inf
    np.divide(distance, d, out=d)
    ends = np.empty((*x.shape[:2], x.shape[2] + 1))
    np.multiply(x, w[:, None], out=ends[:, :, :-1])
    ends[:, :, -1] = w
    pull = d @ ends
    return stress, (pull[:, :, -1:] * x - pull[:, :, :-1]) / w.sum()


class PairBlocks:
    """CLU-9: the distances of all pairs of points in blocks, each pair once; blocks are kept up to held_mb, and those beyond are made again for every step."""

    def __init__(self, distance: np.ndarray | ContactSets, w: np.ndarray, held_mb: int = 200, high: int = 128, wide: int = 2048):
        self.distance, self.w, self.high, self.wide = distance, w, high, wide
        self.held: list[list[np.ndarray]] = []
        self.squares, left = 0.0, held_mb << 20
        for low in range(0, len(w), high):
            row = self._made(low)
            end = min(low + high, len(w))
            own = w[low:end] @ (row[0].astype(float) ** 2 @ w[low:end])
            self.squares += float(own + 2 * sum(w[low:end] @ (b.astype(float) ** 2 @ w[at : at + b.shape[1]]) for at, b in zip(range(end, len(w), wide), row[1:], strict=True)))
            left -= sum(b.nbytes for b in row)
            if left >= 0:
                self.held.append(row)

    def _made(self, low: int) -> list[np.ndarray]:
        """Of some rows: the block of their own columns, and those of the columns after them."""
        end = min(low + self.high, len(self.w))
        if isinstance(self.distance, ContactSets):
            rows = np.stack([self.distance.row(x, low) for x in range(low, end)])
        else:
            rows = self.distance[low:end, low:]
        cuts = [0, *range(end - low, len(self.w) - low, self.wide), len(self.w) - low]
        return [np.ascontiguousarray(rows[:, s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]

    def step(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stress of places, and the places that majorisation makes of them.

        The sum of distance times d (that of the places) follows from the new places, that of the squared d from their moments.
        """
        w, total = self.w, self.w.sum()
        centre = w @ x / total
        x = x - centre
        n, dims = x.shape
        places, ends = np.ascontiguousarray(x.T), np.concatenate([x.T * self.w, self.w[None]])
        own = (x * x).sum(axis=1)
        left, right = np.concatenate([-2 * x, own[:, None], np.ones((n, 1))], axis=1), np.concatenate([places, np.ones((1, n)), own[None]])
        least = 1e-8 * float(own.max())  # squares below it lose digits in a product
        pull, room = np.zeros((dims + 1, n)), np.empty(self.high * max(self.wide, self.high))
        for k, low in enumerate(range(0, n, self.high)):
            end = min(low + self.high, n)
            at = low
            for block in self.held[k] if k < len(self.held) else self._made(low):
                to = at + block.shape[1]
                d = room[: block.size].reshape(block.shape)
                if at > low:
                    np.matmul(left[low:end], right[:, at:to], out=d)
                if at == low or d.min() <= least:
                    np.square(places[0, low:end, None] - places[0, at:to], out=d)
                    for p in places[1:]:
                        d += np.square(p[low:end, None] - p[at:to])
                    d[d <= 1e-24] = np.inf  # the same place
                np.sqrt(d, out=d)
                np.divide(block, d, out=d)
                for m in range(dims + 1):
                    pull[m, low:end] += d @ ends[m, at:to]
                    if at > low:
                        pull[m, at:to] += ends[m, low:end] @ d
                at = to
        better = (pull[-1] * x.T - pull[:-1]).T / total
        moved = 2 * total * float(w @ (x * better).sum(axis=1))  # the sum of distance times d
        stress = (2 * total * float(w @ (x * x).sum(axis=1)) - 2 * float(((w @ x) ** 2).sum()) - 2 * moved + self.squares) / 2
        return np.float64(stress), better


def constant_potts(weights: np.ndarray, resolution: float, seed: int = 42, rounds: int = 50) -> np.ndarray:
    """CLU-8: communities by the constant Potts quality: local moving, refinement within communities, aggregation (Leiden's scheme).

    weights: symmetric, zero diagonal. Communities are numbered by size, then by their first member.
    """
    rng = np.random.default_rng(seed)

    def move(w: np.ndarray, size: np.ndarray, label: np.ndarray, within: np.ndarray | None) -> bool:
        changed = False
        total = np.zeros(len(w))
        np.add.at(total, label, size)
        queue = list(rng.permutation(len(w)))
        while queue:
            v = queue.pop(0)
            old = label[v]
            links = np.bincount(label, weights=w[v], minlength=len(w))
            gain = links - resolution * size[v] * (total - size[v] * (np.arange(len(w)) == old))
            if within is not None:
                allowed = np.zeros(len(w), dtype=bool)
                allowed[label[within == within[v]]] = True
                gain[~allowed] = -np.inf
            gain[(links <= 0) & (np.arange(len(w)) != old)] = -np.inf
            new = int(gain.argmax())
            if gain[new] > gain[old] + 1e-12:
                label[v] = new
                total[old] -= size[v]
                total[new] += size[v]
                changed = True
                queue += [u for u in np.flatnonzero(w[v] > 0) if label[u] != new and u not in queue]
        return changed

    n = len(weights)
    member = np.arange(n)
    w, size = weights.astype(float), np.ones(n)
    label = np.arange(n)
    for _ in range(rounds):
        changed = move(w, size, label, None)
        if not changed:
            break
        fine = np.arange(len(w))
        move(w, size, fine, label)
        parts, index = np.unique(fine, return_inverse=True)
        fold = np.zeros((len(parts), len(w)))
        fold[index, np.arange(len(w))] = 1
        coarse = np.array([label[np.flatnonzero(index == p)[0]] for p in range(len(parts))])
        w = fold @ w @ fold.T
        np.fill_diagonal(w, 0)
        size = fold @ size
        member = index[member]
        label = np.unique(coarse, return_inverse=True)[1]
    final = label[member]
    firsts = {c: (-(final == c).sum(), int(np.flatnonzero(final == c)[0])) for c in np.unique(final)}
    rank = {c: i for i, c in enumerate(sorted(firsts, key=firsts.get))}
    return np.array([rank[c] for c in final])


def pae_domains(pae: np.ndarray, cutoff: float = 5.0, resolution: float = 0.075) -> np.ndarray:
    """CLU-8: domains of a chain: residues are linked where the PAE is below the cutoff, with weight 1 / PAE."""
    w = np.where(pae < cutoff, 1 / np.maximum(pae, 0.2), 0)
    w = w + w.T
    np.fill_diagonal(w, 0)
    return constant_potts(w, resolution)


def merge_similar(similarity, clusters: list[np.ndarray], threshold: float) -> list[np.ndarray]:
    """CLU-5: joins the two most similar clusters again and again while they reach the threshold; similarity takes two mean matrices."""
    groups = [[c] for c in clusters]
    means = [np.asarray(c, dtype=float) for c in clusters]
    while len(means) > 1:
        pairs = [(similarity(means[i], means[j]), i, j) for i in range(len(means)) for j in range(i + 1, len(means))]
        s, i, j = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        if s < threshold:
            break
        groups[i] += groups.pop(j)
        means[i] = np.mean(groups[i], axis=0)
        means.pop(j)
    return [np.mean(g, axis=0) for g in groups]


def contact_fraction(a: np.ndarray, b: np.ndarray) -> float:
    """CLU-5 (MCFT): share of the smaller mask's contacts that the larger has; 1 for an empty one."""
    x, y = (a > 0).ravel(), (b > 0).ravel()
    n = min(x.sum(), y.sum())
    return float((x & y).sum() / n) if n else 1.0


def merge_small(similarity, masks: list[np.ndarray], sizes: list[int], threshold: float, share: float = 0.2) -> list[int]:
    """CLU-5 (MCMS): new number of each cluster when the two most similar are joined until none reaches the threshold, and clusters of less than `share` of the largest then go to the most similar larger one."""
    group = list(range(len(masks)))
    means, n = {k: x.astype(float) for k, x in enumerate(masks)}, dict(enumerate(sizes))

    def join(i: int, j: int) -> None:
        means[i] = (means[i] * n[i] + means[j] * n[j]) / (n[i] + n[j])
        n[i] += n[j]
        del means[j], n[j]
        for k, g in enumerate(group):
            if g == j:
                group[k] = i

    while len(means) > 1:
        keys = sorted(means)
        s, i, j = max(((similarity(means[i], means[j]), -i, -j) for p, i in enumerate(keys) for j in keys[p + 1 :]))
        if s < threshold:
            break
        join(-i, -j)
    largest = max(n.values())
    for k in sorted(n, key=lambda k: (n[k], k)):
        others = [o for o in n if n[o] > n[k]]
        if len(n) > 1 and n[k] < share * largest and others:
            join(max(others, key=lambda o: (similarity(means[o], means[k]), -o)), k)
    return [sorted(means).index(g) for g in group]


def merge_close(cells: list[np.ndarray], threshold: float = 10.0, how: str = "median") -> list[int]:
    """CLU-5 (MMCT): new number of each cluster when those whose contacts lie near each other's (mean or median Manhattan distance from the smaller to the larger at most the threshold) are joined, the nearest first.

    cells: the (i, j) contacts of each cluster.
    """
    group = list(range(len(cells)))
    for d, i, j in _close_joins(cells, how):
        if d > threshold:
            break
        group = [i if g == j else g for g in group]
    left = sorted(set(group))
    return [left.index(g) for g in group]


def _close_joins(cells: list[np.ndarray], how: str):
    """(distance, i, j) of the two nearest clusters, j being joined to i, again and again; distances are measured once."""
    held = dict(enumerate(cells))

    def far(x: np.ndarray, y: np.ndarray) -> float:
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        if not len(small):
            return float("inf")
        d = np.concatenate([np.abs(small[s : s + 128, None, :] - large[None, :, :]).sum(axis=2).min(axis=1) for s in range(0, len(small), 128)])
        return float(np.median(d) if how == "median" else d.mean())

    known = {(i, j): far(held[i], held[j]) for i in held for j in held if i < j}
    while known:
        d, i, j = min((d, *pair) for pair, d in known.items())
        yield d, i, j
        held[i] = np.unique(np.concatenate([held[i], held.pop(j)]), axis=0)
        known = {pair: d for pair, d in known.items() if i not in pair and j not in pair} | {(min(i, k), max(i, k)): far(held[min(i, k)], held[max(i, k)]) for k in held if k != i}


def merge_counts(similarity, means: list[np.ndarray], thresholds: np.ndarray) -> list[int]:
    """CLU-6: number of clusters left at each threshold when the two most similar are joined while they reach it: one run, for the joins are the same down to each threshold."""
    groups, held = [[m] for m in means], [np.asarray(m, dtype=float) for m in means]
    steps = []
    while len(held) > 1:
        s, i, j = max(((similarity((held[i], held[j])), -i, -j) for i in range(len(held)) for j in range(i + 1, len(held))))
        i, j = -i, -j
        steps.append(s)
        groups[i] += groups.pop(j)
        held[i] = np.mean(groups[i], axis=0)
        held.pop(j)
    out = []
    for t in thresholds:
        k = next((n for n, s in enumerate(steps) if s < t), len(steps))
        out.append(len(means) - k)
    return out


def close_counts(cells: list[np.ndarray], thresholds: np.ndarray, how: str) -> list[int]:
    """CLU-6: number of clusters that merge_close() leaves at each threshold, which falls as thresholds rise."""
    steps = [d for d, _, _ in _close_joins(cells, how)]
    return [len(cells) - next((n for n, d in enumerate(steps) if d > t), len(steps)) for t in thresholds]


def without_outliers(labels: np.ndarray, weights: np.ndarray, large: int = 10) -> np.ndarray:
    """CLU-5: clusters of a single point become -1 where some cluster has at least `large` points."""
    n = {k: weights[labels == k].sum() for k in np.unique(labels)}
    if max(n.values(), default=0) < large:
        return labels
    return np.array([-1 if n[k] == 1 else k for k in labels])


def set_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """SET-5: intersection over union of two masks; 1 for two empty ones."""
    union = np.logical_or(a > 0, b > 0).sum()
    return float(np.logical_and(a > 0, b > 0).sum() / union) if union else 1.0


def silhouettes(points: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """CLU-2 in relations: mean silhouette per key with squared Euclidean distances, from the sums of each cluster.

    points: (keys, label, vector of `size` numbers). The mean squared distance of x to a cluster is |x|² - 2 x·mean + mean |y|², so a
    point meets the clusters of its key, never its points. Single points count 0; a key of one cluster has no silhouette (null).
    """
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    p = points.select(*keys, "label", F.col(vector).cast("array<double>").alias("v")).withColumn("q", square(F.col("v")))
    means = p.groupBy(*keys, "label").agg(F.count("*").alias("n"), F.avg("q").alias("mq"), F.array(*(F.avg(F.col("v")[k]) for k in range(size))).alias("m"))
    to = means.withColumnRenamed("label", "other")
    dot = F.aggregate(F.zip_with("v", "m", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    each = p.withColumn("_id", F.monotonically_increasing_id()).join(to, keys).select(*keys, "_id", "label", "other", "n", (F.col("q") - 2 * dot + F.col("mq")).alias("d"))
    own = F.col("label") == F.col("other")
    ab = each.groupBy(*keys, "_id").agg(F.max(F.when(own, F.col("d") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12)))
    return ab.groupBy(*keys).agg(F.avg(s).alias("silhouette"))


def scatter(distance_free: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Weighted scatter between clusters and within them of points (rows)."""
    w = np.ones(len(labels)) if weights is None else weights.astype(float)
    centre = w @ distance_free / w.sum()
    between = within = 0.0
    for k in np.unique(labels):
        mine = labels == k
        mean = w[mine] @ distance_free[mine] / w[mine].sum()
        between += w[mine].sum() * ((mean - centre) ** 2).sum()
        within += float(w[mine] @ ((distance_free[mine] - mean) ** 2).sum(axis=1))
    return between, within


def calinski_harabasz(points: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """CLU-2: scatter between clusters against scatter within, each by its degrees of freedom; -1 where it isn't defined."""
    n, k = (len(labels) if weights is None else weights.sum()), len(np.unique(labels))
    if k < 2 or k >= n:
        return -1.0
    between, within = scatter(points, labels, weights)
    return 1.0 if within == 0 else float(between / within * (n - k) / (k - 1))


def davies_bouldin(points: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """CLU-2: mean over clusters of the worst ratio of spreads to distance of centres (smaller is better); infinite where it isn't defined."""
    ks = np.unique(labels)
    w = np.ones(len(labels)) if weights is None else weights.astype(float)
    if len(ks) < 2:
        return float("inf")
    means = np.stack([w[labels == k] @ points[labels == k] / w[labels == k].sum() for k in ks])
    spread = np.array([w[labels == k] @ np.linalg.norm(points[labels == k] - m, axis=1) / w[labels == k].sum() for k, m in zip(ks, means, strict=True)])
    apart = np.linalg.norm(means[:, None] - means[None], axis=2)
    np.fill_diagonal(apart, np.inf)
    ratio = np.where(apart > 0, (spread[:, None] + spread[None]) / np.maximum(apart, 1e-300), 0.0)
    np.fill_diagonal(ratio, 0)
    return float(ratio.max(axis=1).mean())


def gap_statistic(points: np.ndarray, labels: np.ndarray, cluster, draws: int = 10, seed: int = 42) -> float:
    """CLU-2: mean log scatter of uniform points clustered alike (cluster(points, k) gives labels), less the log scatter of these."""
    k = len(np.unique(labels))
    rng = np.random.default_rng(seed)
    low, high = points.min(axis=0), points.max(axis=0)
    logs = []
    for _ in range(draws):
        made = low + rng.random(points.shape) * (high - low)
        logs.append(np.log(max(scatter(made, cluster(made, k))[1], 1e-12)))
    return float(np.mean(logs) - np.log(max(scatter(points, labels)[1], 1e-12)))
