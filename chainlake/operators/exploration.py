"""Layouts, assembly simulation, cluster refinement and feature vectors: numpy kernels that run per group or per task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions import geometry as geo


def principal_features(mask: np.ndarray, variance: float = 0.95, weights: np.ndarray | None = None) -> np.ndarray:
    """MAT-6: standardised features (columns that vary) reduced to the components that hold the variance. A row stands for weight equal ones."""
    x = mask.astype(float)
    w = np.ones(len(x)) if weights is None else weights.astype(float)
    mean = w @ x / w.sum()
    varies = x.min(axis=0) < x.max(axis=0)
    x = (x - mean)[:, varies]
    x = x / np.sqrt(w @ x**2 / w.sum())
    if not x.size:
        return np.zeros((len(mask), 1))
    root = np.sqrt(w)[:, None]
    u, s, _ = np.linalg.svd(root * x, full_matrices=False)
    share = np.cumsum(s**2) / max((s**2).sum(), 1e-12)
    k = int(np.searchsorted(share, variance) + 1)
    return u[:, :k] * s[:k] / root


def component_count(sets, weights: np.ndarray, variance: float = 0.95, block: int = 1024) -> int:
    """MAT-6: number of components that principal_features() of the sets' mask has, from the products of its columns (or of its rows, where these are fewer), added up block by block."""
    n, m, w = len(sets), len(sets.codes), weights.astype(float)
    if n <= min(m, 3000):
        return principal_features(sets.mask(), variance, weights).shape[1]
    products = np.zeros((m, m))
    for low in range(0, n, block):
        x = sets.mask(low, low + block).astype(float)
        products += x.T @ (x * w[low : low + block, None])
    mean = np.diag(products) / w.sum()  # a mask's square is itself
    varies = np.bincount(sets.at, minlength=m) < n
    if not varies.any():
        return 1
    spread = np.sqrt(mean * (1 - mean))[varies]
    values = np.linalg.eigvalsh((products / w.sum() - np.outer(mean, mean))[np.ix_(varies, varies)] / np.outer(spread, spread))[::-1]
    values = np.maximum(values, 0)[:n]
    return int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-12), variance) + 1)


def absorb_small(labels: np.ndarray, distance: np.ndarray, share: float = 0.2) -> np.ndarray:
    """CLU-5/JN-18: members of clusters smaller than a share of the largest join the cluster of their nearest large neighbour."""
    sizes = np.bincount(labels)
    large = np.isin(labels, np.flatnonzero(sizes >= share * sizes.max()))
    out = labels.copy()
    for i in np.flatnonzero(~large):
        out[i] = labels[np.flatnonzero(large)[distance[i, large].argmin()]]
    return np.unique(out, return_inverse=True)[1]


def fraction_refined(means: list[np.ndarray], threshold: float = 0.5) -> list[np.ndarray]:
    """CLU-5 (contact fraction): a smaller cluster whose contacts lie in a bigger one's by at least the threshold joins it."""
    means = sorted(means, key=lambda m: -(m > 0).sum())
    kept: list[np.ndarray] = []
    for m in means:
        on = m > 0
        home = next((k for k, big in enumerate(kept) if on.sum() and (on & (big > 0)).sum() / on.sum() >= threshold), None)
        if home is None:
            kept.append(m)
        else:
            kept[home] = (kept[home] + m) / 2
    return kept


def one_sided_closeness(a: np.ndarray, b: np.ndarray, how=np.median) -> float:
    """MAT-5: from each contact of the smaller set the Manhattan distance to the nearest of the larger; infinite if one is empty."""
    p, q = np.argwhere(a > 0), np.argwhere(b > 0)
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return float("inf")
    return float(how(np.abs(p[:, None] - q[None]).sum(axis=2).min(axis=1)))


def closeness_refined(means: list[np.ndarray], threshold: float = 10.0) -> list[np.ndarray]:
    """CLU-5 (closeness): joins the two closest clusters while their closeness is at most the threshold."""
    means = list(means)
    while len(means) > 1:
        d, i, j = min((one_sided_closeness(means[i], means[j]), i, j) for i in range(len(means)) for j in range(i + 1, len(means)))
        if d > threshold:
            break
        means[i] = (means[i] + means[j]) / 2
        means.pop(j)
    return means


def without_single_outliers(labels: np.ndarray, least: int = 10) -> np.ndarray:
    """CLU-5: members to keep: clusters of one are dropped where one of at least `least` exists."""
    sizes = np.bincount(labels)
    return sizes[labels] > 1 if sizes.max() >= least else np.ones(len(labels), dtype=bool)


def force_layout(n: int, links: list[tuple[int, int]], dims: int = 3, steps: int = 300, seed: int = 42) -> np.ndarray:
    """MAT-17/GRF-9: positions by repulsion between all, attraction along links and cohesion to the centre, with falling steps."""
    x = np.random.default_rng(seed).standard_normal((n, dims))
    a = np.array(links, dtype=int).reshape(-1, 2)
    for t in range(steps):
        gap = x[:, None] - x[None]
        d = np.maximum(np.linalg.norm(gap, axis=2), 1e-6)
        force = (gap / d[..., None] ** 3).sum(axis=1) - 0.05 * x
        if len(a):
            pull = x[a[:, 1]] - x[a[:, 0]]
            np.add.at(force, a[:, 0], 0.2 * pull)
            np.add.at(force, a[:, 1], -0.2 * pull)
        size = np.linalg.norm(force, axis=1, keepdims=True)
        x = x + force / np.maximum(size, 1) * 0.5 * (1 - t / steps)
    return x - x.mean(axis=0)


def assembly_paths(spark: SparkSession, edges: DataFrame, n_paths: int = 100, most_states: int = 100, stagnation: int = 5, seed: int = 42) -> DataFrame:
    """SIM-1: (path, step, combo, score) of simulated assemblies, one seeded random path each.

    edges: (a, b, weight). A path starts from a weighted random edge; each step adds the other end of an edge at a present protein, drawn by
    weight; the score is the mean weight of the edges among present proteins; a path ends when the score has not risen for `stagnation`
    steps. One task reads the edges in order, as numbers of 16 bytes an edge, and walks all paths; nothing is collected.
    """
    import pyarrow as pa

    rows = edges.select(F.col("a").cast("string"), F.col("b").cast("string"), F.col("weight").cast("double")).where("a IS NOT NULL AND b IS NOT NULL AND weight > 0")

    def simulate(batches):
        number: dict[str, int] = {}
        parts = []
        for batch in batches:
            ends = []
            for k in (0, 1):
                coded = batch.column(k).dictionary_encode()
                of = np.array([number.setdefault(x, len(number)) for x in coded.dictionary.to_pylist()], dtype=np.int32)
                ends.append(of[coded.indices.to_numpy(zero_copy_only=False)])
            parts.append((*ends, batch.column(2).to_numpy(zero_copy_only=False)))
        if not sum(len(w) for _, _, w in parts):
            return
        a, b, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        names, out = list(number), []
        start = weights / weights.sum()
        for path in range(n_paths):
            rng = np.random.default_rng([seed, path])
            k = rng.choice(len(weights), p=start)
            have, best, idle = [a[k], b[k]], -np.inf, 0
            present = np.zeros(len(names), dtype=bool)
            for step in range(most_states):
                present[have] = True
                one, two = present[a], present[b]
                inside = weights[one & two]
                score = float(np.mean(inside)) if len(inside) else 0.0
                out.append((path, step, sorted(names[x] for x in have), round(score, 6)))
                idle = 0 if score > best + 1e-12 else idle + 1
                best = max(best, score)
                open_ = np.flatnonzero(one | two)
                if idle >= stagnation or not len(open_):
                    break
                k = open_[rng.choice(len(open_), p=weights[open_] / weights[open_].sum())]
                have.append(b[k] if one[k] else a[k])
        columns = zip(("path", "step", "combo", "score"), zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.float64()), strict=True)
        yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, values, kind in columns})

    return rows.repartition(1).sortWithinPartitions("a", "b", "weight").mapInArrow(simulate, "path bigint, step int, combo array<string>, score double")


def reference_rmsd(atoms: DataFrame, keys: list[str], subject: list[str]) -> DataFrame:
    """MAT-11: RMSD of each part of each model to the most confident one of its subject, over the residues that both have.

    atoms: one row per atom used (keys name the model's part, subject what it is of; res_no, x, y, z, bfactor). Parts with fewer than
    three common residues have no row. The reference is one part per subject, so the join is many to one.
    """
    mean = atoms.groupBy(*keys, *subject).agg(F.avg("bfactor").alias("p"))
    best = mean.groupBy(*subject).agg(F.max_by(F.struct(*keys), F.struct(F.round("p", 9), *keys)).alias("best")).select(*subject, *(F.col(f"best.{k}").alias(k) for k in keys))
    ref = atoms.join(best, [*subject, *keys], "left_semi").select(*subject, "res_no", *(F.col(c).alias(f"{c}_r") for c in "xyz"))
    both = atoms.join(ref, [*subject, "res_no"])
    point = F.struct("res_no", *(F.col(c) for c in ("x", "y", "z", "x_r", "y_r", "z_r")))
    each = both.groupBy(*keys, *subject).agg(F.array_sort(F.collect_list(point)).alias("p"), F.avg("bfactor").alias("mean_plddt")).where(F.size("p") >= 3)
    flat = each.select(*keys, *subject, "mean_plddt", F.transform("p", lambda q: F.array(*(q[c] for c in ("x", "y", "z", "x_r", "y_r", "z_r")))).alias("p"))

    @F.pandas_udf("double")
    def rmsd(parts: pd.Series) -> pd.Series:
        stacked = [np.stack(p) for p in parts]
        return pd.Series([round(geo.superpose(p[:, :3], p[:, 3:])[2], 4) for p in stacked], dtype=float)

    return flat.select(*keys, *subject, F.round("mean_plddt", 6).alias("mean_plddt"), rmsd("p").alias("rmsd"))
