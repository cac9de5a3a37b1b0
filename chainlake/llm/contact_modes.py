"""Problem 1: grouping records into similarity clusters by bisecting k-means.

A record is a set of cells (the contacts of two chains); two records are alike when the cells that
both have are at least a given share of those that either has. Nodes of the tree are split by 2-means,
largest dispersion first, until all records of a leaf are alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chainlake.functions.ids import pair_high, pair_low, protein_id
from chainlake.storage import Scratch

_SET_SCHEMA = "record bigint, a string, b string, cells array<bigint>"
_LEAF_SCHEMA = "a string, b string, path string, rep bigint, leaf bigint, centre_distance double"
COLUMN_BITS = 32
LLOYD = 3  #: rounds of 2-means of a split
BLOCK = 2000  #: sets that are compared with as many others in one task


def _lengths(col: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts of each record's rows, starts of each row's values, and the values of a column of matrices."""
    rows = col.flatten()
    return np.concatenate([[0], np.cumsum(_lengths(col))]), np.concatenate([[0], np.cumsum(_lengths(rows))]), rows.flatten()


def _true_cells(col: pa.Array, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, row and column of each true value."""
    outer, inner, _ = _flat(col)
    at = np.flatnonzero(truth)
    row = np.searchsorted(inner, at, side="right") - 1
    record = np.searchsorted(outer, row, side="right") - 1
    return record, row - outer[record], at - inner[row]


def _below(values: pa.Array, cutoff: float) -> np.ndarray:
    return np.nan_to_num(pc.fill_null(values, np.inf).to_numpy(zero_copy_only=False), nan=np.inf) < cutoff


def contact_sets(records: DataFrame, pae_cutoff: float = 7.5, distance_cutoff: float = 8.0, min_contacts: int = 5) -> DataFrame:
    """(record, a, b, cells): the sorted contact cells of each record, turned so that the smaller ID has the rows.

    is_contact is taken where given; else a cell is a contact when pae and distance are both below their
    cutoffs (null and NaN are not). Records without two IDs, without enough contacts, or with matrices
    that cannot tell the contacts have no row.
    """
    wanted = records.select(
        F.col("matrix_id").alias("record"),
        protein_id("protein1").alias("p"),
        protein_id("protein2").alias("q"),
        "is_contact",
        *(F.when(F.col("is_contact").isNull(), F.col(c)).alias(c) for c in ("pae", "distance")),
    ).where("record IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL AND (is_contact IS NOT NULL OR (pae IS NOT NULL AND distance IS NOT NULL))")
    wanted = wanted.select(
        "record", pair_low(F.col("p"), F.col("q")).alias("a"), pair_high(F.col("p"), F.col("q")).alias("b"), (F.col("p") > F.col("q")).alias("turn"), "is_contact", "pae", "distance"
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            turn = get("turn").to_numpy(zero_copy_only=False).astype(bool)
            given = get("is_contact")
            parts = [_true_cells(given, pc.fill_null(_flat(given)[2], False).to_numpy(zero_copy_only=False).astype(bool))]
            pae, distance = get("pae"), get("distance")
            shape_p, shape_d = _flat(pae), _flat(distance)
            if np.array_equal(shape_p[0], shape_d[0]) and np.array_equal(shape_p[1], shape_d[1]):
                parts.append(_true_cells(pae, _below(shape_p[2], pae_cutoff) & _below(shape_d[2], distance_cutoff)))
            else:  # some matrix has other dimensions than its partner: those records tell nothing
                for k in range(batch.num_rows):
                    p, d = pae.slice(k, 1), distance.slice(k, 1)
                    sp, sd = _flat(p), _flat(d)
                    if np.array_equal(sp[0], sd[0]) and np.array_equal(sp[1], sd[1]):
                        r, i, j = _true_cells(p, _below(sp[2], pae_cutoff) & _below(sd[2], distance_cutoff))
                        parts.append((r + k, i, j))
            record, i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
            low, high = np.where(turn[record], j, i), np.where(turn[record], i, j)
            code = (low.astype(np.int64) << COLUMN_BITS) | high.astype(np.int64)
            order = np.lexsort((code, record))
            record, code = record[order], code[order]
            n = np.bincount(record, minlength=batch.num_rows)
            keep = np.flatnonzero(n >= min_contacts)
            if not len(keep):
                continue
            code = code[(n >= min_contacts)[record]]
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[keep])]), pa.int32()), pa.array(code))
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([get("record").take(at), get("a").take(at), get("b").take(at), cells], names=["record", "a", "b", "cells"])

    return wanted.mapInArrow(extract, _SET_SCHEMA)


def bisect(sizes: np.ndarray, common: np.ndarray, weights: np.ndarray, alike: float, lloyd: int = LLOYD, join: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Leaf number and distance to the leaf's centre of each set, by bisecting k-means on common counts.

    common[i, j] is the number of cells that sets i and j share, so squared distances to a centre, and
    with them 2-means and the dispersions, need no coordinates. The node of the largest dispersion is
    split first; a node ends as a leaf when all its sets are alike. The seeds of a split are the set
    farthest from the centre and the one least alike to it, or, where these two are alike, the least alike
    pair of all. Sums are of whole numbers, so the same node splits the same way on the cluster
    (_split_large). Leaves whose union still meets the limit are joined again, for a split may part what belongs together.
    """
    n = len(sizes)
    size, w = sizes.astype(np.float64), weights.astype(np.float64)
    small = sizes.astype(np.float32)
    share = common / np.maximum(small[:, None] + small[None, :] - common, 1)  # single precision: half the memory, exact enough for shares of whole numbers

    def to_centre(members: np.ndarray, points: np.ndarray) -> np.ndarray:
        mine = w[members]
        norm, total = mine @ (common[np.ix_(members, members)] @ mine), mine.sum()
        return size[points] - 2 * (common[np.ix_(points, members)] @ mine) / total + norm / (total * total)

    def shares(x: int, points: np.ndarray) -> np.ndarray:
        both = common[x, points].astype(np.float64)
        return both / (size[x] + size[points] - both)

    leaves: list[np.ndarray] = []
    every = np.arange(n)
    heap: list[tuple[float, int, np.ndarray, np.ndarray]] = [(0.0, 0, every, to_centre(every, every))]
    count = 1
    while heap:
        _, _, node, far = heapq.heappop(heap)
        s = int(far.argmax())
        to_s = shares(node[s], node)
        t = int(to_s.argmin())
        if to_s[t] >= alike:
            within = share[np.ix_(node, node)]
            worst = int(within.argmin())
            if within.flat[worst] >= alike:
                leaves.append(node)
                continue
            s, t = divmod(worst, len(node))
            to_s = shares(node[s], node)
        side = shares(node[t], node) > to_s
        side[s], side[t] = False, True
        for _ in range(lloyd):
            moved = to_centre(node[side], node) < to_centre(node[~side], node)
            if moved.all() or not moved.any() or np.array_equal(moved, side):
                break
            side = moved
        for part in (node[side], node[~side]):
            far = to_centre(part, part)
            heapq.heappush(heap, (-float(w[part] @ far), count, part, far))
            count += 1
    leaves.sort(key=lambda x: x[0])
    if join and len(leaves) > 1:
        leaves = _joined(leaves, size, common, share, alike, to_centre)
    label, far = np.empty(n, dtype=np.int64), np.empty(n)
    for k, leaf in enumerate(leaves):
        label[leaf], far[leaf] = k, np.maximum(to_centre(leaf, leaf), 0)
    return label, far


def _joined(leaves: list[np.ndarray], size: np.ndarray, common: np.ndarray, share: np.ndarray, alike: float, to_centre) -> list[np.ndarray]:
    """Leaves joined while all sets of the union are alike, those with the most alike heads (sets nearest to the centre) first."""
    heads = np.array([x[int(to_centre(x, x).argmin())] for x in leaves])
    both = common[np.ix_(heads, heads)].astype(np.float64)
    near = both / (size[heads][:, None] + size[heads][None, :] - both)
    links = [(near[i, j], i, j) for i, j in zip(*np.nonzero(np.triu(near >= alike, 1)), strict=True) if share[np.ix_(leaves[i], leaves[j])].min() >= alike]
    groups = complete_groups(links)
    done = {k for g in groups for k in g}
    out = [np.sort(np.concatenate([leaves[k] for k in g])) for g in groups] + [x for k, x in enumerate(leaves) if k not in done]
    return sorted(out, key=lambda x: x[0])


def complete_groups(links: list[tuple[float, int, int]]) -> list[list[int]]:
    """Groups of two or more in which every two are linked; the links of the largest share join first, ties by the smaller numbers."""
    group: dict[int, set[int]] = {x: {x} for _, i, j in links for x in (i, j)}
    linked = {(min(i, j), max(i, j)) for _, i, j in links}
    for _, i, j in sorted(links, key=lambda r: (-r[0], r[1], r[2])):
        x, y = group[i], group[j]
        if x is not y and all((min(p, q), max(p, q)) in linked for p in x for q in y):
            x |= y
            group.update(dict.fromkeys(y, x))
    return [sorted(g) for g in {id(g): g for g in group.values()}.values() if len(g) > 1]


def common_counts(sets: list[np.ndarray], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and how many cells each two sets share; the cells go by in blocks, so memory is bounded by the node."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    cells, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, len(cells), block):
        inside = (column >= start) & (column < start + block)
        dense = np.zeros((len(sets), min(block, len(cells) - start)), dtype=np.float32)
        dense[row[inside], column[inside] - start] = 1
        common += dense @ dense.T
    return sizes, common


def _leaves(alike: float):
    """mapInArrow over rows sorted by node: finishes the tree of each node in memory."""

    def solve(node: tuple, reps: np.ndarray, weights: np.ndarray, cells: list[np.ndarray]) -> pa.RecordBatch:
        if len(reps) == 1:
            leaf, far = reps, np.zeros(1)
        else:
            sizes, common = common_counts(cells)
            label, far = bisect(sizes, common, weights, alike, join=node[2] == "")  # parted pairs are joined when all their leaves are known
            first = np.full(label.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, label, reps)
            leaf = first[label]
        n = len(reps)
        return pa.RecordBatch.from_arrays(
            [pa.array([x] * n, pa.string()) for x in node] + [pa.array(reps, pa.int64()), pa.array(leaf, pa.int64()), pa.array(far, pa.float64())],
            names=["a", "b", "path", "rep", "leaf", "centre_distance"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, done = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(k).to_pylist() for k in range(3)]
            reps, weights = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            flat, ends = batch.column(5).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(_lengths(batch.column(5)))])
            keys = list(zip(*names, strict=True))
            start = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[start]:
                    continue
                if held is not None and held != keys[start]:
                    done.append(_join(solve, held, parts))
                    parts = []
                held = keys[start]
                parts.append((reps[start:k], weights[start:k], [flat[ends[x] : ends[x + 1]] for x in range(start, k)]))
                start = k
            if len(done) >= 256:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if held is not None:
            done.append(_join(solve, held, parts))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return run


def _join(solve, node: tuple, parts: list) -> pa.RecordBatch:
    reps = np.concatenate([p[0] for p in parts])
    order = np.argsort(reps)
    cells = [c for p in parts for c in p[2]]
    return solve(node, reps[order], np.concatenate([p[1] for p in parts])[order], [cells[k] for k in order])


def _farness(cells: DataFrame, key: list[str]) -> DataFrame:
    """(key, rep, far): squared distance of each set to its node's centre, from whole numbers: size - 2 dot / w + norm / w²; cells: (key, rep, weight, cell)."""
    centre = cells.groupBy(*key, "cell").agg(F.sum("weight").alias("s"))
    whole = cells.select(*key, "rep", "weight").distinct().groupBy(*key).agg(F.sum("weight").cast("double").alias("w"))
    norm = centre.groupBy(*key).agg(F.sum(F.col("s") * F.col("s")).cast("double").alias("norm")).join(whole, key)
    dots = cells.join(centre.hint("shuffle_hash"), [*key, "cell"]).groupBy(*key, "rep").agg(F.count("*").cast("double").alias("size"), F.sum("s").cast("double").alias("dot"))
    return dots.join(norm, key).select(*key, "rep", (F.col("size") - 2 * F.col("dot") / F.col("w") + F.col("norm") / (F.col("w") * F.col("w"))).alias("far"))


def _share(one: str, two: str) -> Column:
    """Share of common cells of two sorted arrays without repeats."""
    n = F.size(F.array_intersect(one, two)).cast("double")
    return n / (F.size(one) + F.size(two) - n)


def _least_share(rows: pd.DataFrame) -> tuple[float, int, int]:
    """Smallest share of a set of side 1 with one of side 2, and their reps (the smallest of equal ones, ordered)."""
    one, two = (rows.loc[rows["side"] == s, ["rep", "cells"]].sort_values("rep") for s in (1, 2))
    parts = [one["cells"].to_list(), two["cells"].to_list()]
    sizes = [np.array([len(x) for x in part]) for part in parts]
    cells = np.unique(np.concatenate(parts[0] + parts[1]))
    common = np.zeros((len(sizes[0]), len(sizes[1])), dtype=np.float32)
    for start in range(0, len(cells), 4096):
        dense = []
        for part, size in zip(parts, sizes, strict=True):
            column = np.searchsorted(cells, np.concatenate(part)) - start
            inside = (column >= 0) & (column < 4096)
            d = np.zeros((len(part), min(4096, len(cells) - start)), dtype=np.float32)
            d[np.repeat(np.arange(len(part)), size)[inside], column[inside]] = 1
            dense.append(d)
        common += dense[0] @ dense[1].T
    share = common / (sizes[0][:, None] + sizes[1][None, :] - common).astype(np.float32)
    least = share.min()
    i, j = np.nonzero(share == least)
    x, y = one["rep"].to_numpy()[i], two["rep"].to_numpy()[j]
    return float(least), *min(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))


def _blocks_apart(sets: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """(key, least, x, y): the least alike two sets of each listed two groups, compared in blocks of about BLOCK by BLOCK sets.

    listed: (key, one, two) names two groups (which may be the same one); sets: (grp, n, rep, cells). No task holds more than two blocks.
    """
    chunks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    cut = sets.withColumn("at", F.pmod(F.xxhash64("rep"), chunks("n")).cast("int"))
    sizes = sets.select("grp", "n").distinct()
    named = listed.join(sizes.withColumnsRenamed({"grp": "one", "n": "n1"}), "one").join(sizes.withColumnsRenamed({"grp": "two", "n": "n2"}), "two")
    same = F.col("one") == F.col("two")
    left = named.join(cut.drop("n").withColumnRenamed("grp", "one"), "one").select(*key, "one", "two", F.lit(1).alias("side"), "rep", "cells", F.col("at").alias("i"), F.explode(F.sequence(F.when(same, F.col("at")).otherwise(F.lit(0)), chunks("n2") - 1)).alias("j"))
    right = named.join(cut.drop("n").withColumnRenamed("grp", "two"), "two").select(*key, "one", "two", F.lit(2).alias("side"), "rep", "cells", F.explode(F.sequence(F.lit(0), F.when(same, F.col("at")).otherwise(chunks("n1") - 1))).alias("i"), F.col("at").alias("j"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["side"].nunique() < 2:
            return rows.iloc[:0].assign(least=0.0, x=0, y=0)[[*key, "least", "x", "y"]]
        least, x, y = _least_share(rows)
        return rows.iloc[:1].assign(least=least, x=x, y=y)[[*key, "least", "x", "y"]]

    types = dict(listed.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", least double, x bigint, y bigint"
    parts = left.unionByName(right).groupBy(*key, "i", "j").applyInPandas(solve, schema)
    return parts.groupBy(*key).agg(F.min(F.struct("least", "x", "y")).alias("m")).select(*key, "m.least", "m.x", "m.y")


def _split_large(mine: DataFrame, alike: float, scratch: Scratch, tag: str, lloyd: int = LLOYD) -> DataFrame:
    """One step of bisect() for every node in mine, spread over the cluster: (node, rep, side), side null where all sets of the node are alike.

    mine: (node, n, rep, weight, cells). The same seeds, distances and rounds as in memory, of the same whole numbers, so
    the halves do not depend on where a node is split. Centres are rows (node, cell), so no node meets in one
    task. Only where the seeds are alike are all sets compared, in blocks. Each step is written, which keeps the plans small.
    """
    cells = mine.select("node", "rep", "weight", F.explode("cells").alias("cell"))
    far = _farness(cells, ["node"])
    first = scratch.save(far.groupBy("node").agg(F.min_by("rep", F.struct((-F.col("far")).alias("f"), "rep")).alias("s")), f"{tag}-first")

    def cells_of(seeds: DataFrame, name: str) -> DataFrame:
        return seeds.join(mine.select("node", F.col("rep").alias(name), F.col("cells").alias(f"{name}_cells")), ["node", name])

    to_s = mine.join(cells_of(first, "s"), "node").select("node", "rep", "s", _share("cells", "s_cells").alias("share"))
    seeds = to_s.groupBy("node", "s").agg(F.min(F.struct("share", "rep")).alias("m"))
    seeds = scratch.save(seeds.select("node", "s", F.col("m.rep").alias("t"), F.col("m.share").alias("share")), f"{tag}-seeds")
    close = seeds.where(F.col("share") >= alike).select("node")
    if not close.isEmpty():
        sets = mine.join(close, "node", "left_semi").select(F.col("node").alias("grp"), "n", "rep", "cells")
        worst = _blocks_apart(sets, close.select("node", F.col("node").alias("one"), F.col("node").alias("two")), ["node"])
        far_apart = worst.where(F.col("least") < alike).select("node", F.col("x").alias("s"), F.col("y").alias("t"))
        seeds = scratch.save(seeds.where(F.col("share") < alike).select("node", "s", "t").unionByName(far_apart), f"{tag}-seeds2")
    both = mine.join(cells_of(cells_of(seeds.select("node", "s", "t"), "s"), "t"), "node")
    nearer = F.when(F.col("rep") == F.col("s"), 0).when(F.col("rep") == F.col("t"), 1).otherwise((_share("cells", "t_cells") > _share("cells", "s_cells")).cast("int"))
    side = scratch.save(both.select("node", "rep", "weight", nearer.alias("side")), f"{tag}-side0")
    for k in range(lloyd):
        half = [F.when(F.col("side") == x, F.col("weight")) for x in (0, 1)]
        total = side.groupBy("node").agg(*(F.sum(h).cast("double").alias(f"w{x}") for x, h in enumerate(half)))
        sums = cells.select("node", "rep", "cell").join(side.hint("shuffle_hash"), ["node", "rep"]).groupBy("node", "cell").agg(*(F.coalesce(F.sum(h), F.lit(0)).alias(f"s{x}") for x, h in enumerate(half)))
        sums = scratch.save(sums, f"{tag}-sums{k}")
        norm = sums.groupBy("node").agg(*(F.sum(F.col(f"s{x}") * F.col(f"s{x}")).cast("double").alias(f"q{x}") for x in (0, 1))).join(total, "node")
        dots = cells.join(sums.hint("shuffle_hash"), ["node", "cell"]).groupBy("node", "rep").agg(F.count("*").cast("double").alias("size"), *(F.sum(f"s{x}").cast("double").alias(f"d{x}") for x in (0, 1)))
        far0, far1 = (F.col("size") - 2 * F.col(f"d{x}") / F.col(f"w{x}") + F.col(f"q{x}") / (F.col(f"w{x}") * F.col(f"w{x}")) for x in (0, 1))
        moved = scratch.save(dots.join(norm, "node").select("node", "rep", (far1 < far0).cast("int").alias("moved")), f"{tag}-moved{k}")
        real = moved.groupBy("node").agg((F.min("moved") < F.max("moved")).alias("real"))  # a round that would empty a half changes nothing
        new = side.join(moved.hint("shuffle_hash"), ["node", "rep"]).join(real, "node")
        side = scratch.save(new.select("node", "rep", "weight", F.when(F.col("real"), F.col("moved")).otherwise(F.col("side")).alias("side")), f"{tag}-side{k + 1}")
    return mine.select("node", "rep").join(side.select("node", "rep", "side").hint("shuffle_hash"), ["node", "rep"], "left")


def similarity_clusters(sets: DataFrame, alike: float = 0.5, node_limit: int = 4000, scratch: Scratch | None = None) -> DataFrame:
    """Members of the leaves of one bisecting k-means tree per pair.

    sets: (record, a, b, cells), cells sorted and without repeats. Equal sets of a pair enter once, with
    their number as weight. A node of more than node_limit different sets is split across the cluster, all
    such nodes at once; smaller ones are finished in one task each, whose memory node_limit bounds. Both ways take
    the same steps on the same whole numbers, so the clusters do not depend on node_limit. Leaves
    of a pair are joined when all sets of the union are alike; where the pair's nodes lie in several tasks, the
    candidates, leaves whose heads are alike, come from the cells that two alike sets cannot both lack (the rarest ones), so none is missed.
    Tables that grow with the data are joined by shuffle, never broadcast.

    Returns (record, a, b, cluster_id, centre_distance): every record of sets once; cluster_id is the
    smallest record of the cluster. Empty input gives no rows; repeated rows are members of one cluster.
    """
    spark = sets.sparkSession
    scratch = scratch or Scratch(spark, "clusters")
    marked = sets.withColumns({"h1": F.xxhash64("cells"), "h2": F.xxhash64(F.lit(7), F.reverse("cells"))})
    marked = scratch.save(marked, "sets")
    different = marked.groupBy("a", "b", "h1", "h2").agg(F.min("record").alias("rep"), F.count("*").alias("weight"), F.first("cells").alias("cells"))
    nodes = scratch.save(different.select("a", "b", F.lit("").alias("path"), "rep", "weight", "cells", "h1", "h2"), "nodes0")
    key = ["a", "b", "path"]
    whole = nodes.select("a", "b", "h1", "h2", "rep")
    finished = []
    deepest = 0
    for k in range(1, 1000):
        large = scratch.save(nodes.groupBy(*key).agg(F.count("*").alias("n"), F.min("rep").alias("node")).where(F.col("n") > node_limit), f"large{k}")
        if large.isEmpty():
            break
        mine = scratch.save(nodes.join(large, key).select(*key, "node", "n", "rep", "weight", "cells"), f"mine{k}")
        side = scratch.save(_split_large(mine.drop(*key), alike, scratch, f"split{k}"), f"split{k}")
        parted = mine.join(side.hint("shuffle_hash"), ["node", "rep"])
        finished.append(scratch.save(parted.where("side IS NULL").select("a", "b", F.concat("path", F.lit("=")).alias("path"), "rep", "weight", "cells", F.col("node").alias("leaf")), f"finished{k}"))
        halves = parted.where("side IS NOT NULL").select("a", "b", F.concat("path", F.col("side").cast("string")).alias("path"), "rep", "weight", "cells")
        rest = nodes.select(*key, "rep", "weight", "cells").join(large, key, "left_anti")
        nodes = scratch.save(rest.unionByName(halves), f"nodes{k}")
        scratch.drop(f"mine{k}")
        if k > 1:
            scratch.drop(f"nodes{k - 1}")
        deepest = k
    else:
        raise RuntimeError("a node could not be split")
    # pandas groups of a few rows would cost more than their clustering: whole partitions go through one function
    grouped = nodes.select(*key, "rep", "weight", "cells").repartition(*key).sortWithinPartitions(*key)
    leaves = scratch.save(grouped.mapInArrow(_leaves(alike), _LEAF_SCHEMA), "leaves")
    named = leaves.select("rep", F.col("leaf").alias("cluster_id"), "centre_distance")
    if deepest:
        named = _join_parted(leaves, nodes, finished, alike, scratch)
    who = whole.join(named.hint("shuffle_hash"), "rep").select("a", "b", "h1", "h2", "cluster_id", "centre_distance")
    return marked.select("record", "a", "b", "h1", "h2").join(who.hint("shuffle_hash"), ["a", "b", "h1", "h2"]).select("record", "a", "b", "cluster_id", "centre_distance")


def _join_parted(leaves: DataFrame, nodes: DataFrame, finished: list[DataFrame], alike: float, scratch: Scratch) -> DataFrame:
    """(rep, cluster_id, centre_distance): joins the leaves of pairs whose nodes were parted, as _joined() does in memory."""
    parted = leaves.where("path <> ''").select("a", "b", "rep", "leaf", "centre_distance")
    member = leaves.where("path <> ''").select("a", "b", "rep", "leaf").join(nodes.select("rep", "weight", "cells").hint("shuffle_hash"), "rep").select("a", "b", "leaf", "rep", "weight", "cells")
    for f in finished:
        cells = f.select("leaf", "rep", "weight", F.explode("cells").alias("cell"))
        far = _farness(cells, ["leaf"])
        parted = parted.unionByName(f.select("a", "b", "rep", "leaf").join(far, ["leaf", "rep"]).select("a", "b", "rep", "leaf", F.greatest("far", F.lit(0.0)).alias("centre_distance")))
        member = member.unionByName(f.select("a", "b", "leaf", "rep", "weight", "cells"))
    parted, member = scratch.save(parted, "parted"), scratch.save(member, "members")
    heads = parted.groupBy("a", "b", "leaf").agg(F.min_by("rep", F.struct("centre_distance", "rep")).alias("rep"))
    heads = scratch.save(heads.join(member.select("rep", "cells").hint("shuffle_hash"), "rep"), "heads")
    each = heads.select("a", "b", "leaf", F.size("cells").alias("size"), F.explode("cells").alias("cell"))
    often = each.groupBy("a", "b", "cell").agg(F.count("*").alias("f"))
    ordered = each.join(often.hint("shuffle_hash"), ["a", "b", "cell"]).withColumn("k", F.row_number().over(Window.partitionBy("a", "b", "leaf").orderBy("f", "cell")))
    # sets that share at least alike of their union share one of their size - ceil(alike * size) + 1 rarest cells
    rare = ordered.where(F.col("k") <= F.col("size") - F.ceil(F.lit(alike) * F.col("size")) + 1).select("a", "b", "leaf", "size", "cell")
    other = rare.withColumnsRenamed({"leaf": "leaf2", "size": "size2"})
    near = rare.join(other.hint("shuffle_hash"), ["a", "b", "cell"]).where((F.col("leaf") < F.col("leaf2")) & (F.col("size") >= F.lit(alike) * F.col("size2")) & (F.col("size2") >= F.lit(alike) * F.col("size")))
    near = near.select("a", "b", "leaf", "leaf2").distinct()
    cells = heads.select("leaf", "cells")
    both = near.join(cells.hint("shuffle_hash"), "leaf").join(cells.withColumnsRenamed({"leaf": "leaf2", "cells": "cells2"}).hint("shuffle_hash"), "leaf2")
    links = scratch.save(both.withColumn("share", _share("cells", "cells2")).where(F.col("share") >= alike).select("a", "b", "leaf", "leaf2", "share"), "links")
    sized = member.join(member.groupBy("leaf").agg(F.count("*").alias("n")), "leaf").select(F.col("leaf").alias("grp"), "n", "rep", "cells")
    apart = _blocks_apart(sized, links.select("leaf", "leaf2", F.col("leaf").alias("one"), F.col("leaf2").alias("two")), ["leaf", "leaf2"])
    compact = apart.where(F.col("least") >= alike).select("leaf", "leaf2")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        groups = complete_groups(list(zip(rows["share"], rows["leaf"], rows["leaf2"], strict=True)))
        return pd.DataFrame([(leaf, min(g)) for g in groups for leaf in g], columns=["leaf", "group_id"])

    groups = links.join(compact, ["leaf", "leaf2"]).groupBy("a", "b").applyInPandas(join, "leaf bigint, group_id bigint")
    named = scratch.save(parted.join(groups.hint("shuffle_hash"), "leaf", "left").select("rep", "group_id", F.coalesce("group_id", "leaf").alias("cluster_id"), "centre_distance"), "named")
    changed = named.where("group_id IS NOT NULL").select("rep", "cluster_id").join(member.select("rep", "weight", "cells").hint("shuffle_hash"), "rep")
    far = _farness(changed.select("cluster_id", "rep", "weight", F.explode("cells").alias("cell")), ["cluster_id"])
    named = named.join(far.select("rep", "far").hint("shuffle_hash"), "rep", "left").select("rep", "cluster_id", F.greatest(F.coalesce("far", "centre_distance"), F.lit(0.0)).alias("centre_distance"))
    return leaves.where("path = ''").select("rep", F.col("leaf").alias("cluster_id"), "centre_distance").unionByName(named)


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """One row per cluster: size, and its records nearest to the centre (ties: smaller record first)."""
    key = ["a", "b", "cluster_id"]
    size = members.groupBy(*key).agg(F.count("*").alias("n_records"), F.avg("centre_distance").alias("mean_centre_distance"))
    near = members.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("centre_distance", "record"))).where(F.col("k") <= typical)
    tops = near.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "record"))), lambda x: x["record"]).alias("typical"))
    return size.join(tops, key).select("a", "b", "cluster_id", "n_records", "mean_centre_distance", F.array_join(F.col("typical").cast(T.ArrayType(T.StringType())), ",").alias("typical"))


def contact_modes(records: DataFrame, alike: float = 0.5, min_contacts: int = 5, node_limit: int = 4000) -> DataFrame:
    """Binding modes of every pair: similarity_clusters over contact_sets."""
    return similarity_clusters(contact_sets(records, min_contacts=min_contacts), alike, node_limit)


def recurring(members: DataFrame) -> DataFrame:
    """(matrix_id, cluster_id) of the records in clusters of two or more."""
    many = members.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n >= 2").select("cluster_id")
    return members.join(many, "cluster_id").select(F.col("record").alias("matrix_id"), "cluster_id")
