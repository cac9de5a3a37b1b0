"""Problems 1 to 4 against brute force on small inputs."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlake.llm import contact_modes as cm
from chainlake.llm import cooccurrence as co
from chainlake.llm import topn
from chainlake.llm.components import connected_groups
from chainlake.storage import Scratch


def _union(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


# --- problem 3 ---


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(200)]  # a long chain
    links += [("hub", f"s{k:03d}") for k in range(150)]  # a star
    links += [(f"r{rng.randrange(300):03d}", f"r{rng.randrange(300):03d}") for _ in range(200)]
    links += [("alone", "alone")] + links[:20] + [(b, a) for a, b in links[:20]]
    rows = [(a, b, 1) for a, b in links] + [(None, "x", 1), ("y", None, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "l string, r string, vertex int")  # a clashing extra column
    got = connected_groups(df, "l", "r").collect()
    assert {r.vertex: r.group_id for r in got} == _union(links) and len(got) == len(_union(links))


@pytest.mark.parametrize("rows", [[], [("a", "a")], [(None, "b")]])
def test_components_of_nearly_nothing(spark, rows):
    got = connected_groups(spark.createDataFrame(rows, "l string, r string"), "l", "r").collect()
    assert [(r.vertex, r.group_id) for r in got] == [(a, b) for a, b in rows if a]


# --- problem 1 ---

RECORD = "matrix_id bigint, protein1 string, protein2 string, is_contact array<array<boolean>>, pae array<array<float>>, distance array<array<float>>, record int"


def _record(i, a, b, cells, n=12, m=12, how="mask"):
    mask = np.zeros((n, m), dtype=bool)
    for r, c in cells:
        mask[r, c] = True
    near = np.where(mask, 1.0, 7.5).tolist()  # 7.5 is no contact
    if how == "mask":
        return (i, a, b, mask.tolist(), None, near, 0)
    return (i, a, b, None, near, np.where(mask, 7.9, 8.0).tolist(), 0)


def _modes(rng, n_pairs, n_modes, n_records):
    rows, i = [], 0
    for p in range(n_pairs):
        bases = [rng.sample([(r, c) for r in range(12) for c in range(12)], 14) for _ in range(n_modes)]
        for _ in range(n_records):
            i += 1
            cells = rng.choice(bases)[:]
            cells = rng.sample(cells, 13)
            if rng.random() < 0.5:
                rows.append(_record(i, f" a{p} ", f"B{p}", cells, how=rng.choice(["mask", "values"])))
            else:
                rows.append(_record(i, f"b{p}", f"A{p}\t", [(c, r) for r, c in cells], how=rng.choice(["mask", "values"])))
        i += 1
        rows.append(_record(i, f"A{p}", f"B{p}", [(k, k) for k in range(12)]))  # a one-off
    return rows


def _brute(rows):
    by = defaultdict(list)
    for r in rows:
        a, b = (x.strip().upper() if x else None for x in r[1:3])
        if not a or not b or (r[3] is None and r[4] is None):
            continue
        mask = np.array(r[3]) if r[3] is not None else (np.array(r[4]) < 7.5) & (np.array(r[5]) < 8.0)
        cells = {(int(i), int(j)) if a <= b else (int(j), int(i)) for i, j in zip(*np.nonzero(mask), strict=True)}
        if len(cells) >= 5:
            by[tuple(sorted((a, b)))].append((r[0], cells))
    links, every = [], []
    for sets in by.values():
        every += [(i, i) for i, _ in sets]
        links += [(i, j) for (i, x), (j, y) in itertools.combinations(sets, 2) if 2 * len(x & y) >= len(x | y)]
    groups = _union(every + links)
    n = Counter(groups.values())
    return {i: g for i, g in groups.items() if n[g] > 1}


@pytest.mark.parametrize("limit", [4000, 6])
def test_modes_equal_brute_force(spark, limit):
    """A limit of 6 sends every pair through the split across the cluster."""
    rows = _modes(random.Random(5), 3, 4, 40)
    rows += [_record(9001, None, "B0", [(k, k) for k in range(9)]), _record(9002, " ", "B0", [(k, k) for k in range(9)]), (9003, "A0", "B0", None, None, None, 0), _record(9004, "A0", "B0", [(0, 0)])]
    got = cm.recurring(cm.contact_modes(spark.createDataFrame(rows, RECORD), node_limit=limit)).collect()
    assert {r.matrix_id: r.cluster_id for r in got} == _brute(rows)


def test_modes_of_repeats_and_nothing(spark):
    same = [_record(k, "A", "B", [(x, x) for x in range(6)]) for k in range(1, 8)]
    members = cm.contact_modes(spark.createDataFrame(same, RECORD), node_limit=3)
    assert {(r.record, r.cluster_id) for r in members.collect()} == {(k, 1) for k in range(1, 8)}
    row = cm.describe_clusters(members).collect()
    assert len(row) == 1 and row[0].n_records == 7 and row[0].typical == "1,2,3"
    assert cm.contact_modes(spark.createDataFrame([], RECORD)).count() == 0


def test_matrices_of_unequal_shape_tell_nothing(spark):
    bad = (1, "A", "B", None, [[1.0] * 6], [[1.0] * 5], 0)
    good = (2, "A", "B", None, [[1.0] * 6], [[1.0] * 6], 0)
    nulls = (3, "A", "B", [[True] * 6, None, [None, True]], None, None, 0)
    got = cm.contact_sets(spark.createDataFrame([bad, good, nulls], RECORD)).collect()
    assert {r.record: len(r.cells) for r in got} == {2: 6, 3: 7}


# --- problem 2 ---


def _pair_counts(baskets):
    n = Counter()
    for b in baskets:
        n.update(itertools.combinations(sorted(set(b)), 2))
    return n


@pytest.mark.parametrize("wide", [512, 3])
def test_pairs_equal_brute_force(spark, wide):
    """With 3 as the limit, larger baskets go through the join of their rows."""
    rng = random.Random(7)
    baskets = [rng.sample("ABCDEFGHIJ", rng.randrange(1, 7)) for _ in range(150)] + [["A", "B", "C"]] * 70
    rows = [(k, x, "clash") for k, b in enumerate(baskets) for x in b] + [(None, "A", ""), (5, None, "")]
    items = spark.createDataFrame(rows, "basket int, item string, n_ab string").dropDuplicates(["basket", "item"])
    got = co.item_pairs(items, len(baskets), min_count=8, wide=wide).collect()
    alone = Counter(x for b in baskets for x in set(b))
    want = {k: n for k, n in _pair_counts(baskets).items() if n >= 8}
    assert {(r.item_a, r.item_b): r.n_ab for r in got} == want
    for r in got:
        assert (r.n_a, r.n_b, r.n) == (alone[r.item_a], alone[r.item_b], len(baskets))
        assert abs(r.lift - r.n_ab * r.n / (r.n_a * r.n_b)) < 1e-9


def test_infinite_conviction_and_empty(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "basket int, item string")
    r = co.item_pairs(items, 4).first()
    assert r.conviction == float("inf")
    assert co.item_pairs(items.where("false"), 0).count() == 0


def test_supported_predictions(spark):
    schema = "pred_id bigint, proteins_in_model array<string>, cluster string"
    rows = [(1, ["a", " B"], "✔"), (1, ["A", "b\t", "C"], "x"), (2, ["A", "B"], "X"), (3, None, "✔✔"), (4, [None, " ", "A", "a"], "✔"), (None, ["A", "B"], "✔"), (1, ["a", " B"], "✔")]
    got = co.supported_pairs(spark.createDataFrame(rows, schema), min_count=1).collect()
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == {("A", "B"): (1, 2, 1, 3), ("A", "C"): (1, 2, 1, 3), ("B", "C"): (1, 1, 1, 3)}
    assert co.supported_pairs(spark.createDataFrame([], schema)).count() == 0


# --- problem 4 ---


@pytest.mark.parametrize("block", [1 << 20, 512])
def test_top_n_equals_brute_force(spark, block):
    rng = random.Random(11)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "c"]), rng.randrange(60) / 10, rng.choice([None, 1, 2]), k, "clash") for k in range(4000)]
    rows += [("few", 1.0, 1, 9001, ""), (None, 9.0, 1, 9002, ""), ("a", None, 1, 9003, ""), ("a", float("nan"), 1, 9004, "")]
    df = spark.createDataFrame(rows, "g string, s double, t int, i bigint, position string")
    got = topn.top_n(df, ["g"], "s", ["t", "i"], 5, block_bytes=block).collect()
    want = set()
    for g in ("hot", "a", "b", "c", "few"):
        mine = [r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]]
        want |= {(r[0], r[3]) for r in sorted(mine, key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3]))[:5]}
    assert {(r.g, r.i) for r in got} == want and len(got) == len(want)


def test_row_groups_are_skipped(spark):
    """Of a group in many row groups, statistics leave only the best ones."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") / 7).alias("s"), F.col("id").alias("i"))
    scratch = Scratch(spark, "skip")
    files = topn.write_clustered(df, ["g"], "s", ["i"], scratch, "t", block_bytes=4096)
    stats = topn.row_group_statistics(files, ["g"], "s", df).collect()
    floor = max(r.least for r in stats if r.n_rows >= 3)
    assert len(stats) > 10 and sum(r.most >= floor for r in stats) <= 2
    assert {r.i for r in topn.top_n(df, ["g"], "s", ["i"], 3).collect()} == {19_999, 19_998, 19_997}


def test_best_models(spark):
    schema = "row_id bigint, pred_id bigint, protein1 string, protein2 string, rank int, iptm double"
    rows = [
        (1, 1, "b", "A", 1, 0.5), (2, 1, "A", "B ", 1, 0.9), (3, 1, "A", "B", 2, 0.5), (4, 2, "A", "B", 1, 0.5), (5, 2, "A", "B", 2, None), (6, 3, None, "B", 1, 0.9), (7, 3, " ", "B", 1, 0.9),
        (8, 4, "C", "c", 1, 0.1), (9, 4, "C", "C", 2, float("nan")),
    ]
    got = topn.best_models(spark.createDataFrame(rows, schema), n=2).collect()
    assert {(r.protein_a, r.protein_b, r.row_id) for r in got} == {("A", "B", 1), ("A", "B", 4), ("C", "C", 8)}
    assert topn.best_models(spark.createDataFrame([], schema)).count() == 0
