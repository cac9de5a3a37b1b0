"""Clusters joined across parted nodes are the same, with the same centres, as without a split."""

import numpy as np

from chainlake.llm import contact_modes as cm

SETS = "record bigint, a string, b string, cells array<bigint>"


def test_distances_do_not_depend_on_the_node_limit(spark):
    core = list(range(20))
    sets = [core[:k] + core[k + 1 :] for k in range(12)] + [core[:14]]  # alike all of them, the last one the outlier
    rows = [(i, "A", "B", s) for i, s in enumerate([*sets, *sets[:3]], 1)] + [(99, "A", "B", list(range(50, 60)))]
    df = spark.createDataFrame(rows, SETS)
    whole, parted = ({r.record: (r.cluster_id, round(r.centre_distance, 6)) for r in cm.similarity_clusters(df, node_limit=n).collect()} for n in (4000, 3))
    assert parted == whole
    dense = np.array([[c in s for c in core] for _, _, _, s in rows[:-1]], dtype=float)
    want = ((dense - dense.mean(axis=0)) ** 2).sum(axis=1)
    assert np.allclose([parted[k][1] for k in range(1, len(rows))], want, atol=1e-5)


def test_joined_leaves_keep_the_limit(spark):
    chain = [list(range(k, k + 12)) for k in range(0, 36, 2)]  # neighbours are alike, the ends are not
    df = spark.createDataFrame([(i, "A", "B", s) for i, s in enumerate(chain, 1)], SETS)
    clusters = {}
    for r in cm.similarity_clusters(df, node_limit=3).collect():
        clusters.setdefault(r.cluster_id, []).append(set(chain[r.record - 1]))
    assert sum(map(len, clusters.values())) == len(chain)
    assert all(2 * len(x & y) >= len(x | y) for c in clusters.values() for x in c for y in c)


def _overlapping(n, seed=8):
    """Sets of one pair that are not separated: windows on a ring with cells dropped, and a compact lot of many different sets."""
    rng = np.random.default_rng(seed)
    ring = [sorted({int((at + k) % 90) for k in range(14) if rng.random() < 0.8} | {int(at)}) for at in rng.integers(0, 90, n)]
    core = list(range(200, 240))
    lot = [core[:k] + core[k + 1 :] for k in range(30)]
    return ring + lot


def test_clusters_do_not_depend_on_the_node_limit(spark, monkeypatch):
    """Data without gaps: the same clusters and distances whether nodes are split in memory or across the cluster, with blocks of any size."""
    sets = _overlapping(150)
    df = spark.createDataFrame([(i, "A", "B", s) for i, s in enumerate([*sets, *sets[:20]], 1)], SETS)
    got = {}
    for limit, block in ((4000, 2000), (60, 2000), (12, 7)):
        monkeypatch.setattr(cm, "BLOCK", block)
        got[limit] = {r.record: (r.cluster_id, round(r.centre_distance, 6)) for r in cm.similarity_clusters(df, node_limit=limit).collect()}
    assert len(got[4000]) == 200
    assert got[60] == got[4000]
    assert got[12] == got[4000]
    assert len({c for c, _ in got[4000].values()}) > 5
    lot = {got[4000][k][0] for k in range(151, 181)}
    assert len(lot) == 1  # compact: not split although it has more sets than the limit
    members = {}
    for k, (c, _) in got[4000].items():
        members.setdefault(c, []).append(set((sets + sets[:20])[k - 1]))
    assert all(2 * len(x & y) >= len(x | y) for m in members.values() for x in m for y in m)
