"""Operators as defined, against plain versions on small inputs: nulls, ties, hot keys and empty tables."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chainlake.operators import clusters as cl
from chainlake.operators import graph as g
from chainlake.operators import lattice as la
from chainlake.operators import series
from chainlake.operators import statistics as st
from chainlake.plans import catalog
from chainlake.sources import mmcif

MATRICES = "matrix_id bigint, protein1 string, protein2 string, proteins_in_model array<string>, pair_chains_tuple array<string>, rank int, length1 int, length2 int, is_contact array<array<boolean>>, pae array<array<float>>, min_plddt array<array<float>>, distance array<array<float>>"


def _events(n=400, seed=2):
    rng = random.Random(seed)
    return [(rng.choice([None, "a", "b", "b", "b", "b"]), rng.choice([1.0, 2.0, 2.0, None, rng.random()]), k, "clash") for k in range(n)]


def test_numbered_frames_and_totals(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "k string, v double, id int, ord0 string").repartition(5)
    plain = pd.DataFrame(rows, columns=["k", "v", "id", "x"]).sort_values(["k", "v", "id"], na_position="first")
    plain["ord"] = plain.groupby("k", dropna=False).cumcount() + 1
    got = {r.id: r.ord for r in series.numbered(df, ["k"], ["v", "id"]).collect()}
    assert got == dict(zip(plain["id"], plain["ord"], strict=True))
    named = df.where("k IS NOT NULL")
    plain = plain[plain["k"].notna()]
    means = plain.groupby("k")["v"].transform(lambda s: s.rolling(4, min_periods=1).mean())
    framed = series.framed(series.numbered(named, ["k"], ["v", "id"]), ["k"], "ord", 3, 0, {"m": F.avg("v"), "n": F.count("*")}, block=7)
    at = {r.id: (r.m, r.n) for r in framed.collect()}
    assert len(at) == len(plain)
    for i, o, m in zip(plain["id"], plain["ord"], means, strict=True):
        assert at[i][1] == min(4, o)
        assert (at[i][0] is None and np.isnan(m)) or np.isclose(at[i][0], m)
    whole = series.running_total(named.fillna(0.0, ["v"]), ["k"], ["id"], ["v"], block=6)
    want = plain.assign(v=plain["v"].fillna(0)).sort_values("id").groupby("k")["v"].cumsum()
    upto = {r.id: r.upto_v for r in whole.collect()}
    assert all(np.isclose(upto[plain["id"][i]], x) for i, x in want.items())
    median = {r.k: r.q for r in st.quantile(named, ["k"], "v", 0.25, "q").collect()}
    assert all(np.isclose(median[k], x) for k, x in plain.groupby("k")["v"].quantile(0.25).items())
    empty = df.where("false")
    assert series.numbered(empty, ["k"], ["v"]).count() == 0 and st.quantile(empty, ["k"], "v", 0.5, "q").count() == 0


def test_partner_bias_against_a_plain_series(spark):
    rng = random.Random(4)
    rows = [(p, k, sorted(rng.choice("PQRS") for _ in range(3)) + ["T"] * (k < 3)) for p in "PQ" for k in range(1, 31)]
    got = {(r.protein, r.partner, r.width): r for r in series.partner_bias(spark.createDataFrame(rows, "protein string, ord bigint, members array<string>"), "protein", "ord", "members").collect()}
    seen = set()
    for p, q, w in itertools.product("PQ", "PQRST", (5, 10, 15, 20)):
        x = np.array([m.count(q) > (p == q) for o, _, m in rows if o == p], dtype=float)
        if not x.any():
            continue
        f, half = x.mean(), w // 2
        r = np.array([x[i - half : i - half + w].mean() for i in range(half, len(x) - (w - 1 - half))])
        b = np.zeros(len(r)) if f in (0, 1) else np.where(r >= f, (r - f) / (1 - f if f < 1 else 1), (r - f) / f)
        y = got[p, q, w]
        assert np.allclose([y.max_bias, y.min_bias, y.mean_bias, y.share, y.n_places], [b.max(), b.min(), b.mean(), f, len(b)])
        assert y.peak == int(np.round(b, 9).argmax()) + half + 1
        seen.add((p, q, w))
    assert seen == set(got)


def test_least_cutoff_that_connects(spark):
    rng = random.Random(6)
    models, links = [], []
    for k in range(60):
        n = rng.randrange(1, 6)
        models.append((k, n))
        links += [(k, a, b, rng.choice([1.0, 2.0, 3.0, 4.0, None])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6] + [(k, 0, n + 2, 0.5), (k, 0, 0, 0.1)]
    got = {r.m: r.pae for r in g.connecting_pae(spark.createDataFrame(links, "m int, a int, b int, pae double"), spark.createDataFrame(models, "m int, n int"), ["m"]).collect()}
    for k, n in models:
        want = float("-inf") if n == 1 else None
        for t in (4.0, 3.0, 2.0, 1.0):
            reach, more = {0}, True
            while more:
                more = {y for m, a, b, p in links if m == k and p is not None and p <= t and a < n and b < n for x, y in ((a, b), (b, a)) if x in reach} - reach
                reach |= more
            if n > 1 and len(reach) == n:
                want = t
        assert got[k] == want


def test_presence_statistics_with_copies(spark):
    rows = [("A", "B", h, c) for h, c in ((True, ["A", "B", "C"]), (True, ["A", "A", "B"]), (False, ["A", "B", "C"]), (False, ["A", "B", "D"]), (None, ["A", "B", "C"]), (True, ["A", "B", "C", "C"]))]
    got = {r.partner: r for r in st.partner_phi(spark.createDataFrame(rows, "a string, b string, hit boolean, combo array<string>")).collect()}
    assert set(got) == {"A", "C", "D"}
    assert (got["C"].n11, got["C"].n10, got["C"].n01, got["C"].n00) == (2, 1, 1, 1) and (got["A"].n11, got["A"].n10) == (1, 0)
    assert np.isclose(got["C"].phi, np.corrcoef([1, 0, 1, 0, 1], [1, 1, 0, 0, 1])[0, 1])
    x = [("P", 1.0, ["P", "Q"]), ("P", 2.0, ["P", "P"]), ("P", 4.0, ["P", "Q"]), ("P", None, ["P", "R"]), ("O", 1.0, ["O", "Q"])]
    r = {(y.protein, y.partner): y for y in st.partner_correlation(spark.createDataFrame(x, "protein string, value double, combo array<string>")).collect()}
    assert set(r) == {("P", "Q"), ("P", "P"), ("O", "Q")} and r["O", "Q"].r is None
    assert np.isclose(r["P", "Q"].r, np.corrcoef([1, 2, 4], [1, 0, 1])[0, 1]) and r["P", "Q"].mean_without == 2.0


def test_rules_decide_in_stages(spark):
    edges = [("A", "B", True, True, True, True, 0.4, 0), ("A", "C", False, True, False, True, 0.0, 9), ("A", "D", True, True, False, True, 1.0, 3), ("A", "E", True, True, False, True, 1.0, 6), ("A", "F", True, True, False, False, 0.0, 0)]
    df = spark.createDataFrame(edges, "a string, b string, tested2 boolean, tested_n boolean, in2 boolean, in_n boolean, variation double, n_contacts int")
    got = {r.b: (r.dynamics, r.stage) for r in g.classify_edges(df, g.default_rules(spark)).collect()}
    assert got == {"B": ("Negative", 3), "C": ("No 2-mers Data", 1), "D": ("Indirect", 4), "E": ("Strong Positive", 4), "F": ("Indirect", 2)}
    twice = spark.createDataFrame([*g.RULES, g.RULES[0]], g._RULE_SCHEMA)
    assert {r.b: r.dynamics for r in g.classify_edges(df, twice).collect()}["C"] == "ERROR"


def test_merges_remember_the_nearest():
    rng = np.random.default_rng(1)

    def plain(d, k, linkage):
        groups = [[i] for i in range(len(d))]
        pick = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
        while len(groups) > k:
            _, i, j = min((round(float(pick(d[np.ix_(x, y)])), 12), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2))
            groups[i] += groups.pop(j)
            groups.sort(key=min)
        out = np.empty(len(d), dtype=int)
        for n, m in enumerate(sorted(groups, key=min)):
            out[m] = n
        return out.tolist()

    for _ in range(6):
        p = rng.random((14, 3))
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        for linkage in ("single", "complete", "average"):
            cuts = cl.agglomerations(d, [1, 2, 4, 9, 14], linkage)
            assert all(cuts[k].tolist() == plain(d, k, linkage) for k in (1, 2, 4, 9, 14)), linkage
    tied = np.ones((5, 5)) - np.eye(5)
    assert cl.agglomerate(tied, 2).tolist() == [0, 0, 0, 0, 1]


def test_scores_of_partitions():
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    truth = np.repeat([0, 1, 2], 12)
    mean = p.mean(axis=0)
    between = sum(12 * ((p[truth == k].mean(axis=0) - mean) ** 2).sum() for k in range(3))
    within = sum(((p[truth == k] - p[truth == k].mean(axis=0)) ** 2).sum() for k in range(3))
    assert np.isclose(cl.calinski_harabasz(p, truth), (between / 2) / (within / 33))
    spread = [np.linalg.norm(p[truth == k] - p[truth == k].mean(axis=0), axis=1).mean() for k in range(3)]
    apart = lambda i, j: np.linalg.norm(p[truth == i].mean(axis=0) - p[truth == j].mean(axis=0))
    assert np.isclose(cl.davies_bouldin(p, truth), np.mean([max((spread[i] + spread[j]) / apart(i, j) for j in range(3) if j != i) for i in range(3)]))
    for score in ("silhouette", "calinski_harabasz", "davies_bouldin", "gap"):
        assert len(np.unique(cl.best_count(d, 2, score=score))) == 3, score


def test_merging_methods():
    a, b, c = np.array([1, 1, 1, 1, 0, 0, 0, 0.0]), np.array([1, 1, 1, 0, 0, 0, 0, 0.0]), np.array([0, 0, 0, 0, 0, 1, 1, 1.0])
    assert cl.merge_small(cl.set_jaccard, [a, b, c], [10, 9, 8], 0.5) == [0, 0, 1]
    assert cl.merge_small(cl.set_jaccard, [a, b, c], [10, 1, 8], 0.99) == [0, 0, 1]  # the small one is absorbed
    assert cl.contact_fraction(a, b) == 1.0 and cl.contact_fraction(a, c) == 0.0
    near, far = np.array([[0, 0], [1, 1]]), np.array([[30, 30], [31, 31]])
    assert cl.merge_close([near, near + 2, far], 10) == [0, 0, 1]
    assert cl.merge_counts(lambda x: cl.set_jaccard(*x), [a, b, c], np.array([0.0, 0.5, 0.9])) == [1, 2, 3]


def test_nearest_and_silhouettes(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.random((90, 4)), np.zeros((3, 4))])
    rows = [(k, [float(y) for y in x], int(k % 3)) for k, x in enumerate(v)] + [(200, None, 0)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)).round(9)
    np.fill_diagonal(d, np.inf)
    got = {r.id: r.nearest for r in cl.nearest(df.where("id % 10 = 0 OR id > 90"), df, "id", "v", block=16).collect()}
    assert got == {k: int(d[k].argmin()) for k in range(93) if k % 10 == 0 or k > 90}
    labels = np.array([r[2] for r in rows[:93]])
    sq = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    each = []
    for k in range(93):
        own = (labels == labels[k]) & (np.arange(93) != k)
        a, b = sq[k, own].mean(), min(sq[k, labels == x].mean() for x in range(3) if x != labels[k])
        each.append((b - a) / max(a, b))
    s = cl.silhouettes(df.where("v IS NOT NULL").withColumn("k", F.lit(1)), ["k"], "v", 4).first().silhouette
    assert np.isclose(s, np.mean(each))


def test_open_pairs_and_suggestions(spark):
    items = spark.createDataFrame([(x,) for x in "ABCD"] + [(None,)], "p string")
    done = spark.createDataFrame([("B", "A"), ("A", "B"), ("C", "C"), ("A", "Z")], "p1 string, p2 string")
    assert {r.item: (r.n_partners, r.n_done, r.n_left) for r in la.open_pairs(items, done).collect()} == {"A": (4, 1, 3), "B": (3, 0, 3), "C": (2, 1, 1), "D": (1, 0, 1)}
    states = spark.createDataFrame([(["A", "A"], True), (["A", "B"], True), (["A", "A", "A", "A"], False), (["A", "B", "C"], False)], "combo array<string>, is_stable boolean")
    links = spark.createDataFrame([("B", "A"), ("A", "A"), ("C", "B")], "p1 string, p2 string")
    homo = la.homo_states(spark.createDataFrame([(["A"] * n, r, 1.0) for n in (2, 4) for r in range(1, 6)], "combo array<string>, rank int, min_pae double"))
    got = {"".join(r.combo): r.reason for r in la.suggestions(links, states, states, homo, spark.createDataFrame([("A", "B")], "a string, b string")).collect()}
    assert got == {"AAA": "homo N+1", "AAB": "multivalent child", "ABB": "multivalent child", "BBC": "expanded 3-mer", "BCC": "expanded 3-mer"}
    assert {r.first_break for r in la.homo_breaks(homo).collect()} == {None} and {r.first_untested for r in la.homo_breaks(homo).collect()} == {3}


def test_sequences_within_others(spark):
    p = spark.createDataFrame([("P1", "MKVLL"), ("P2", "AAAMMMKV"), ("P3", "MMMK"), ("P4", None)], "prot_id string, seq string")
    c = spark.createDataFrame([(s,) for s in ("MKVLL", "MMM", "XXMMMKXX", "MK", "WWWWW", "")], "sequence string")
    assert {r.sequence: r.prot_id for r in mmcif.name_sequences(c, p).collect()} == {"MKVLL": "P1", "MMM": "P3", "XXMMMKXX": "P3", "MK": "unknown", "WWWWW": "unknown", "": "unknown"}


@pytest.fixture(scope="module")
def homo(spark, tmp_path_factory):
    """One protein with itself in two blocks of low PAE, and a pair of two proteins."""
    pae = [[1.0 if (i < 4) == (j < 4) else 20.0 for j in range(8)] for i in range(8)]
    path = tmp_path_factory.mktemp("homo")
    rows = [(k, p, q, [p, q], ["A", "B"], 1, 8, 8, None, pae, None, pae) for k, p, q in ((1, "P", " p"), (2, "P", "Q"))]
    spark.createDataFrame(rows, MATRICES).coalesce(1).write.parquet(f"{path}/pairwise_contact_matrices.parquet")
    return str(path)


def test_domains_come_from_homo_pairs(spark, homo):
    got = catalog.queries()["clu_8_domains"](spark, homo).collect()
    assert {r.matrix_id for r in got} == {1}
    labels = [r.domain for r in sorted(got, key=lambda r: r.residue)]
    assert labels[:4] == [labels[0]] * 4 and labels[4:] == [labels[4]] * 4 and labels[0] != labels[4]
