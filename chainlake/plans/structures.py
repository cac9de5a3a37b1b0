"""Queries of matrices, clusters, graphs, rules, lattices and reports (MAT, CLU, STA, GRF, CLS, LAT, REP) and the kernels behind them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions import geometry as geo
from chainlake.functions import metrics as m
from chainlake.operators import clusters as cl
from chainlake.operators import contacts as c
from chainlake.operators import graph as g
from chainlake.operators import lattice as la
from chainlake.operators import statistics as st
from chainlake.plans import views as v
from chainlake.plans.catalog import query, table
from chainlake.plans.relations import _AGG1, _AGG2, _AGG10, _MODELS, _combo, _frequency, _interactions, _models, _sizes, _SIZES, ab, agg_11, passing2, passing_n
from chainlake.storage import Scratch

# --- matrices ---


@query("mat_1_contacts", f"WITH {v.CONTACTS} SELECT matrix_id, a, b, i, j, pae, plddt, dist FROM contact")
def mat_1(spark, d):
    return v.contacts(spark, d).select("matrix_id", "a", "b", "i", "j", "pae", "plddt", "dist")


@query("mat_2_pair_matrices", f"WITH {v.CONTACTS} SELECT a, b, count(DISTINCT matrix_id) AS n_matrices, count(*) AS n_contacts FROM contact GROUP BY 1, 2")
def mat_2(spark, d):
    return v.contacts(spark, d).groupBy("a", "b").agg(F.count_distinct("matrix_id").alias("n_matrices"), F.count("*").alias("n_contacts"))


_PAIRED = f"""WITH {v.CONTACTS}, sized AS (SELECT matrix_id, least(p1, p2) AS a, greatest(p1, p2) AS b, count(*) AS n_cells FROM cell WHERE p1 IS NOT NULL AND p2 IS NOT NULL GROUP BY ALL),
nxt AS (SELECT matrix_id AS m1, lead(matrix_id) OVER (PARTITION BY a, b ORDER BY matrix_id) AS m2 FROM sized), pr AS (SELECT * FROM nxt WHERE m2 IS NOT NULL),
k AS (SELECT matrix_id, count(*) AS k FROM contact GROUP BY 1), com AS (SELECT m1, m2, count(*) AS c FROM pr JOIN contact x ON x.matrix_id = m1 JOIN contact y ON y.matrix_id = m2 AND x.i = y.i AND x.j = y.j GROUP BY 1, 2),
u AS (SELECT pr.m1, pr.m2, coalesce(k1.k, 0)::DOUBLE AS k1, coalesce(k2.k, 0)::DOUBLE AS k2, coalesce(c, 0)::DOUBLE AS c, s.n_cells::DOUBLE AS n FROM pr LEFT JOIN k k1 ON k1.matrix_id = m1 LEFT JOIN k k2 ON k2.matrix_id = m2 LEFT JOIN com USING (m1, m2) JOIN sized s ON s.matrix_id = m1)"""


def _next_pairs(spark, d):
    """The contact cells (written once, for they are read several times), each record with the next of its pair, and the records' numbers of cells."""
    sized = v.shapes(spark, d).select("matrix_id", "a", "b", "n_cells")
    nxt = sized.select(F.col("matrix_id").alias("matrix_1"), F.lead("matrix_id").over(Window.partitionBy("a", "b").orderBy("matrix_id")).alias("matrix_2")).where("matrix_2 IS NOT NULL")
    scratch = Scratch(spark, "pairs")
    return scratch.save(v.contacts(spark, d).select("matrix_id", "i", "j"), "contacts"), scratch.save(nxt, "next"), sized


@query(
    "mat_3_matrix_distances",
    _PAIRED
    + """ SELECT m1, m2, round(CASE WHEN k1 = 0 AND k2 = 0 THEN 0 ELSE 1 - c / (k1 + k2 - c) END, 8) AS jaccard, round(CASE WHEN k1 = 0 AND k2 = 0 THEN 0 WHEN k1 = 0 OR k2 = 0 THEN 1 ELSE 1 - c / sqrt(k1 * k2) END, 8) AS cosine,
    round((k1 + k2 - 2 * c) / n, 8) AS hamming, round(1 - abs(CASE WHEN (n * k1 - k1 * k1) * (n * k2 - k2 * k2) > 0 THEN (n * c - k1 * k2) / sqrt((n * k1 - k1 * k1) * (n * k2 - k2 * k2)) ELSE 0 END), 8) AS correlation, correlation AS spearman FROM u""",
)
def mat_3(spark, d):
    """Spearman's coefficient of 0/1 matrices is Pearson's: mean ranks of two values are a straight function of the values."""
    contacts, pairs, sized = _next_pairs(spark, d)
    out = c.pair_measures(contacts, pairs, sized.select("matrix_id", "n_cells"))
    return out.select(F.col("matrix_1").alias("m1"), F.col("matrix_2").alias("m2"), *(F.round(x, 8).alias(x) for x in ("jaccard", "cosine", "hamming", "correlation")), F.round("correlation", 8).alias("spearman"))


@query(
    "mat_3_closeness",
    _PAIRED
    + """, f AS (SELECT m1, m2, x.i, x.j, min(abs(x.i - y.i) + abs(x.j - y.j)) AS e FROM pr JOIN contact x ON x.matrix_id = m1 JOIN contact y ON y.matrix_id = m2 GROUP BY ALL),
    r AS (SELECT m1, m2, y.i, y.j, min(abs(x.i - y.i) + abs(x.j - y.j)) AS e FROM pr JOIN contact x ON x.matrix_id = m1 JOIN contact y ON y.matrix_id = m2 GROUP BY ALL),
    fa AS (SELECT m1, m2, avg(e) AS e FROM f GROUP BY 1, 2), ra AS (SELECT m1, m2, avg(e) AS e FROM r GROUP BY 1, 2)
    SELECT pr.m1, pr.m2, round((fa.e + ra.e) / 2, 8) AS closeness FROM pr JOIN fa USING (m1, m2) JOIN ra USING (m1, m2)""",
)
def mat_3b(spark, d):
    contacts, pairs, _ = _next_pairs(spark, d)
    out = c.closeness(contacts, pairs).where("closeness < double('inf')")
    return out.select(F.col("matrix_1").alias("m1"), F.col("matrix_2").alias("m2"), F.round("closeness", 8).alias("closeness"))


@query(
    "mat_5_one_sided_closeness",
    _PAIRED
    + """, f AS (SELECT m1, m2, x.i, x.j, min(abs(x.i - y.i) + abs(x.j - y.j)) AS e FROM pr JOIN contact x ON x.matrix_id = m1 JOIN contact y ON y.matrix_id = m2 GROUP BY ALL) SELECT m1, m2, median(e)::DOUBLE AS one_sided FROM f GROUP BY 1, 2""",
)
def mat_5(spark, d):
    contacts, pairs, _ = _next_pairs(spark, d)
    return c.closeness(contacts, pairs, "median").where("one_sided < double('inf')").select(F.col("matrix_1").alias("m1"), F.col("matrix_2").alias("m2"), "one_sided")


@query(
    "mat_4_quality",
    f"""WITH {v.CELLS}, q AS (SELECT matrix_id, count(*) AS n, count(*) FILTER (WHERE {v.TOLD}) AS k, avg(pae) FILTER (WHERE {v.TOLD}) AS p, avg(plddt) FILTER (WHERE {v.TOLD}) AS l FROM cell WHERE pae IS NOT NULL AND plddt IS NOT NULL GROUP BY 1)
    SELECT matrix_id, k AS n_contacts, round(coalesce(k / n * greatest(0, 1 - p / 30) * l / 100, 0), 8) AS quality FROM q""",
)
def mat_4(spark, d):
    return c.matrix_quality(v.cells(spark, d)).select("matrix_id", "n_contacts", F.round("quality", 8).alias("quality"))


_FREQ = f"""WITH {v.CONTACTS}, md AS (SELECT DISTINCT matrix_id, least(p1, p2) AS a, greatest(p1, p2) AS b, n_chains FROM cell WHERE p1 IS NOT NULL AND p2 IS NOT NULL),
n AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE n_chains = 2) AS n2, count(*) FILTER (WHERE n_chains > 2) AS nn FROM md GROUP BY 1, 2),
k AS (SELECT a, b, i, j, count(*) AS k, count(*) FILTER (WHERE n_chains = 2) AS k2, count(*) FILTER (WHERE n_chains > 2) AS kn FROM contact GROUP BY ALL)"""


@query(
    "mat_15_contact_classes",
    _FREQ + " SELECT a, b, i, j, CASE WHEN k2 > 0 AND nn = 0 THEN 4 WHEN kn > 0 AND n2 = 0 THEN 5 WHEN k2 > 0 AND kn > 0 THEN 1 WHEN kn > 0 THEN 2 WHEN k2 > 0 THEN 3 ELSE 0 END AS class FROM k JOIN n USING (a, b)",
)
def mat_15(spark, d):
    tested = v.shapes(spark, d).groupBy("a", "b").agg(F.bool_or(F.col("n_chains") == 2).alias("t2"), F.bool_or(F.col("n_chains") > 2).alias("tn"))
    return _frequency(spark, d).join(tested, ["a", "b"]).select("a", "b", "i", "j", c.contact_class(F.col("freq2"), F.col("freqn"), F.col("t2"), F.col("tn")).alias("class"))


@query(
    "mat_16_residue_groups",
    f"""WITH {v.CONTACTS}, e AS (SELECT a AS protein, i AS residue, b AS partner, rank FROM contact WHERE rank IS NOT NULL UNION ALL SELECT b, j, a, rank FROM contact WHERE rank IS NOT NULL),
    n AS (SELECT protein, residue, count(DISTINCT partner) AS n_partners, count(DISTINCT (partner, rank)) AS n_surfaces FROM e GROUP BY 1, 2)
    SELECT *, CASE WHEN n_partners > 1 THEN 'C' WHEN n_surfaces > 1 THEN 'B' ELSE 'A' END AS interaction_group FROM n""",
)
def mat_16(spark, d):
    rows = v.contacts(spark, d).where("rank IS NOT NULL")
    modes = rows.select("matrix_id", F.col("rank").alias("mode")).distinct()
    return c.residue_groups(rows.drop("rank"), modes)


@query("mat_19_sparse_frequencies", _FREQ + " SELECT a, b, i, j, round(k / n, 8) AS freq FROM k JOIN n USING (a, b) WHERE a <> b OR i < j")
def mat_19(spark, d):
    return _frequency(spark, d).where("a <> b OR i < j").select("a", "b", "i", "j", F.round("freq", 8).alias("freq"))


@query("mat_12_monomers", f"WITH {v.CHAINS} SELECT prot_id, count(*) AS n_models, count(DISTINCT pred_id) AS n_predictions FROM chain WHERE prot_id IS NOT NULL GROUP BY 1")
def mat_12(spark, d):
    return v.chains(spark, d).where("prot_id IS NOT NULL").groupBy("prot_id").agg(F.count("*").alias("n_models"), F.count_distinct("pred_id").alias("n_predictions"))


@query("mat_18_parabola", "SELECT vec_id, round(i * 0.5, 8) AS x, round(label * (1 - (i * 0.5 - 1) * (i * 0.5 - 1)), 8) AS y FROM embeddings, unnest(range(0, 5)) u(i)")
def mat_18(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i * 0.5)).alias("x"))
    return rows.select("vec_id", F.round("x", 8).alias("x"), F.round(F.col("label") * (1 - (F.col("x") - 1) * (F.col("x") - 1)), 8).alias("y"))


def _chain_points(spark, d):
    """CA coordinates of each chain in order, with its protein: (file_id, prot_id, chain, xyz, plddt)."""
    ch = v.chains(spark, d).where("prot_id IS NOT NULL").select("file_id", F.col("chain_id").alias("chain"), "prot_id")
    ordered = F.array_sort(F.collect_list(F.struct("res_no", "line", "x", "y", "z", "bfactor")))
    pts = v.atoms(spark, d).where("atom_name = 'CA'").groupBy("file_id", "chain").agg(ordered.alias("p"))
    rows = pts.join(ch, ["file_id", "chain"])
    return rows.select("file_id", "chain", "prot_id", F.transform("p", lambda r: F.array(r["x"], r["y"], r["z"])).alias("xyz"), F.transform("p", lambda r: r["bfactor"]).alias("plddt"))


@query("mat_7_superposition_rmsd")
def mat_7(spark, d):
    """RMSD of each chain to the most confident chain of the same protein and length. The reference is one row per protein and length; models are fitted one by one."""
    pts = _chain_points(spark, d).withColumn("n", F.size("xyz")).where("n >= 3")
    mean = F.aggregate("plddt", F.lit(0.0), lambda s, x: s + x) / F.size("plddt")
    ref = pts.groupBy("prot_id", "n").agg(F.max_by("xyz", F.struct(mean, -F.col("file_id"), "chain")).alias("ref"))

    @F.pandas_udf("double")
    def rmsd(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(geo.superpose(np.stack(x), np.stack(y))[2], 4) for x, y in zip(a, b, strict=True)])

    return pts.join(ref, ["prot_id", "n"]).select("file_id", "chain", "prot_id", rmsd("xyz", "ref").alias("rmsd"))


@query("mat_8_pruned_rmsd")
def mat_8(spark, d):
    pts = _chain_points(spark, d).withColumn("n", F.size("xyz")).where("n >= 4")
    ref = pts.groupBy("prot_id", "n").agg(F.min_by("xyz", F.struct("file_id", "chain")).alias("ref"))

    @F.pandas_udf("double")
    def rmsd(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(geo.pruned_superposition(np.stack(x), np.stack(y))[2], 4) for x, y in zip(a, b, strict=True)])

    return pts.join(ref, ["prot_id", "n"]).select("file_id", "chain", "prot_id", rmsd("xyz", "ref").alias("rmsd"))


@query("mat_9_core_residues")
def mat_9(spark, d):
    """Steady confident residues per protein, from the residue statistics of all its models (quantiles in the JVM, the grid per protein)."""
    ch = v.chains(spark, d).where("prot_id IS NOT NULL").select("file_id", F.col("chain_id").alias("chain"), "prot_id")
    q = F.percentile("bfactor", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = v.atoms(spark, d).join(ch, ["file_id", "chain"]).groupBy("prot_id", "res_no").agg(q.alias("q")).select("prot_id", "res_no", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))

    def core(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("res_no")
        return rows.iloc[geo.core_residues(rows["median"].to_numpy(), rows["iqr"].to_numpy())][["prot_id", "res_no"]]

    return stats.groupBy("prot_id").applyInPandas(core, "prot_id string, res_no int")


@query("mat_14_clashes")
def mat_14(spark, d):
    """Chain pairs of a file whose backbone tubes have too many points at most 1 Å apart; every point counts, none is sampled."""

    @F.pandas_udf("array<array<double>>")
    def mesh(xyz: pd.Series) -> pd.Series:
        return xyz.map(lambda p: geo.backbone_mesh(np.stack(p)).tolist())

    pts = _chain_points(spark, d).select("file_id", "chain", F.explode(mesh("xyz")).alias("p")).select("file_id", "chain", *(F.col("p")[k].alias(x) for k, x in enumerate("xyz")))
    return c.near_points(pts, ["file_id"], "chain", 1.0, []).groupBy("file_id", "chain_1", "chain_2").agg(F.count("*").alias("n_close")).withColumn("clash", F.col("n_close") >= 10)


@query(
    "agg_22_centroid_distances",
    f"""WITH {v.ATOMS}, p AS (SELECT file_id, x, y, z FROM atom WHERE atom_name = 'CA'), c AS (SELECT file_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1), d AS (SELECT file_id, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS r FROM p JOIN c USING (file_id))
    SELECT file_id, round(avg(r), 6) AS mean_distance, round(stddev_pop(r), 6) AS sd_distance FROM d GROUP BY 1""",
)
def agg_22b(spark, d):
    """Mean and SD of the distances of residues from the centroid, per file."""
    p = v.atoms(spark, d).where("atom_name = 'CA'").select("file_id", "x", "y", "z")
    centre = p.groupBy("file_id").agg(*(F.avg(x).alias(f"c{x}") for x in "xyz"))
    far = p.join(centre, "file_id").select("file_id", m.distance3([F.col(x) for x in "xyz"], [F.col(f"c{x}") for x in "xyz"]).alias("r"))
    return far.groupBy("file_id").agg(F.round(F.avg("r"), 6).alias("mean_distance"), F.round(F.stddev_pop("r"), 6).alias("sd_distance"))


@query("agg_22_ring_fit")
def agg_22(spark, d):
    """Radius of the circle through the chains' centroids in their principal plane, and mean and SD of their distances from the middle, per file of at least three chains of one protein; with it the circle of the residues of any file."""
    atoms = v.atoms(spark, d).where("atom_name = 'CA'")
    centres = atoms.groupBy("file_id", "chain").agg(*(F.avg(x).alias(x) for x in "xyz"))
    homo = v.chains(spark, d).where("prot_id IS NOT NULL").groupBy("file_id").agg((F.min("prot_id") == F.max("prot_id")).alias("homo"))
    rings = centres.join(homo.where("homo"), "file_id", "left_semi").select("file_id", F.lit("chains").alias("of"), "x", "y", "z").unionByName(atoms.select("file_id", F.lit("residues").alias("of"), "x", "y", "z"))
    each = rings.groupBy("file_id", "of").agg(F.array_sort(F.collect_list(F.array("x", "y", "z"))).alias("xyz")).where(F.size("xyz") >= 3)

    @F.pandas_udf("array<double>")
    def fit(points: pd.Series) -> pd.Series:
        out = []
        for p in points:
            x = np.stack(p)
            far = np.linalg.norm(x - x.mean(axis=0), axis=1)
            out.append([round(far.mean(), 4), round(far.std(), 4), round(float(geo.fit_circle(x)[1]), 3)])
        return pd.Series(out)

    found = each.select("file_id", "of", fit("xyz").alias("f"))
    return found.select("file_id", "of", *(F.col("f")[k].alias(n) for k, n in enumerate(("mean_distance", "sd_distance", "radius"))))


# --- clusters and statistics ---


@query(
    "clu_2_silhouette",
    """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e, label // 5 AS k FROM embeddings), dby AS (SELECT x.k, x.vec_id, x.label AS lx, y.label AS ly, avg(array_distance(x.e, y.e) ** 2) AS d FROM p x JOIN p y ON x.k = y.k AND x.vec_id <> y.vec_id GROUP BY ALL),
    ab AS (SELECT k, vec_id, max(d) FILTER (WHERE lx = ly) AS a, min(d) FILTER (WHERE lx <> ly) AS b FROM dby GROUP BY 1, 2)
    SELECT k, round(avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b, 1e-12) END), 6) AS silhouette FROM ab GROUP BY 1""",
)
def clu_2(spark, d):
    """Silhouette of given labels within fixed groups of labels, by squared distances over all numbers of the vectors."""
    p = table(spark, d, "embeddings").select(F.expr("label DIV 5").cast("int").alias("k"), "label", "embedding")
    return cl.silhouettes(p, ["k"], "embedding", 64).select("k", F.round("silhouette", 6).alias("silhouette"))


def _valency(spark, d):
    """The most chains of a partner that a chain touches, of multivalent pairs: (a, b, valency)."""
    return c.max_valency(_interactions(spark, d)).join(agg_11(spark, d), ["a", "b"]).select("a", "b", F.col("max_valency").alias("valency"))


def _different(spark, d):
    """The different contact sets of each pair, with the records that have them: (a, b, cells, matrix_id, records)."""
    cells = v.contacts(spark, d).groupBy("a", "b", "matrix_id").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("cells")).where(F.size("cells") >= 3)
    codes = cells.select("a", "b", "matrix_id", F.transform("cells", lambda x: x["i"].cast("bigint") * 100000 + x["j"]).alias("cells"))
    return codes.groupBy("a", "b", "cells").agg(F.min("matrix_id").alias("matrix_id"), F.collect_list("matrix_id").alias("records"))


def _per_pair(spark, d, label, kind="int", valency=None, parts=0):
    """Labels of all records (a, b, matrix_id, label) from a grouped function of a pair's different contact sets: label(distances, sets, numbers of records), the pair's valency (1 if not listed) where such a table is given. Distances are a matrix for few sets, else the sets, which make them row by row. With parts, label() also gets a number of these, each in a task of its own, and rows have it as `part`."""
    different = _different(spark, d)
    if valency is not None:
        different = different.join(valency, ["a", "b"], "left").fillna(1, ["valency"])

    if parts:
        different = different.withColumn("part", F.explode(F.array(*map(F.lit, range(parts)))))
    given = [x for x in ("valency", "part") if x in different.columns]
    keys = ["a", "b", *(["part"] if parts else [])]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("matrix_id")
        sets = cl.ContactSets([np.asarray(x) for x in rows["cells"]])
        distance = sets.dense() if len(sets) <= sets.dense_limit else sets
        return rows[[*keys, "records"]].assign(label=list(label(distance, sets, rows["records"].map(len).to_numpy(), *(int(rows[x].iloc[0]) for x in given))))

    labels = different.groupBy(*keys).applyInPandas(solve, f"a string, b string, {'part int, ' * bool(parts)}records array<bigint>, label {kind}")
    return labels.select(*keys, F.explode("records").alias("matrix_id"), "label")


@query("clu_1_agglomerative")
def clu_1(spark, d):
    return _per_pair(spark, d, lambda dist, sets, w: cl.agglomerate(dist, min(2, len(dist)), weights=w))


@query("clu_1_dbscan")
def clu_1b(spark, d):
    return _per_pair(spark, d, lambda dist, sets, w: cl.dbscan(dist, cl.distance_quantile(dist, 0.2, w), weights=w))


@query("clu_3_contact_clusters")
def clu_3(spark, d):
    """The number of clusters starts from the valency of a multivalent pair, else from one, and follows the silhouette."""
    return _per_pair(spark, d, lambda dist, sets, w, valency: cl.best_count(dist, valency, weights=w), valency=_valency(spark, d))


@query("clu_4_cluster_table")
def clu_4(spark, d):
    """Clusters with size, label by total contacts, and the record most like the mean."""
    labels = clu_3(spark, d)
    cells = v.contacts(spark, d).select("a", "b", "matrix_id", "i", "j")
    x = cells.join(labels, ["a", "b", "matrix_id"])
    n = labels.groupBy("a", "b", "label").agg(F.count("*").alias("n_models"))
    freq = x.groupBy("a", "b", "label", "i", "j").agg(F.count("*").alias("k")).join(n, ["a", "b", "label"]).withColumn("freq", F.col("k") / F.col("n_models"))
    score = x.join(freq.select("a", "b", "label", "i", "j", "freq"), ["a", "b", "label", "i", "j"]).groupBy("a", "b", "label", "matrix_id").agg((F.sum("freq") / F.sqrt(F.count("*"))).alias("s"))
    best = score.groupBy("a", "b", "label").agg(F.max_by("matrix_id", F.struct(F.round("s", 9), -F.col("matrix_id"))).alias("representative"))
    total = freq.groupBy("a", "b", "label").agg(F.sum("freq").alias("total"))
    ranked = total.withColumn("cluster_n", F.dense_rank().over(Window.partitionBy("a", "b").orderBy(F.round("total", 9).desc(), "label")) - 1)
    return ranked.join(n, ["a", "b", "label"]).join(best, ["a", "b", "label"]).select("a", "b", "cluster_n", "n_models", "representative")


@query("clu_1_linkages")
def clu_1c(spark, d):
    """Labels of two clusters by each linkage (single, complete, average, ward) and by k-means of the scaled points."""

    names = ("single", "complete", "average", "ward", "kmeans")

    def label(dist, sets, w, part):
        k = min(2, len(dist))
        if names[part] != "kmeans":
            return cl.agglomerate(dist, k, names[part], weights=w)
        found = cl.kmeans(cl.classical_scaling(dist, weights=w), k)[0]
        return np.unique(found, return_inverse=True)[1] if found[0] == 0 else 1 - np.unique(found, return_inverse=True)[1]

    labels = _per_pair(spark, d, label, parts=len(names))
    return labels.groupBy("a", "b", "matrix_id").agg(*(F.max(F.when(F.col("part") == k, F.col("label"))).alias(n) for k, n in enumerate(names)))


def _once(value: list, n: int) -> list:
    """A pair's value at the first of its n sets."""
    return [value, *[None] * (n - 1)]


@query("clu_2_counts")
def clu_2b(spark, d):
    """Number of clusters of each pair by each score, starting from the pair's valency."""
    names = ("silhouette", "calinski_harabasz", "davies_bouldin", "gap")

    def label(dist, sets, w, valency):
        return _once([len(np.unique(x)) for x in cl.best_counts(dist, valency, names, weights=w)], len(dist))

    counts = _per_pair(spark, d, label, "array<int>", _valency(spark, d)).where("label IS NOT NULL").groupBy("a", "b").agg(F.first("label").alias("k"))
    return counts.select("a", "b", *(F.col("k")[i].alias(n) for i, n in enumerate(names)))


_MERGES = ("iou", "most_similar", "contact_fraction", "closeness", "two_step")


def _merged(parts, sets, w, thresholds=(0.3, 0.3, 0.5, 10.0)):
    """Number of clusters that each merging method leaves of the given ones."""
    keys = np.unique(parts)
    means, codes = sets.means(parts, w), sets.codes
    sizes = [int(w[parts == k].sum()) for k in keys]
    cells = np.stack([codes // 100000, codes % 100000], axis=1)
    iou, similar, fraction, close = thresholds
    first = cl.merge_small(cl.set_jaccard, means, sizes, similar)
    joined = [np.average([m for m, g in zip(means, first, strict=True) if g == k], axis=0, weights=[n for n, g in zip(sizes, first, strict=True) if g == k]) for k in sorted(set(first))]
    held = [sum(n for n, g in zip(sizes, first, strict=True) if g == k) for k in sorted(set(first))]
    return [
        len(cl.merge_similar(cl.set_jaccard, means, iou)), len(joined), len(set(cl.merge_small(cl.contact_fraction, means, sizes, fraction))), len(set(cl.merge_close([cells[m > 0] for m in means], close))),
        len(set(cl.merge_small(cl.contact_fraction, joined, held, fraction))),
    ]


@query("clu_5_merged_clusters")
def clu_5(spark, d):
    """Number of clusters left per pair by each merging method: by intersection over union, most similar first with small ones absorbed, by contact fraction, by closeness, and in two steps (most similar, then contact fraction)."""

    def label(dist, sets, w):
        parts = cl.agglomerate(dist, min(10, len(dist)), weights=w)
        return _once(_merged(parts, sets, w), len(dist))

    found = _per_pair(spark, d, label, "array<int>").where("label IS NOT NULL").groupBy("a", "b").agg(F.max("label").alias("n"))
    return found.select("a", "b", *(F.col("n")[k].alias(x) for k, x in enumerate(_MERGES)))


@query("clu_6_threshold_sweep")
def clu_6(spark, d):
    """Four merging measures at a hundred thresholds each: mean squared error of the number of clusters left against the number that the silhouette finds, and the best threshold of each measure (the smallest of equal ones)."""
    steps = np.linspace(0.01, 1.0, 100)

    def label(dist, sets, w, valency):
        base, tried = cl.tried_counts(len(dist), valency)
        cuts = cl.agglomerations(dist, [min(10, len(dist)), base, *tried], weights=w)
        parts = cuts[min(10, len(dist))]
        means, codes = sets.means(parts, w), sets.codes
        cells = np.stack([codes // 100000, codes % 100000], axis=1)
        true = len(np.unique(cl.best_counts(dist, valency, ["silhouette"], weights=w, cuts=cuts)[0]))
        sets = [cells[m > 0] for m in means]
        left = [
            cl.merge_counts(lambda x: cl.set_jaccard(*x), means, steps), cl.merge_counts(lambda x: cl.contact_fraction(*x), means, steps),
            cl.close_counts(sets, steps * 20, "mean"), cl.close_counts(sets, steps * 20, "median"),
        ]
        return _once([n - true for row in left for n in row], len(dist))

    errors = _per_pair(spark, d, label, "array<int>", _valency(spark, d)).where("label IS NOT NULL").groupBy("a", "b").agg(F.first("label").alias("e")).select("a", "b", F.posexplode("e").alias("at", "e"))
    metric = F.array(*map(F.lit, ("iou", "contact_fraction", "mean_closeness", "median_closeness")))
    scale = F.when(F.col("at") < 200, 1.0).otherwise(20.0)
    each = errors.groupBy("at").agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.count("*").alias("n_pairs"))
    rows = each.select(metric[F.floor(F.col("at") / 100).cast("int")].alias("metric"), F.round((F.col("at") % 100 + 1) / 100 * scale, 4).alias("threshold"), "mse", "n_pairs")
    best = rows.groupBy("metric").agg(F.min_by("threshold", F.struct("mse", "threshold")).alias("best"))
    return rows.join(best, "metric").select("metric", "threshold", "mse", "n_pairs", (F.col("threshold") == F.col("best")).alias("is_best"))


@query("clu_7_curve_clusters")
def clu_7(spark, d):
    """k-means of pLDDT curves of one protein and length, the number of clusters by silhouette."""
    curves = _chain_points(spark, d).select("file_id", "chain", "prot_id", "plddt", F.size("plddt").alias("n"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["file_id", "chain"])
        return rows[["file_id", "chain", "prot_id"]].assign(cluster=cl.curve_clusters(np.stack(rows["plddt"])))

    return curves.groupBy("prot_id", "n").applyInPandas(solve, "file_id bigint, chain string, prot_id string, cluster int")


@query("clu_7_mean_curves")
def clu_7b(spark, d):
    """Mean and SD of pLDDT at each residue of each curve cluster."""
    curves = _chain_points(spark, d).select("file_id", "chain", "prot_id", F.size("plddt").alias("n"), F.posexplode("plddt").alias("at", "plddt"))
    x = curves.join(clu_7(spark, d).select("file_id", "chain", "cluster"), ["file_id", "chain"])
    return x.groupBy("prot_id", "n", "cluster", "at").agg(F.round(F.avg("plddt"), 4).alias("mean"), F.round(F.stddev_pop("plddt"), 4).alias("sd"), F.count("*").alias("n_curves"))


@query("clu_8_domains")
def clu_8(spark, d):
    """Domains of each record of a protein with itself, from its PAE matrix; records of two proteins have no domains of their own."""
    from chainlake.functions.ids import protein_id

    one = protein_id("protein1") == protein_id("protein2")
    square = table(spark, d, "pairwise_contact_matrices").where(one & F.expr("pae IS NOT NULL AND length1 = length2")).select("matrix_id", protein_id("protein1").alias("protein"), "pae")

    def solve(batches):
        for b in batches:
            out = []
            for i, p, pae in zip(b["matrix_id"], b["protein"], b["pae"], strict=True):
                labels = cl.pae_domains(np.stack(pae).astype(float))
                out += [(i, p, r + 1, int(x)) for r, x in enumerate(labels)]
            yield pd.DataFrame(out, columns=["matrix_id", "protein", "residue", "domain"])

    return square.mapInPandas(solve, "matrix_id bigint, protein string, residue int, domain int")


def _scaled(cells, n, starts):
    """Places (x, y) of a pair's contact sets by the best of these starts, the stress left as a share, and the stress by which starts are compared."""
    sets = cl.ContactSets([np.asarray(x) for x in cells])
    distance = sets.dense() if len(sets) <= sets.dense_limit else sets
    x, stress, left = min(cl.smacof_starts(distance, starts, weights=np.asarray(n)), key=lambda f: f[1])
    return {"x": np.round(x[:, 0], 4), "y": np.round(x[:, 1], 4), "stress": round(left, 4), "found": stress}


@query("clu_9_scaling")
def clu_9(spark, d, starts=5, large=1000):
    """Plane coordinates of each record among those of its pair, and the stress of the embedding: the lowest of all starts. Each start of a pair of more than `large` different sets has a task of its own."""
    pairs = _different(spark, d).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("matrix_id", "cells", "records"))).alias("sets"))
    every = F.array(*map(F.lit, range(starts)))
    jobs = pairs.select("a", "b", "sets", F.explode(F.when(F.size("sets") > large, F.transform(every, lambda k: F.array(k))).otherwise(F.array(every))).alias("starts"))
    tasks = max(starts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = jobs.repartitionById(tasks, F.pmod(F.hash("a", "b").cast("bigint") + F.col("starts")[0], F.lit(tasks)).cast("int"))  # one pair's starts go to different tasks
    given = placed.select("a", "b", "starts", F.col("sets.cells").alias("cells"), F.transform("sets", lambda x: F.size(x["records"])).alias("n"), F.col("sets.records").alias("records"))

    def solve(batches):
        for batch in batches:
            for a, b, own, cells, n, records in batch.itertuples(index=False, name=None):
                yield pd.DataFrame({"a": a, "b": b, "start": int(own[0]), "records": list(records)} | _scaled(cells, n, own))

    found = given.mapInPandas(solve, "a string, b string, start int, records array<bigint>, x double, y double, stress double, found double")
    each = found.select("a", "b", F.explode("records").alias("matrix_id"), F.struct("found", "start", "x", "y", "stress").alias("f"))
    return each.groupBy("a", "b", "matrix_id").agg(F.min("f").alias("f")).select("a", "b", "matrix_id", "f.x", "f.y", "f.stress")


_PRESENT = v.PWN + """, md AS (SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, pred_id, bool_or(coalesce(min_pae <= 7.5, false)) AS hit, max(combo) AS combo FROM pwn WHERE combo IS NOT NULL AND pred_id IS NOT NULL GROUP BY 1, 2, 3),
w AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE hit) AS h FROM md GROUP BY 1, 2), e AS (SELECT a, b, hit, combo, unnest(list_distinct(combo)) AS partner FROM md),
pr AS (SELECT a, b, partner, count(*) AS m, count(*) FILTER (WHERE hit) AS n11 FROM e WHERE len(list_filter(combo, lambda q: q = partner)) >= 1 + (partner = a)::INT + (partner = b)::INT GROUP BY 1, 2, 3),
n AS (SELECT a, b, partner, n11, m - n11 AS n10, h - n11 AS n01, n - m - h + n11 AS n00 FROM pr JOIN w USING (a, b))"""


def _presence(spark, d):
    x = v.pairwise_n(spark, d).where("combo IS NOT NULL AND pred_id IS NOT NULL")
    models = x.groupBy(*ab(), "pred_id").agg(F.bool_or(F.coalesce(F.col("min_pae") <= 7.5, F.lit(False))).alias("hit"), F.max("combo").alias("combo"))
    return st.partner_phi(models)


@query(
    "sta_1_phi",
    "WITH " + _PRESENT + " SELECT a, b, partner, n11, n10, n01, n00, round(CASE WHEN (n11+n10)::DOUBLE*(n01+n00)*(n11+n01)*(n10+n00) > 0 THEN (n11::DOUBLE*n00 - n10::DOUBLE*n01) / sqrt((n11+n10)::DOUBLE*(n01+n00)*(n11+n01)*(n10+n00)) END, 8) AS phi FROM n",
)
def sta_1(spark, d):
    """Presence of each partner in the N-mers of an edge, from one copy on besides the edge's own, against the edge's detection."""
    return _presence(spark, d).withColumn("phi", F.round("phi", 8))


@query("sta_1_chi_squared")
def sta_1b(spark, d):
    """phi and its p (chi-squared of n · phi² with one degree of freedom) by class of the edge: Static edges have phi 0 and p 1, Strong Positive and Strong Negative ones phi 1 and -1 and p 0."""
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    x = _presence(spark, d).join(cls_1(spark, d), ["a", "b"], "left").withColumn("p", F.round(st.chi2_sf(n * F.col("phi") * F.col("phi")), 6))
    fixed = {"Static": (0.0, 1.0), "Strong Positive": (1.0, 0.0), "Strong Negative": (-1.0, 0.0)}
    phi, p = F.col("phi"), F.col("p")
    for name, (a, b) in fixed.items():
        phi, p = F.when(F.col("dynamics") == name, a).otherwise(phi), F.when(F.col("dynamics") == name, b).otherwise(p)
    return x.select("a", "b", "partner", "dynamics", F.round(phi, 8).alias("phi"), p.alias("p")).where("phi IS NOT NULL")


@query(
    "sta_2_point_biserial",
    f"""WITH {v.PWN}, r AS (SELECT p1 AS protein, min_pae AS y, combo FROM pwn WHERE combo IS NOT NULL AND min_pae IS NOT NULL), w AS (SELECT protein, count(*) AS n, sum(y) AS s, min(y) AS lo, max(y) AS hi FROM r GROUP BY 1),
    pt AS (SELECT DISTINCT protein, unnest(list_distinct(combo)) AS partner FROM r), x AS (SELECT r.protein, partner, y, len(list_filter(combo, lambda q: q = partner)) >= 1 + (r.protein = partner)::INT AS f FROM r JOIN pt ON pt.protein = r.protein),
    z AS (SELECT protein, partner, count(*) AS n, count(*) FILTER (WHERE f) AS n_with, corr(y, f::INT) AS r, avg(y) FILTER (WHERE f) AS mean_with, avg(y) FILTER (WHERE NOT f) AS mean_without, min(y) AS lo, max(y) AS hi FROM x GROUP BY 1, 2)
    SELECT protein, partner, n, n_with, round(CASE WHEN n_with < n AND lo < hi THEN r END, 5) AS r, round(mean_with, 6) AS mean_with, round(mean_without, 6) AS mean_without FROM z WHERE n_with > 0""",
)
def sta_2(spark, d):
    """PAE of a protein's models against the presence of each partner."""
    x = v.pairwise_n(spark, d).select(F.col("p1").alias("protein"), F.col("min_pae").alias("value"), "combo")
    out = st.partner_correlation(x)
    return out.select("protein", "partner", "n", "n_with", F.round("r", 5).alias("r"), F.round("mean_with", 6).alias("mean_with"), F.round("mean_without", 6).alias("mean_without"))


def _rmsd_models(spark, d):
    """(protein, value, combo, file_id, chain): RMSD of each modelled chain to its protein's reference, with the proteins of its file."""
    combos = v.chains(spark, d).where("prot_id IS NOT NULL").groupBy("file_id").agg(F.array_sort(F.collect_list("prot_id")).alias("combo"))
    return mat_7(spark, d).join(combos, "file_id").select(F.col("prot_id").alias("protein"), F.col("rmsd").alias("value"), "combo", "file_id", "chain")


@query("sta_2_rmsd_point_biserial")
def sta_2b(spark, d):
    """RMSD of a protein's models against the presence of each partner, with the two-sided p of the correlation."""
    out = st.partner_correlation(_rmsd_models(spark, d))
    return out.select("protein", "partner", "n", "n_with", F.round("r", 6).alias("r"), F.round(st.correlation_p("r", "n"), 6).alias("p"))


@query("srt_2_rmsd_order")
def srt_2b(spark, d):
    """Models of each protein in order of RMSD."""
    from chainlake.operators import series

    return series.numbered(_rmsd_models(spark, d).select("protein", "value", "file_id", "chain"), ["protein"], ["value", "file_id", "chain"], name="traj_n")


@query("win_1_rmsd_bias")
def win_1c(spark, d):
    """Bias of every partner over the models of a protein in order of RMSD, for all four windows."""
    from chainlake.operators import series

    placed = series.numbered(_rmsd_models(spark, d), ["protein"], ["value", "file_id", "chain"])
    return series.partner_bias(placed, "protein", "ord", "combo")


@query("sta_3_fallback_targets")
def sta_3(spark, d):
    return st.fallback_target(_sizes(spark, d), "protein", "n", "mean", "sd", "k")


@query(
    "sta_4_variation",
    f"WITH {v.PWN}, p AS (SELECT p1, p2, pred_id, bool_or(coalesce(contains(cluster, '✔'), false)) AS ok FROM pwn GROUP BY 1, 2, 3) SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, round(avg(ok::INT), 8) AS variation FROM p GROUP BY 1, 2",
)
def sta_4(spark, d):
    ok = F.coalesce(F.contains("cluster", F.lit("✔")), F.lit(False))
    p = v.pairwise_n(spark, d).groupBy("p1", "p2", "pred_id").agg(F.bool_or(ok).alias("ok"))
    return p.groupBy(*ab()).agg(F.round(F.avg(F.col("ok").cast("double")), 8).alias("variation"))


# --- graph, rules, lattice ---


@query("grf_1_edge_weights", _AGG1 + " SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, round(n_models * iptm / nullif(min_pae, 0) * 2, 2) AS weight FROM f3")
def grf_1(spark, d):
    return g.edge_weights(passing2(spark, d), "iptm")


@query(
    "grf_2_vertex_status",
    _AGG1 + ", " + _AGG2.removeprefix("WITH ").replace("f1 AS", "g1 AS").replace("f2 AS", "g2 AS").replace("FROM f1 JOIN f2", "FROM g1 JOIN g2")
    + """, t2 AS (SELECT p1 AS p FROM pw2 UNION SELECT p2 FROM pw2), tn AS (SELECT p1 AS p FROM pwn UNION SELECT p2 FROM pwn), h2 AS (SELECT p1 AS p FROM f3 UNION SELECT p2 FROM f3), hn AS (SELECT p1 AS p FROM f3n UNION SELECT p2 FROM f3n)
    SELECT prot_id AS protein, CASE WHEN prot_id IN (FROM h2) AND prot_id IN (FROM hn) THEN 'Static' WHEN prot_id IN (FROM hn) THEN 'Positive' WHEN prot_id IN (FROM h2) AND prot_id NOT IN (FROM tn) THEN 'No N-mers Data' WHEN prot_id IN (FROM h2) THEN 'Negative'
    WHEN prot_id IN (FROM t2) OR prot_id IN (FROM tn) THEN 'No interaction' ELSE 'Untested' END AS status FROM proteins""",
)
def grf_2(spark, d):
    names = lambda t: t.select(F.explode(F.array("p1", "p2")).alias("p")).distinct()
    return g.vertex_status(table(spark, d, "proteins").select("prot_id"), names(v.pairwise2(spark, d)), names(v.pairwise_n(spark, d)), names(passing2(spark, d)), names(passing_n(spark, d)))


@query("grf_3_edges_with_modes", _AGG1 + f""", {v.CONTACTS.replace('cell AS', 'cell AS')}, m AS (SELECT a, b, rank, count(*) AS n FROM contact WHERE rank IS NOT NULL GROUP BY 1, 2, 3), e AS (SELECT DISTINCT least(p1, p2) AS a, greatest(p1, p2) AS b FROM f3)
    SELECT e.a, e.b, coalesce(m.rank, 0) AS mode, coalesce(m.n, 0) AS n_contacts, count(m.rank) OVER (PARTITION BY e.a, e.b) > 1 AS is_multivalent FROM e LEFT JOIN m ON e.a = m.a AND e.b = m.b""")
def grf_3(spark, d):
    e = passing2(spark, d).select(*ab()).distinct()
    modes = v.contacts(spark, d).where("rank IS NOT NULL").groupBy("a", "b", F.col("rank").alias("mode")).agg(F.count("*").alias("n"))
    x = e.join(modes, ["a", "b"], "left")
    return x.select("a", "b", F.coalesce("mode", F.lit(0)).alias("mode"), F.coalesce("n", F.lit(0)).alias("n_contacts"), (F.count("mode").over(Window.partitionBy("a", "b")) > 1).alias("is_multivalent"))


def _links(spark, d):
    """Passing chain pairs of each model: (pred_id, rank, a, b chain positions)."""
    x = v.pairwise_n(spark, d).where("min_pae <= 7.5 AND c1 IS NOT NULL AND c2 IS NOT NULL AND pred_id IS NOT NULL")
    return x.select("pred_id", "rank", m.chain_index(F.col("c1")).alias("a"), m.chain_index(F.col("c2")).alias("b"))


def _sized_models(spark, d):
    return v.pairwise_n(spark, d).where("combo IS NOT NULL AND pred_id IS NOT NULL").groupBy("pred_id", "rank").agg(F.max(F.size("combo")).alias("n"))


_REACH = f"""WITH RECURSIVE {v.PWN}, md AS (SELECT pred_id, rank, max(len(combo)) AS n FROM pwn WHERE combo IS NOT NULL AND pred_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT DISTINCT pred_id, rank, ascii(upper(c1)) - 65 AS a, ascii(upper(c2)) - 65 AS b FROM pwn WHERE min_pae <= 7.5 AND c1 IS NOT NULL AND c2 IS NOT NULL AND pred_id IS NOT NULL),
e AS (SELECT * FROM l UNION SELECT pred_id, rank, b, a FROM l), reach(pred_id, rank, pos) AS (SELECT pred_id, rank, 0::INT FROM md UNION SELECT r.pred_id, r.rank, e.b FROM reach r JOIN e ON e.pred_id = r.pred_id AND e.rank = r.rank AND e.a = r.pos),
k AS (SELECT pred_id, rank, count(DISTINCT pos) AS k FROM reach GROUP BY 1, 2), con AS (SELECT md.pred_id, md.rank, k >= n AS connected FROM md JOIN k ON md.pred_id = k.pred_id AND md.rank = k.rank)"""


@query("grf_4_connected_models", _REACH + " SELECT pred_id, rank, connected FROM con")
def grf_4(spark, d):
    return g.connected_models(_links(spark, d), _sized_models(spark, d), ["pred_id", "rank"])


_CON5 = f"""WITH RECURSIVE {v.CONTACTS}, {_MODELS}, md AS (SELECT DISTINCT combo, rank, len(combo) AS n FROM model WHERE rank IS NOT NULL AND len(combo) > 0), ok AS (SELECT matrix_id FROM contact GROUP BY 1 HAVING count(*) >= 5),
l AS (SELECT DISTINCT combo, rank, ascii(upper(c1)) - 65 AS a, ascii(upper(c2)) - 65 AS b FROM model WHERE matrix_id IN (FROM ok) AND c1 IS NOT NULL AND c2 IS NOT NULL AND rank IS NOT NULL),
e AS (SELECT * FROM l WHERE a < len(combo) AND b < len(combo) UNION SELECT combo, rank, b, a FROM l WHERE a < len(combo) AND b < len(combo)), reach(combo, rank, pos) AS (SELECT combo, rank, 0::INT FROM md UNION SELECT r.combo, r.rank, e.b FROM reach r JOIN e ON e.combo = r.combo AND e.rank = r.rank AND e.a = r.pos),
k AS (SELECT combo, rank, count(DISTINCT pos) AS k FROM reach GROUP BY 1, 2), con AS (SELECT md.combo, md.rank, k >= n AS connected FROM md JOIN k ON md.combo = k.combo AND md.rank = k.rank),
st AS (SELECT combo, count(DISTINCT rank) FILTER (WHERE connected) AS n_ranks FROM con GROUP BY 1)"""


def _contact_models(spark, d):
    """Whether the chains of each model (combination and rank) are one graph, chains being linked by at least five contacts."""
    models = _models(spark, d).where("rank IS NOT NULL AND size(combo) > 0")
    ok = c.contact_counts(v.contacts(spark, d), 5).select("matrix_id")
    links = models.where("c1 IS NOT NULL AND c2 IS NOT NULL").join(ok, "matrix_id", "left_semi").select("combo", "rank", m.chain_index(F.col("c1")).alias("a"), m.chain_index(F.col("c2")).alias("b"))
    return g.connected_models(links, models.select("combo", "rank", F.size("combo").alias("n")).distinct(), ["combo", "rank"])


@query("grf_5_stability", _CON5 + " SELECT array_to_string(combo, '|') AS combo, n_ranks, n_ranks >= 4 AS is_stable FROM st")
def grf_5(spark, d):
    return g.stability(_contact_models(spark, d), ["combo"]).withColumn("combo", _combo())


@query("grf_5_valid_stability")
def grf_5v(spark, d):
    """Stability where a rank counts only if its chains are connected and no delivered structure of the combination and rank has a clash (MAT-14); ranks without structures count."""
    files = v.chains(spark, d).where("prot_id IS NOT NULL AND rank IS NOT NULL").groupBy("file_id", "rank").agg(F.array_sort(F.collect_list("prot_id")).alias("combo"))
    bad = mat_14(spark, d).where("clash").select("file_id").distinct()
    clashing = files.join(bad, "file_id", "left_semi").select("combo", "rank", F.lit(False).alias("free")).distinct()
    ranks = _contact_models(spark, d).join(clashing, ["combo", "rank"], "left").withColumn("valid", F.coalesce("free", F.lit(True)))
    return g.stability(ranks, ["combo"]).withColumn("combo", _combo())


@query("grf_5_n_mer_stability", _REACH + " SELECT pred_id, count(DISTINCT rank) FILTER (WHERE connected) AS n_ranks, count(DISTINCT rank) FILTER (WHERE connected) >= 4 AS is_stable FROM con GROUP BY 1")
def grf_5n(spark, d):
    """The same by the PAE of chain pairs, per N-mer prediction."""
    return g.stability(grf_4(spark, d), ["pred_id"])


@query(
    "grf_5_dynamic_stability",
    f"""WITH RECURSIVE {v.PWN}, md AS (SELECT combo, pred_id, rank, len(combo) AS n FROM pwn WHERE len(combo) > 0 AND pred_id IS NOT NULL AND rank IS NOT NULL GROUP BY 1, 2, 3),
    l AS (SELECT combo, pred_id, rank, ascii(upper(c1)) - 65 AS a, ascii(upper(c2)) - 65 AS b, min(min_pae) AS pae FROM pwn WHERE len(combo) > 0 AND pred_id IS NOT NULL AND rank IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL AND min_pae IS NOT NULL GROUP BY ALL),
    e AS (SELECT combo, pred_id, rank, a, b, pae FROM l WHERE a < len(combo) AND b < len(combo) UNION ALL SELECT combo, pred_id, rank, b, a, pae FROM l WHERE a < len(combo) AND b < len(combo)),
    t AS (SELECT DISTINCT combo, pred_id, rank, pae AS t FROM e), reach(combo, pred_id, rank, t, pos) AS (SELECT combo, pred_id, rank, t, 0::INT FROM t UNION SELECT r.combo, r.pred_id, r.rank, r.t, e.b FROM reach r JOIN e ON e.combo = r.combo AND e.pred_id = r.pred_id AND e.rank = r.rank AND e.a = r.pos AND e.pae <= r.t),
    c AS (SELECT combo, pred_id, rank, t FROM reach GROUP BY ALL HAVING count(DISTINCT pos) >= len(combo)), p AS (SELECT md.combo, md.pred_id, md.rank, CASE WHEN any_value(n) = 1 THEN '-infinity'::DOUBLE ELSE min(c.t) END AS pae FROM md LEFT JOIN c ON c.combo = md.combo AND c.pred_id = md.pred_id AND c.rank = md.rank GROUP BY 1, 2, 3),
    k AS (SELECT combo, count(DISTINCT (pred_id, rank)) FILTER (WHERE pae <= 12.96) AS k5, count(DISTINCT (pred_id, rank)) FILTER (WHERE pae <= 10.53) AS k4, count(DISTINCT (pred_id, rank)) FILTER (WHERE pae <= 7.21) AS k3 FROM p GROUP BY 1)
    SELECT array_to_string(combo, '|') AS combo, CASE WHEN k5 >= 5 THEN 5 WHEN k4 >= 4 THEN 4 WHEN k3 >= 3 THEN 3 END AS triggering_n, k5 >= 5 OR k4 >= 4 OR k3 >= 3 AS is_stable FROM k""",
)
def grf_5b(spark, d):
    """A model counts at a cutoff from which on its chains are one graph: the largest step of its best spanning tree."""
    x = v.pairwise_n(spark, d).where("size(combo) > 0 AND pred_id IS NOT NULL AND rank IS NOT NULL")
    models = x.select("combo", "pred_id", "rank", F.size("combo").alias("n")).distinct()
    links = x.where("c1 IS NOT NULL AND c2 IS NOT NULL").select("combo", "pred_id", "rank", m.chain_index(F.col("c1")).alias("a"), m.chain_index(F.col("c2")).alias("b"), F.col("min_pae").alias("pae"))
    ranks = g.connecting_pae(links, models, ["combo", "pred_id", "rank"]).select("combo", F.struct("pred_id", "rank").alias("rank"), "pae")
    return g.dynamic_stability(ranks, ["combo"], [(12.96, 5), (10.53, 4), (7.21, 3)]).withColumn("combo", _combo())


@query(
    "grf_6_all_chains_supported",
    f"""WITH {v.PWN}, e AS (SELECT pred_id, rank, unnest([c1, c2]) AS chain, min_pae <= 7.5 AS ok FROM pwn WHERE pred_id IS NOT NULL), r AS (SELECT pred_id, chain, rank, coalesce(bool_or(ok), false) AS ok FROM e WHERE chain IS NOT NULL GROUP BY 1, 2, 3),
    c AS (SELECT pred_id, chain, count(*) FILTER (WHERE ok) AS n FROM r GROUP BY 1, 2) SELECT pred_id, bool_and(n >= 4) AS is_stable, count(*) AS n_chains FROM c GROUP BY 1""",
)
def grf_6(spark, d):
    return g.all_chains_supported(v.pairwise_n(spark, d).where("pred_id IS NOT NULL"), ["pred_id"])


_HOMO = f"""{v.PW2}, {v.PWN}, h0 AS (SELECT combo[1] AS protein, len(combo) AS n, count(DISTINCT rank) FILTER (WHERE min_pae <= 7.5) >= 4 AS stable FROM pwn WHERE combo IS NOT NULL AND len(list_distinct(combo)) = 1 AND len(combo) > 1 GROUP BY 1, 2),
    d2 AS (SELECT p1 AS protein, 2 AS n, count(DISTINCT rank) FILTER (WHERE min_pae <= 7.5) >= 4 AS stable FROM pw2 WHERE p1 = p2 GROUP BY 1), h AS (SELECT coalesce(d2.protein, h0.protein) AS protein, coalesce(d2.n, h0.n) AS n, coalesce(d2.stable, h0.stable) AS stable FROM h0 FULL JOIN d2 ON d2.protein = h0.protein AND d2.n = h0.n),
    s AS (SELECT protein, unnest(range(2, max(n) + 2))::INT AS n FROM h GROUP BY 1), homo AS (SELECT s.protein, s.n, h.stable IS NOT NULL AS tested, h.stable FROM s LEFT JOIN h ON s.protein = h.protein AND s.n = h.n)"""


@query("grf_7_homo_states", f"WITH {_HOMO} SELECT protein, n, tested, stable FROM homo")
def grf_7(spark, d):
    """Size 2 by the 2-mers of a protein with itself, where there are any."""
    dimers = v.pairwise2(spark, d).where("p1 = p2").groupBy(F.col("p1").alias("protein")).agg((F.count_distinct(F.when(F.col("min_pae") <= 7.5, F.col("rank"))) >= 4).alias("stable"))
    return la.homo_states(v.pairwise_n(spark, d).where("combo IS NOT NULL"), dimers=dimers)


@query(
    "grf_7_breaks",
    f"WITH {_HOMO}, b AS (SELECT *, NOT coalesce(stable, true) AND coalesce(lag(stable) OVER (PARTITION BY protein ORDER BY n), true) AS broken FROM homo) SELECT protein, min(n) FILTER (WHERE broken) AS first_break, min(n) FILTER (WHERE NOT tested) AS first_untested FROM b GROUP BY 1",
)
def grf_7b(spark, d):
    return la.homo_breaks(grf_7(spark, d))


@query(
    "grf_8_multivalency_states",
    _CON5 + """, pr AS (SELECT DISTINCT a, b, combo FROM model WHERE list_sort(list_distinct(combo)) = list_sort(list_distinct([p1, p2])))
    SELECT a, b, array_to_string(pr.combo, '|') AS combo, n_ranks >= 4 AS is_stable FROM pr JOIN st ON st.combo = pr.combo""",
)
def grf_8(spark, d):
    """Stability (GRF-5) of the combinations that hold nothing but the two proteins of a pair."""
    own = F.array_sort(F.array_distinct("combo")) == F.array_sort(F.array_distinct(F.array("p1", "p2")))
    pairs = _models(spark, d).where(own).select("a", "b", _combo()).distinct()
    return pairs.join(grf_5(spark, d).select("combo", "is_stable"), "combo").select("a", "b", "combo", "is_stable")


@query("grf_9_layout_weights", _FREQ + " SELECT a, b, round(sum((CASE WHEN n2 > 0 THEN k2 / n2 ELSE 0 END) / 50 + (CASE WHEN nn > 0 THEN kn / nn ELSE 0 END) * 49 / 50), 6) AS weight FROM k JOIN n USING (a, b) GROUP BY 1, 2")
def grf_9(spark, d):
    return _frequency(spark, d).groupBy("a", "b").agg(F.round(F.sum(g.layout_weights(F.col("freq2"), F.col("freqn"))), 6).alias("weight"))


@query("grf_10_edge_lookup", _AGG1 + " SELECT p1, p2, n_models FROM f3 WHERE p1 IN (SELECT prot_id FROM proteins WHERE ord = 0) OR p2 IN (SELECT prot_id FROM proteins WHERE ord = 0)")
def grf_10(spark, d):
    first = table(spark, d, "proteins").where("ord = 0").select("prot_id")
    e = passing2(spark, d).select("p1", "p2", "n_models")
    hit = e.join(first, F.col("p1") == F.col("prot_id"), "left_semi").unionByName(e.join(first, F.col("p2") == F.col("prot_id"), "left_semi"))
    return hit.distinct()


_EDGES = _FREQ + f""", kc AS (SELECT a, b, count(*) FILTER (WHERE kn > 0) AS n_cells FROM k GROUP BY 1, 2), {v.PW2}, {v.PWN}, e2 AS (SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, count(*) FILTER (WHERE min_pae <= 7.5) >= 4 AS hit FROM pw2 GROUP BY 1, 2),
en AS (SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, count(DISTINCT rank) FILTER (WHERE min_pae <= 7.5) >= 4 AS hit, avg(coalesce(contains(cluster, '✔'), false)::INT) AS variation FROM pwn GROUP BY 1, 2),
e AS (SELECT coalesce(e2.a, en.a) AS a, coalesce(e2.b, en.b) AS b, e2.hit IS NOT NULL AS t2, en.hit IS NOT NULL AS tn, coalesce(e2.hit, false) AS i2, coalesce(en.hit, false) AS i_n, coalesce(variation, 0) AS v, coalesce(kc.n_cells, 0) AS k FROM e2 FULL JOIN en ON e2.a = en.a AND e2.b = en.b LEFT JOIN kc ON kc.a = coalesce(e2.a, en.a) AND kc.b = coalesce(e2.b, en.b))"""
_CLASS = """CASE WHEN NOT t2 THEN 'No 2-mers Data' WHEN NOT tn AND i2 THEN 'No N-mers Data' WHEN NOT tn THEN 'Indirect' WHEN i2 AND NOT i_n THEN 'Strong Negative' WHEN i2 THEN CASE WHEN v = 1 THEN 'Static' WHEN v >= 0.5 THEN 'Weak Negative' ELSE 'Negative' END
WHEN NOT i_n THEN 'Indirect' WHEN k <= 5 THEN 'Indirect' WHEN v = 1 THEN 'Strong Positive' WHEN v >= 0.5 THEN 'Positive' ELSE 'Weak Positive' END"""


def _edge_features(spark, d):
    hits = F.col("min_pae") <= 7.5
    e2 = v.pairwise2(spark, d).groupBy(*ab()).agg((F.count_if(hits) >= 4).alias("h2"))
    ok = F.coalesce(F.contains("cluster", F.lit("✔")), F.lit(False)).cast("double")
    en = v.pairwise_n(spark, d).groupBy(*ab()).agg((F.count_distinct(F.when(hits, F.col("rank"))) >= 4).alias("hn"), F.avg(ok).alias("variation"))
    cells = _frequency(spark, d).groupBy("a", "b").agg(F.count_if(F.col("freqn") > 0).alias("n_contacts"))
    x = e2.join(en, ["a", "b"], "full_outer").join(cells, ["a", "b"], "left")
    no = F.lit(False)
    return x.select("a", "b", F.col("h2").isNotNull().alias("tested2"), F.col("hn").isNotNull().alias("tested_n"), F.coalesce("h2", no).alias("in2"), F.coalesce("hn", no).alias("in_n"), F.coalesce("variation", F.lit(0.0)).alias("variation"), F.coalesce("n_contacts", F.lit(0)).alias("n_contacts"))


@query("cls_1_edge_dynamics", _EDGES + f" SELECT a, b, {_CLASS} AS dynamics FROM e")
def cls_1(spark, d):
    return g.classify_edges(_edge_features(spark, d), g.default_rules(spark)).select("a", "b", "dynamics")


@query("jn_10_rule_join", _EDGES + f" SELECT {_CLASS} AS dynamics, count(*) AS n_edges FROM e GROUP BY 1")
def jn_10(spark, d):
    return cls_1(spark, d).groupBy("dynamics").agg(F.count("*").alias("n_edges"))


@query("flt_8_direct_edges", _EDGES + f" SELECT a, b FROM e WHERE {_CLASS} <> 'Indirect'")
def flt_8(spark, d):
    return cls_1(spark, d).where("dynamics <> 'Indirect'").select("a", "b")


_STATES = f"{v.PWN}, states AS (SELECT combo, count(DISTINCT rank) FILTER (WHERE min_pae <= 7.5) >= 4 AS is_stable FROM pwn WHERE combo IS NOT NULL AND len(combo) > 0 GROUP BY 1)"
_EDGE1 = """, del AS (SELECT DISTINCT combo AS child, list_filter(combo, lambda x, i: i <> k) AS parent FROM (SELECT combo, unnest(range(1, len(combo) + 1)) AS k FROM states)), le AS (SELECT parent, child FROM del WHERE parent IN (SELECT combo FROM states))"""


def _states(spark, d):
    x = v.pairwise_n(spark, d).where("combo IS NOT NULL AND size(combo) > 0")
    return x.groupBy("combo").agg((F.count_distinct(F.when(F.col("min_pae") <= 7.5, F.col("rank"))) >= 4).alias("is_stable"))


def _text(*names):
    return [F.array_join(n, "|").alias(n) for n in names]


@query("jn_16_containment", "WITH " + _STATES + _EDGE1 + " SELECT array_to_string(parent, '|') AS parent, array_to_string(child, '|') AS child, 1 AS order_jump FROM le")
def jn_16(spark, d):
    return la.containment_edges(_states(spark, d)).select(*_text("parent", "child"), "order_jump")


_EDGE2 = _EDGE1 + """, del2 AS (SELECT DISTINCT child, list_filter(parent, lambda x, i: i <> k) AS parent FROM (SELECT child, parent, unnest(range(1, len(parent) + 1)) AS k FROM del WHERE len(parent) > 1)), le2 AS (SELECT parent, child FROM del2 WHERE parent IN (SELECT combo FROM states))"""


@query(
    "jn_17_unbridged",
    "WITH " + _STATES + _EDGE2 + """ SELECT array_to_string(parent, '|') AS parent, array_to_string(child, '|') AS child, 1 AS order_jump FROM le UNION ALL
    SELECT array_to_string(parent, '|'), array_to_string(child, '|'), 2 FROM le2 WHERE NOT EXISTS (SELECT 1 FROM le x JOIN le y ON x.child = y.parent JOIN states s ON s.combo = x.child AND s.is_stable WHERE x.parent = le2.parent AND y.child = le2.child)""",
)
def jn_17(spark, d):
    s = _states(spark, d)
    return la.unbridged(la.containment_edges(s, 2), s).select(*_text("parent", "child"), "order_jump")


@query(
    "lat_3_convergence",
    "WITH " + _STATES + _EDGE1 + """, k AS (SELECT parent AS combo, count(*) FILTER (WHERE s.is_stable) AS n_stable, count(*) FILTER (WHERE NOT s.is_stable) AS n_unstable FROM le JOIN states s ON s.combo = le.child GROUP BY 1)
    SELECT array_to_string(states.combo, '|') AS combo, coalesce(n_stable, 0) AS n_stable, coalesce(n_unstable, 0) AS n_unstable, CASE WHEN is_stable AND n_stable IS NULL THEN NULL WHEN NOT is_stable THEN false WHEN n_stable > 0 THEN false ELSE true END AS is_convergent FROM states LEFT JOIN k ON k.combo = states.combo""",
)
def lat_3(spark, d):
    s = _states(spark, d)
    return la.convergence(s, la.containment_edges(s)).select(*_text("combo"), "n_stable", "n_unstable", "is_convergent")


_PPI = """, pe AS (SELECT p1, p2 FROM pw2 WHERE min_pae <= 7.5 AND iptm >= 0 GROUP BY 1, 2 HAVING count(*) >= 4 UNION SELECT p1, p2 FROM (SELECT p1, p2, combo, rank, min(min_pae) AS mp, max(pdockq) AS pq FROM pwn WHERE combo IS NOT NULL GROUP BY ALL) WHERE mp <= 7.5 AND pq >= 0 GROUP BY p1, p2, combo HAVING count(*) >= 4),
ed AS (SELECT p1 AS m, p2 AS x FROM pe UNION SELECT p2, p1 FROM pe)"""
_GROWN = f"{v.PW2}, " + _STATES + _PPI + """, sm AS (SELECT combo, unnest(list_distinct(combo)) AS m FROM states WHERE is_stable), grown AS (SELECT DISTINCT list_sort(list_append(combo, x)) AS combo, combo AS origin FROM sm JOIN ed USING (m) WHERE NOT list_contains(combo, x) OR len(combo) + 1 < 5),
cand AS (SELECT combo, count(DISTINCT origin) AS n_stable_parents FROM grown WHERE combo NOT IN (SELECT combo FROM states) GROUP BY 1)"""


def _ppi(spark, d):
    """Interacting pairs of 2-mers and N-mers."""
    return passing2(spark, d).select("p1", "p2").unionByName(passing_n(spark, d).select("p1", "p2")).distinct()


@query("lat_1_candidates", "WITH " + _GROWN + " SELECT array_to_string(combo, '|') AS combo, n_stable_parents FROM cand")
def lat_1(spark, d):
    return la.candidates(_states(spark, d), _ppi(spark, d)).select(*_text("combo"), "n_stable_parents")


_NODES = "WITH " + _GROWN + """, del0 AS (SELECT DISTINCT list_filter(combo, lambda x, i: i <> k) AS combo FROM (SELECT combo, unnest(range(1, len(combo) + 1)) AS k FROM states WHERE len(combo) > 2)),
node AS (SELECT combo, any_value(is_stable) AS is_stable FROM (SELECT combo, is_stable FROM states UNION ALL SELECT combo, NULL FROM del0 WHERE combo NOT IN (SELECT combo FROM states) UNION ALL SELECT combo, NULL FROM cand) GROUP BY 1),
del1 AS (SELECT DISTINCT combo AS child, list_filter(combo, lambda x, i: i <> k) AS parent FROM (SELECT combo, unnest(range(1, len(combo) + 1)) AS k FROM node)), ln AS (SELECT parent, child FROM del1 WHERE parent IN (SELECT combo FROM node))"""


def _nodes(spark, d):
    """Tested combinations, and untested ones next to them: those with a member less, and the candidates."""
    s = _states(spark, d)
    less = la.parents(s.where(F.size("combo") > 2)).select(F.col("parent").alias("combo"))
    more = la.candidates(s, _ppi(spark, d)).select("combo")
    open_ = less.unionByName(more).distinct().join(s.select("combo"), "combo", "left_anti")
    return s.unionByName(open_.withColumn("is_stable", F.lit(None).cast("boolean")))


@query(
    "lat_4_transitions",
    _NODES + """ SELECT CASE WHEN p.is_stable THEN 'Stable' WHEN p.is_stable IS NULL THEN 'Untested' ELSE 'Unstable' END || '->' || CASE WHEN c.is_stable THEN 'Stable' WHEN c.is_stable IS NULL THEN 'Untested' ELSE 'Unstable' END AS category, count(*) AS n_edges FROM ln JOIN node p ON p.combo = ln.parent JOIN node c ON c.combo = ln.child GROUP BY 1""",
)
def lat_4(spark, d):
    """Edges between tested combinations and untested ones next to them, in up to nine categories."""
    s = _nodes(spark, d)
    return la.transitions(la.containment_edges(s), s).groupBy("category").agg(F.count("*").alias("n_edges"))


@query(
    "lat_4_connections",
    "WITH " + _STATES + _EDGE2 + """, u AS (SELECT parent, child, 1 AS j FROM le UNION ALL SELECT parent, child, 2 FROM le2), k AS (SELECT parent, child, j, unnest(list_distinct(child)) AS p FROM u),
    ad AS (SELECT parent, child, j, list_sort(flatten(list(list_transform(range(len(list_filter(child, lambda q: q = p)) - len(list_filter(parent, lambda q: q = p))), lambda z: p)))) AS added FROM k GROUP BY ALL)
    SELECT j AS order_jump, CASE WHEN len(added) = 1 THEN 'monomer_addition' WHEN s.is_stable THEN 'stable_2mer_addition' WHEN NOT s.is_stable THEN 'unstable_2mer_addition' ELSE 'complex_addition' END AS connection, count(*) AS n_edges FROM ad LEFT JOIN states s ON s.combo = ad.added GROUP BY 1, 2""",
)
def lat_4b(spark, d):
    s = _states(spark, d)
    edges = la.transitions(la.containment_edges(s, 2), s)
    return la.connection_types(edges, s).groupBy("order_jump", "connection").agg(F.count("*").alias("n_edges"))


@query("lat_2_decomposable")
def lat_2(spark, d):
    """Whether each stable combination of more than three is a sum of stable 3-mers, taken in order.

    Only the 3-mers within a combination can be parts of it: they come from its own members by an equi join.
    """
    s = _states(spark, d).where("is_stable")
    big = s.where(F.size("combo") > 3).select("combo")
    i = big.select("combo", F.posexplode("combo").alias("i", "x"))
    j = i.select("combo", "i", "x", F.posexplode("combo").alias("j", "y")).where("i < j")
    three = j.select("combo", "x", "y", "j", F.posexplode("combo").alias("k", "z")).where("j < k").select("combo", F.array("x", "y", "z").alias("kmer")).distinct()
    stable = s.where(F.size("combo") == 3).select(F.col("combo").alias("kmer"))
    known = three.join(stable, "kmer", "left_semi").groupBy("combo").agg(F.array_sort(F.collect_list("kmer")).alias("kmers"))

    @F.pandas_udf("boolean")
    def fits(combos: pd.Series, kmers: pd.Series) -> pd.Series:
        parts = [[tuple(k) for k in ks] if ks is not None else [] for ks in kmers]
        return pd.Series([la.decomposable({p: list(x).count(p) for p in x}, k) for x, k in zip(combos, parts, strict=True)], dtype=bool)

    return big.join(known, "combo", "left").select(*_text("combo"), fits("combo", "kmers").alias("decomposable"))


@query(
    "lat_6_suggestions",
    _AGG10 + ", mv AS (SELECT a, b FROM f WHERE greatest(fraction_3, fn) >= 0.2), " + _GROWN + ", " + _HOMO[_HOMO.index("h0 AS"):] + """, tp AS (SELECT protein, max(n) AS top FROM homo WHERE tested GROUP BY 1), pp AS (SELECT DISTINCT least(p1, p2) AS a, greatest(p1, p2) AS b FROM pe WHERE p1 <> p2),
    own AS (SELECT combo, combo[1] AS a, combo[len(combo)] AS b FROM states WHERE is_stable AND len(combo) > 1 AND len(list_filter(combo, lambda p: p <> combo[1] AND p <> combo[len(combo)])) = 0), lg AS (SELECT a, b, arg_max(combo, (len(combo), combo)) AS combo FROM own SEMI JOIN mv USING (a, b) GROUP BY 1, 2),
    sg AS (SELECT list_append(combo, combo[1]) AS combo, 'homo N+1' AS reason FROM states WHERE is_stable AND len(list_distinct(combo)) = 1
    UNION ALL SELECT combo, 'neighbour' FROM cand WHERE len(combo) <= 3 OR list_max(list_transform(list_distinct(combo), lambda p: len(list_filter(combo, lambda q: q = p)))) <= 2
    UNION ALL SELECT list_transform(range(n), lambda z: homo.protein), 'missing homo' FROM homo JOIN tp USING (protein) WHERE NOT tested AND n < top
    UNION ALL SELECT unnest([[a, a, b], [a, b, b]]), 'expanded 3-mer' FROM pp ANTI JOIN mv USING (a, b) UNION ALL SELECT unnest([list_sort(list_append(combo, a)), list_sort(list_append(combo, b))]), 'multivalent child' FROM lg)
    SELECT array_to_string(combo, '|') AS combo, min(reason) AS reason FROM sg WHERE combo NOT IN (SELECT combo FROM states) GROUP BY combo""",
)
def lat_6(spark, d):
    s = _states(spark, d)
    return la.suggestions(_ppi(spark, d), s, s, grf_7(spark, d), agg_11(spark, d)).select(*_text("combo"), "reason")


@query("lat_7_bootstrap", "SELECT prot_id AS item, count(*) OVER () - row_number() OVER (ORDER BY prot_id) + 1 AS n_partners, 0 AS n_done, count(*) OVER () - row_number() OVER (ORDER BY prot_id) + 1 AS n_left FROM proteins")
def lat_7(spark, d):
    """All 2-mers of the proteins, as the number of pairs that each protein comes first in."""
    p = table(spark, d, "proteins").select("prot_id")
    return la.open_pairs(p, spark.createDataFrame([], "p1 string, p2 string"))


# --- reports ---


@query("rep_2_stability_profiles", f"WITH {v.PWN} SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, rank, round(avg(min_pae), 8) AS mean, round(stddev_samp(min_pae), 8) AS sd, count(*) AS n FROM pwn GROUP BY 1, 2, 3")
def rep_2(spark, d):
    return v.pairwise_n(spark, d).groupBy(*ab(), "rank").agg(F.round(F.avg("min_pae"), 8).alias("mean"), F.round(F.stddev_samp("min_pae"), 8).alias("sd"), F.count("*").alias("n"))


@query("rep_3_bars", "WITH " + _SIZES + " SELECT protein, n, repeat('#', least(k, 40)::INT) || ' ' || k AS bar FROM r")
def rep_3(spark, d):
    return _sizes(spark, d).select("protein", "n", F.concat(F.repeat(F.lit("#"), F.least("k", F.lit(40)).cast("int")), F.lit(" "), F.col("k").cast("string")).alias("bar"))


@query("rep_5_edge_summary", _FREQ + " SELECT a, b, count(*) AS n_cells, round(avg(k / n), 8) AS mean_freq, any_value(n) AS n_models FROM k JOIN n USING (a, b) GROUP BY 1, 2")
def rep_5(spark, d):
    n = v.shapes(spark, d).groupBy("a", "b").agg(F.count_distinct("matrix_id").alias("n_models"))
    f = _frequency(spark, d).groupBy("a", "b").agg(F.count("*").alias("n_cells"), F.round(F.avg("freq"), 8).alias("mean_freq"))
    return f.join(n, ["a", "b"])
