"""Queries of profiles, references and labels: per pair, protein, residue and model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chainlake.functions import geometry as geo
from chainlake.functions import metrics as m
from chainlake.operators import contacts as c
from chainlake.operators import ppi, series
from chainlake.plans import catalog, explorations  # noqa: F401  (its SQL is used below)
from chainlake.plans import views as v
from chainlake.plans.catalog import query, table
from chainlake.plans.relations import _FILE_PAIRS, _combo, ab, agg_13, agg_19, passing2, win_1b
from chainlake.plans.structures import _CON5, _PRESENT, _chain_points, cls_1, clu_3, clu_4, clu_7, grf_8, mat_7, sta_1
from chainlake.sources import text_files as tf
from chainlake.storage import Scratch


# --- references and profiles of PAE and pLDDT ---


@query(
    "agg_4_pae_reference",
    f"""WITH {v.CELLS}, s AS (SELECT matrix_id, least(p1, p2) AS a, greatest(p1, p2) AS b, round(sum(pae), 3) AS total FROM cell WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND pae IS NOT NULL GROUP BY 1, 2, 3)
    SELECT a, b, arg_min(matrix_id, (total, matrix_id)) AS lowest, arg_min(matrix_id, (-total, matrix_id)) AS highest, count(*) AS n_records FROM s GROUP BY 1, 2""",
)
def agg_4b(spark, d):
    """Records of each pair with the lowest and the highest sum of PAE."""
    cells = v.cells(spark, d).where("p1 IS NOT NULL AND p2 IS NOT NULL AND pae IS NOT NULL")
    s = cells.groupBy("matrix_id", *ab()).agg(F.round(F.sum("pae"), 3).alias("total"))
    return s.groupBy("a", "b").agg(F.min_by("matrix_id", F.struct("total", "matrix_id")).alias("lowest"), F.min_by("matrix_id", F.struct(-F.col("total"), "matrix_id")).alias("highest"), F.count("*").alias("n_records"))


@query(
    "agg_4_mean_pae",
    f"""WITH {v.CELLS} SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, CASE WHEN p1 > p2 THEN j ELSE i END AS i, CASE WHEN p1 > p2 THEN i ELSE j END AS j, round(avg(pae), 6) AS pae, count(*) AS n FROM cell WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND pae IS NOT NULL GROUP BY ALL""",
)
def agg_4c(spark, d):
    """Mean PAE matrix of each pair, cell by cell, rows belonging to the smaller ID."""
    turn = F.col("p1") > F.col("p2")
    cells = v.cells(spark, d).where("p1 IS NOT NULL AND p2 IS NOT NULL AND pae IS NOT NULL")
    at = F.when(turn, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turn, F.col("i")).otherwise(F.col("j")).alias("j")
    return cells.groupBy(*ab(), *at).agg(F.round(F.avg("pae"), 6).alias("pae"), F.count("*").alias("n"))


@query(
    "prj_4_pae_block",
    f"""WITH {v.CELLS}, o AS (SELECT matrix_id, least(p1, p2) AS a, greatest(p1, p2) AS b, rank, n_chains, p1 > p2 AS turned, i, j, pae FROM cell WHERE p1 <> p2 AND pae IS NOT NULL),
    s AS (SELECT a, b, rank, n_chains, CASE WHEN turned THEN j ELSE i END AS i, CASE WHEN turned THEN i ELSE j END AS j, min(pae) FILTER (WHERE NOT turned) AS f, min(pae) FILTER (WHERE turned) AS r FROM o WHERE rank IS NOT NULL AND n_chains IS NOT NULL GROUP BY ALL)
    SELECT a, b, rank, n_chains, count(*) AS n_cells, round(min(least(f, r)), 6) AS least, round(avg(least(f, r)), 6) AS mean FROM s WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def prj_4b(spark, d):
    """The block of two chains given in both directions, symmetrised: the smaller of a cell and of its mirror, over the records of a pair, rank and size of model."""
    turned = F.col("p1") > F.col("p2")
    cells = v.cells(spark, d).where("p1 <> p2 AND pae IS NOT NULL AND rank IS NOT NULL AND n_chains IS NOT NULL")
    at = F.when(turned, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turned, F.col("i")).otherwise(F.col("j")).alias("j")
    s = cells.groupBy(*ab(), "rank", "n_chains", *at).agg(F.min(F.when(~turned, F.col("pae"))).alias("f"), F.min(F.when(turned, F.col("pae"))).alias("r")).where("f IS NOT NULL AND r IS NOT NULL")
    low = F.least("f", "r")
    return s.groupBy("a", "b", "rank", "n_chains").agg(F.count("*").alias("n_cells"), F.round(F.min(low), 6).alias("least"), F.round(F.avg(low), 6).alias("mean"))


@query(
    "prj_22_closest_residues",
    f"""WITH {v.CELLS} SELECT matrix_id, arg_min(i, (round(pae, 6), i, j)) AS i, arg_min(j, (round(pae, 6), i, j)) AS j, round(min(pae), 6) AS pae, arg_min(round(plddt, 6), (round(pae, 6), i, j)) AS plddt FROM cell WHERE pae IS NOT NULL AND plddt IS NOT NULL GROUP BY 1""",
)
def prj_22b(spark, d):
    """Residue pair of the least PAE of each record, with its PAE and the smaller pLDDT of the two."""
    cells = v.cells(spark, d).where("pae IS NOT NULL AND plddt IS NOT NULL")
    best = cells.groupBy("matrix_id").agg(F.min(F.struct(F.round("pae", 6).alias("pae"), "i", "j", F.round("plddt", 6).alias("plddt"))).alias("x"))
    return best.select("matrix_id", "x.i", "x.j", "x.pae", "x.plddt")


@query(
    "agg_16_chain_plddts",
    f"""WITH {v.ATOMS}, {v.CHAINS}, cm AS (SELECT file_id, chain, ((sum(round(bfactor * 100)::BIGINT)::BIGINT * 200 + count(*)) // (2 * count(*))) / 10000 AS p FROM atom WHERE atom_name = 'CA' AND bfactor IS NOT NULL GROUP BY 1, 2), k AS (SELECT file_id, rank, list_sort(list(prot_id)) AS combo FROM chain WHERE prot_id IS NOT NULL GROUP BY 1, 2)
    SELECT cm.file_id, rank, array_to_string(combo, '|') AS combo, string_agg(format('{{:.4f}}', p), ',' ORDER BY chain) AS plddts FROM cm JOIN k USING (file_id) GROUP BY 1, 2, k.combo""",
)
def agg_16b(spark, d):
    """Mean CA pLDDT of each chain of each model, in order of chains; halves are rounded up in whole hundredths, so the text doesn't depend on the order of sums."""
    combos = v.chains(spark, d).where("prot_id IS NOT NULL").groupBy("file_id", "rank").agg(F.array_sort(F.collect_list("prot_id")).alias("combo"))
    sums = v.atoms(spark, d).where("atom_name = 'CA' AND bfactor IS NOT NULL").groupBy("file_id", "chain").agg(F.sum(F.round(F.col("bfactor") * 100).cast("bigint")).alias("s"), F.count("*").alias("n"))
    means = sums.select("file_id", "chain", (F.expr("(s * 200 + n) DIV (2 * n)") / 10000).alias("p"))
    rows = means.join(combos, "file_id").groupBy("file_id", "rank", "combo").agg(F.array_sort(F.collect_list(F.struct("chain", "p"))).alias("l"))
    return rows.select("file_id", "rank", _combo(), F.array_join(F.transform("l", lambda x: F.format_string("%.4f", x["p"])), ",").alias("plddts"))


@query("rep_2_plddt_profiles", f"WITH {v.ATOMS}, {v.CHAINS}, {_FILE_PAIRS}, r AS (SELECT fp.*, bfactor FROM fp JOIN chain c ON c.file_id = fp.file_id JOIN atom t ON t.file_id = c.file_id AND t.chain = c.chain_id WHERE atom_name = 'CA' AND c.prot_id IS NOT NULL) SELECT a, b, array_to_string(combo, '|') AS combo, rank, round(avg(bfactor), 6) AS mean, round(median(bfactor), 6) AS median, round(quantile_cont(bfactor, 0.25), 6) AS q1, round(quantile_cont(bfactor, 0.75), 6) AS q3 FROM r GROUP BY a, b, r.combo, rank")
def rep_2b(spark, d):
    """Stability profile of the residues of all proteins of a combination, by rank."""
    return agg_13(spark, d).where("side = 'general'").select("a", "b", "combo", "rank", *(F.round(x, 6).alias(x) for x in ("mean", "median", "q1", "q3")))


@query("snk_6_residue_profile", f"WITH {v.ATOMS}, {v.CHAINS}, r AS (SELECT prot_id, res_no, round(avg(bfactor), 8) AS mean, round(stddev_pop(bfactor) / (avg(bfactor) + 1e-8), 8) AS cv FROM atom a JOIN chain c ON c.file_id = a.file_id AND c.chain_id = a.chain WHERE prot_id IS NOT NULL AND res_no IS NOT NULL GROUP BY 1, 2) SELECT prot_id, count(*) AS n_residues, round(sum(mean), 4) AS mean_total, round(sum(cv), 4) AS cv_total FROM r GROUP BY 1")
def snk_6b(spark, d):
    """Mean and coefficient of variation of each residue as JSON objects of a protein, read back."""
    rows = agg_19(spark, d).where("res_no IS NOT NULL")
    js = tf.residue_json(rows, "prot_id", "res_no", "mean").withColumnRenamed("json", "mean").join(tf.residue_json(rows, "prot_id", "res_no", "cv").withColumnRenamed("json", "cv"), "prot_id")
    values = {n: F.map_values(F.from_json(n, "map<string,double>")) for n in ("mean", "cv")}
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), 4)
    return js.select("prot_id", F.size(values["mean"]).cast("bigint").alias("n_residues"), total(values["mean"]).alias("mean_total"), total(values["cv"]).alias("cv_total"))


# --- labels and series ---

_MPNQ = "string_agg(CASE WHEN a = b THEN n || 'P' ELSE k || 'P' || (n - k) || 'Q' END || CASE WHEN is_stable THEN '' ELSE 'f' END, '|' ORDER BY n, k)"


@query(
    "prj_11_multivalency_labels",
    _CON5 + f""", pr AS (SELECT DISTINCT a, b, combo FROM model WHERE list_sort(list_distinct(combo)) = list_sort(list_distinct([p1, p2]))), s AS (SELECT a, b, len(pr.combo) AS n, len(list_filter(pr.combo, lambda q: q = a)) AS k, n_ranks >= 4 AS is_stable FROM pr JOIN st ON st.combo = pr.combo)
    SELECT a, b, {_MPNQ} AS states FROM s GROUP BY 1, 2""",
)
def prj_11b(spark, d):
    """Multivalency states of each pair as m copies of the first and n of the second protein (mPnQ), with f where unstable."""
    x = grf_8(spark, d).withColumn("l", F.split("combo", "\\|"))
    n, k = F.size("l"), F.size(F.filter("l", lambda q: q == F.col("a")))
    text = F.when(F.col("a") == F.col("b"), F.concat(n.cast("string"), F.lit("P"))).otherwise(F.concat(k.cast("string"), F.lit("P"), (n - k).cast("string"), F.lit("Q")))
    one = F.struct(n.alias("n"), k.alias("k"), F.concat(text, F.when(F.col("is_stable"), "").otherwise("f")).alias("t"))
    return x.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda y: y["t"]), "|").alias("states"))


@query("rep_3_phi_bars", "WITH " + _PRESENT + ", r AS (SELECT a, b, partner, (n11::DOUBLE*n00 - n10::DOUBLE*n01) / sqrt((n11+n10)::DOUBLE*(n01+n00)*(n11+n01)*(n10+n00)) AS phi FROM n WHERE (n11+n10)::DOUBLE*(n01+n00)*(n11+n01)*(n10+n00) > 0) SELECT a, b, partner, CASE WHEN phi < 0 THEN '-' ELSE '+' END || repeat('#', round(abs(round(phi, 8)) * 20)::INT) AS bar FROM r")
def rep_3b(spark, d):
    """phi of each partner as a bar of up to twenty characters with its sign."""
    x = sta_1(spark, d).where("phi IS NOT NULL")
    return x.select("a", "b", "partner", F.concat(F.when(F.col("phi") < 0, "-").otherwise("+"), F.repeat(F.lit("#"), F.round(F.abs("phi") * 20).cast("int"))).alias("bar"))


@query("win_4_trajectory_average", "WITH " + v.TRAJECTORY + " SELECT protein, row_id, round(CASE WHEN count(*) OVER w = 5 THEN avg(min_pae) OVER w END, 8) AS mean_value FROM traj WINDOW w AS (PARTITION BY protein ORDER BY min_pae, row_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win_4b(spark, d):
    """Moving average of the PAE along each protein's ordered models."""
    return series.moving_average(v.trajectory(spark, d).select("protein", "row_id", "min_pae"), "min_pae", ["protein"], ["min_pae", "row_id"], 5).select("protein", "row_id", F.round("mean_value", 8).alias("mean_value"))


_BANDS = "CASE WHEN bfactor > 90 THEN 'very high' WHEN bfactor > 70 THEN 'high' WHEN bfactor > 50 THEN 'low' ELSE 'very low' END"


@query(
    "win_7_band_islands",
    f"""WITH {v.ATOMS}, r0 AS (SELECT file_id, chain, res_no, arg_min({_BANDS}, line) AS l FROM atom WHERE atom_name = 'CA' AND bfactor IS NOT NULL AND res_no IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT *, CASE WHEN lag(l) OVER w IS NOT DISTINCT FROM l AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM r0 WINDOW w AS (PARTITION BY file_id, chain ORDER BY res_no)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY file_id, chain ORDER BY res_no ROWS UNBOUNDED PRECEDING) AS run FROM c), s AS (SELECT file_id, chain, run, count(*) AS n, min(l) AS l FROM r GROUP BY 1, 2, 3),
    f AS (SELECT file_id, chain, run, CASE WHEN lag(l) OVER w = lead(l) OVER w AND n <= 1 THEN lag(l) OVER w ELSE l END AS merged FROM s WINDOW w AS (PARTITION BY file_id, chain ORDER BY run)), g AS (SELECT r.file_id, r.chain, res_no, merged FROM r JOIN f USING (file_id, chain, run)),
    h AS (SELECT *, CASE WHEN lag(merged) OVER w IS NOT DISTINCT FROM merged AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM g WINDOW w AS (PARTITION BY file_id, chain ORDER BY res_no)) SELECT file_id, chain, res_no, merged, sum(c) OVER (PARTITION BY file_id, chain ORDER BY res_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM h""",
)
def win_7b(spark, d):
    """Stretches of residues of one confidence band in each chain; single residues between two stretches of a band join them."""
    a = v.atoms(spark, d).where("atom_name = 'CA' AND bfactor IS NOT NULL AND res_no IS NOT NULL")
    rows = a.groupBy("file_id", "chain", "res_no").agg(F.min_by(m.plddt_band(F.col("bfactor")), "line").alias("band"))
    return series.merge_loops(rows, ["file_id", "chain"], ["res_no"], "band", 1).select("file_id", "chain", "res_no", "merged", "run")


_DOMAINS = "WITH isl AS (" + catalog._SQL["win_7_band_islands"] + f"), {v.ATOMS}, dom AS (SELECT i.file_id, i.chain, i.run AS domain, min(i.res_no) AS start, max(i.res_no) AS stop, round(avg(bfactor), 6) AS mean_plddt FROM isl i JOIN atom t ON t.file_id = i.file_id AND t.chain = i.chain AND t.res_no = i.res_no AND t.atom_name = 'CA' GROUP BY 1, 2, 3)"


@query("agg_18_domain_table", _DOMAINS + " SELECT file_id, chain, domain, start, stop, mean_plddt FROM dom")
def agg_18(spark, d):
    """Domains of each chain: stretches of one confidence band (WIN-7), with their ends and mean pLDDT."""
    a = v.atoms(spark, d).where("atom_name = 'CA'").select("file_id", "chain", "res_no", "bfactor")
    rows = win_7b(spark, d).join(a, ["file_id", "chain", "res_no"])
    return rows.groupBy("file_id", "chain", F.col("run").alias("domain")).agg(F.min("res_no").alias("start"), F.max("res_no").alias("stop"), F.round(F.avg("bfactor"), 6).alias("mean_plddt"))


@query("jn_8_residues_in_domains", _DOMAINS + " SELECT t.file_id, line, domain FROM atom t JOIN dom ON dom.file_id = t.file_id AND dom.chain = t.chain AND res_no BETWEEN start AND stop")
def jn_8(spark, d):
    """Atoms with the domain of their chain whose interval holds their residue."""
    dom = agg_18(spark, d).select("file_id", "chain", "domain", "start", "stop")
    return v.atoms(spark, d).join(dom, ["file_id", "chain"]).where(F.col("res_no").between(F.col("start"), F.col("stop"))).select("file_id", "line", "domain")


@query("mat_18_oscillations", "SELECT vec_id, i, round(i * 0.25, 8) AS x, round(0.1 * (label + 1) * sin(2 * pi() * 3 * i * 0.25), 8) AS line_y, round((1 + 0.1 * sin(2 * pi() * 8 * i * 0.25)) * cos(2 * pi() * i * 0.25 / 2), 8) AS circle_x, round((1 + 0.1 * sin(2 * pi() * 8 * i * 0.25)) * sin(2 * pi() * i * 0.25 / 2), 8) AS circle_y FROM embeddings, unnest(range(0, 9)) u(i)")
def mat_18b(spark, d):
    """Points of a line and of a circle that oscillate around their course."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>")).alias("i"))
    turn = 2 * np.pi
    t = F.col("i") * 0.25
    ring = 1 + 0.1 * F.sin(turn * 8 * t)
    return rows.select("vec_id", "i", F.round(t, 8).alias("x"), F.round(0.1 * (F.col("label") + 1) * F.sin(turn * 3 * t), 8).alias("line_y"), F.round(ring * F.cos(turn * t / 2), 8).alias("circle_x"), F.round(ring * F.sin(turn * t / 2), 8).alias("circle_y"))


# --- partners, clusters and edges ---


@query(
    "agg_20_enrichment_modes",
    f"""WITH {v.PWN}, t AS (SELECT p1 AS protein, combo, len(list_filter(combo, lambda q: q = p1)) AS k FROM pwn WHERE combo IS NOT NULL), o AS (SELECT protein, unnest(list_filter(combo, lambda q: q <> protein)) AS partner FROM t),
    e AS (SELECT 'no_repeat' AS mode, protein, partner FROM o UNION ALL SELECT 'single_repeat', protein, partner FROM o UNION ALL SELECT 'single_repeat', protein, protein FROM t WHERE k > 1 UNION ALL SELECT 'multiple_repeats', protein, partner FROM o UNION ALL SELECT 'multiple_repeats', protein, unnest(list_transform(range(k - 1), lambda z: protein)) FROM t WHERE k > 1),
    n AS (SELECT mode, protein, partner, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT mode, protein, partner AS representative, n FROM n QUALIFY row_number() OVER (PARTITION BY mode, protein ORDER BY n DESC, partner) = 1""",
)
def agg_20b(spark, d):
    """Most frequent partner of each protein when the protein itself counts not at all, once, or one time less than it is there."""
    x = v.pairwise_n(spark, d).where("combo IS NOT NULL").select(F.col("p1").alias("protein"), "combo")
    others = F.filter("combo", lambda q: q != F.col("protein"))
    again = F.greatest(m.copies(F.col("combo"), F.col("protein")) - 1, F.lit(0))
    modes = {"no_repeat": F.lit(0), "single_repeat": F.least(again, F.lit(1)), "multiple_repeats": again}
    each = F.array(*(F.struct(F.lit(k).alias("mode"), F.concat(others, F.array_repeat("protein", n)).alias("l")) for k, n in modes.items()))
    rows = x.select("protein", F.explode(each).alias("e")).select("protein", "e.mode", F.explode("e.l").alias("partner"))
    n = rows.groupBy("mode", "protein", "partner").agg(F.count("*").alias("n"))
    return ppi.best_rows(n, ["mode", "protein"], [F.col("n").desc(), F.col("partner")]).select("mode", "protein", F.col("partner").alias("representative"), "n")


@query("agg_20_cluster_enrichment")
def agg_20c(spark, d):
    """Most frequent partner of each pLDDT cluster of each protein."""
    files = v.chains(spark, d).where("prot_id IS NOT NULL").groupBy("file_id").agg(F.collect_list("prot_id").alias("combo"))
    x = clu_7(spark, d).join(files, "file_id")
    again = F.greatest(m.copies(F.col("combo"), F.col("prot_id")) - 1, F.lit(0))
    rows = x.select("prot_id", "cluster", F.explode(F.concat(F.filter("combo", lambda q: q != F.col("prot_id")), F.array_repeat("prot_id", again))).alias("partner"))
    n = rows.groupBy("prot_id", "cluster", "partner").agg(F.count("*").alias("n"))
    return ppi.best_rows(n, ["prot_id", "cluster"], [F.col("n").desc(), F.col("partner")]).select("prot_id", "cluster", F.col("partner").alias("representative"), "n")


@query("grf_3_edges_with_clusters")
def grf_3b(spark, d):
    """Edges with their contact clusters, one row a cluster; cluster -1 without contacts where an edge has none."""
    from pyspark.sql.window import Window

    e = passing2(spark, d).select(*ab()).distinct().join(clu_4(spark, d), ["a", "b"], "left")
    many = F.count("cluster_n").over(Window.partitionBy("a", "b")) > 1
    return e.select("a", "b", F.coalesce("cluster_n", F.lit(-1)).alias("cluster_n"), F.coalesce("n_models", F.lit(0)).alias("n_models"), "representative", many.alias("is_multivalent"))


@query("mat_16_cluster_groups")
def mat_16b(spark, d):
    """Interaction groups of residues where a surface is a pair and a contact cluster."""
    modes = clu_3(spark, d).select("matrix_id", F.col("label").alias("mode"))
    rows = v.contacts(spark, d).drop("rank")
    return c.residue_groups(rows.join(modes.select("matrix_id"), "matrix_id", "left_semi"), modes)


@query("rep_5_edge_report")
def rep_5b(spark, d):
    """Edges with class, number and sizes of their contact clusters and the partners with the strongest phi of each sign."""
    sizes = clu_4(spark, d).groupBy("a", "b").agg(F.count("*").alias("n_clusters"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_n", "n_models"))), lambda x: x["n_models"].cast("string")), ",").alias("cluster_sizes"))
    phi = sta_1(spark, d).where("phi IS NOT NULL")
    ends = phi.groupBy("a", "b").agg(F.max(F.struct("phi", "partner")).alias("hi"), F.min(F.struct("phi", "partner")).alias("lo"))
    return cls_1(spark, d).join(sizes, ["a", "b"], "left").join(ends, ["a", "b"], "left").select("a", "b", "dynamics", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), "cluster_sizes", F.col("hi.partner").alias("helps"), F.col("hi.phi").alias("phi_helps"), F.col("lo.partner").alias("hinders"), F.col("lo.phi").alias("phi_hinders"))


@query("rep_4_bias_page", "WITH b AS (" + catalog._SQL["win_1_bias_summary"] + "), s AS (" + catalog._SQL["rep_4_trajectory_summary"] + ") SELECT s.protein, n_models, best, largest, count(b.partner) AS n_partners, round(max(max_bias), 6) AS top_bias, arg_min(b.partner, (-round(max_bias, 6), b.partner)) AS top_partner FROM s LEFT JOIN b ON b.protein = s.protein AND b.width = 5 GROUP BY 1, 2, 3, 4")
def rep_4b(spark, d):
    """Trajectory page: models, best PAE, largest combination, and the partner with the largest bias in windows of five."""
    x = v.trajectory(spark, d).groupBy("protein").agg(F.count("*").alias("n_models"), F.round(F.min("min_pae"), 8).alias("best"), F.max(F.size("combo")).alias("largest"))
    b = win_1b(spark, d).where("width = 5").groupBy("protein").agg(F.count("*").alias("n_partners"), F.round(F.max("max_bias"), 6).alias("top_bias"), F.min_by("partner", F.struct(-F.round("max_bias", 6), "partner")).alias("top_partner"))
    return x.join(b, "protein", "left").select("protein", "n_models", "best", "largest", F.coalesce("n_partners", F.lit(0)).alias("n_partners"), "top_bias", "top_partner")


# --- structures ---


@query(
    "agg_23_weighted_rmsd",
    f"""WITH {v.ATOMS}, {v.CHAINS}, p AS (SELECT a.file_id, a.chain, c.prot_id, row_number() OVER (PARTITION BY a.file_id, a.chain ORDER BY res_no, line) AS k, x, y, z, bfactor, avg(bfactor) OVER (PARTITION BY a.file_id, a.chain) AS mp, count(*) OVER (PARTITION BY a.file_id, a.chain) AS n FROM atom a JOIN chain c ON c.file_id = a.file_id AND c.chain_id = a.chain WHERE atom_name = 'CA' AND prot_id IS NOT NULL),
    r AS (SELECT prot_id, n, arg_min((file_id, chain), (-round(mp, 9), file_id, chain)) AS k FROM p GROUP BY 1, 2), q AS (SELECT p.* FROM p JOIN r ON r.prot_id = p.prot_id AND r.n = p.n AND r.k = (p.file_id, p.chain))
    SELECT p.file_id, p.chain, p.prot_id, round(sqrt(sum(p.bfactor * ((p.x-q.x)**2 + (p.y-q.y)**2 + (p.z-q.z)**2)) / sum(p.bfactor)), 6) AS weighted_rmsd FROM p JOIN q ON q.prot_id = p.prot_id AND q.n = p.n AND q.k = p.k GROUP BY 1, 2, 3 HAVING sum(p.bfactor) > 0""",
)
def agg_23b(spark, d):
    """Distance of each chain to the most confident chain of the same protein and length, residues weighing by their pLDDT, without superposition."""
    pts = _chain_points(spark, d).withColumn("n", F.size("xyz")).withColumn("mp", F.round(F.aggregate("plddt", F.lit(0.0), lambda s, x: s + x) / F.size("plddt"), 9))
    ref = pts.groupBy("prot_id", "n").agg(F.min_by("xyz", F.struct(-F.col("mp"), "file_id", "chain")).alias("ref"))
    x = pts.join(ref, ["prot_id", "n"])
    gap = F.zip_with("xyz", "ref", lambda a, b: (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))
    total = F.aggregate(F.zip_with("plddt", gap, lambda w, g: w * g), F.lit(0.0), lambda s, y: s + y)
    weight = F.aggregate("plddt", F.lit(0.0), lambda s, y: s + y)
    return x.where(weight > 0).select("file_id", "chain", "prot_id", F.round(F.sqrt(total / weight), 6).alias("weighted_rmsd"))


@query("mat_9_core_rmsd")
def mat_9b(spark, d):
    """RMSD of each chain to the most confident one of its protein and length when only the steady core residues (pLDDT of all its models) are superposed; all residues where the core has fewer than five."""
    q = F.percentile("bfactor", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    pts = _chain_points(spark, d).withColumn("n", F.size("xyz")).where("n >= 3")
    places = pts.select("prot_id", "n", F.posexplode("plddt").alias("k", "bfactor")).groupBy("prot_id", "n", "k").agg(q.alias("q"))
    stats = places.groupBy("prot_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")))).alias("stats"))
    mean = F.aggregate("plddt", F.lit(0.0), lambda s, x: s + x) / F.size("plddt")
    ref = pts.groupBy("prot_id", "n").agg(F.max_by("xyz", F.struct(mean, -F.col("file_id"), "chain")).alias("ref"))
    x = pts.join(ref, ["prot_id", "n"]).join(stats, ["prot_id", "n"]).select("file_id", "chain", "prot_id", "xyz", "ref", F.transform("stats", lambda s: s["median"]).alias("median"), F.transform("stats", lambda s: s["iqr"]).alias("iqr"))

    @F.pandas_udf("double")
    def rmsd(a: pd.Series, b: pd.Series, med: pd.Series, iqr: pd.Series) -> pd.Series:
        out = []
        for p, r, u, w in zip(a, b, med, iqr, strict=True):
            p, r = np.stack(p), np.stack(r)
            core = geo.core_residues(np.asarray(u), np.asarray(w))
            if len(core) < 5:
                core = np.arange(len(p))
            turn, shift, _ = geo.superpose(p[core], r[core])
            out.append(round(float(np.sqrt(((p @ turn + shift - r) ** 2).sum(axis=1).mean())), 4))
        return pd.Series(out)

    return x.select("file_id", "chain", "prot_id", rmsd("xyz", "ref", "median", "iqr").alias("rmsd"))


@query("mat_13_pair_rmsd")
def mat_13b(spark, d):
    """Per file and chain pair: mean pLDDT of both chains and RMSD of each to its protein's reference, in order of the summed RMSD within the two proteins."""
    means = v.atoms(spark, d).where("atom_name = 'CA'").groupBy("file_id", "chain").agg(F.avg("bfactor").alias("plddt"), F.count("*").alias("n"))
    x = mat_7(spark, d).join(means, ["file_id", "chain"])
    one, two = (x.select("file_id", *(F.col(k).alias(f"{k}_{s}") for k in ("chain", "prot_id", "rmsd", "plddt", "n"))) for s in (1, 2))
    both = one.join(two, "file_id").where("chain_1 < chain_2")
    plddt = (F.col("plddt_1") * F.col("n_1") + F.col("plddt_2") * F.col("n_2")) / (F.col("n_1") + F.col("n_2"))
    rows = both.select("file_id", "chain_1", "chain_2", F.least("prot_id_1", "prot_id_2").alias("a"), F.greatest("prot_id_1", "prot_id_2").alias("b"), F.round(plddt, 4).alias("plddt"), "rmsd_1", "rmsd_2", (F.col("rmsd_1") + F.col("rmsd_2")).alias("total"))
    return series.numbered(rows, ["a", "b"], ["total", "file_id", "chain_1", "chain_2"], name="traj_n").drop("total")


# --- files ---


@query("snk_1_whole_tables", "SELECT count(*) AS n_rows, count(iptm) AS n_iptm, count(pdockq) AS n_pdockq, sum(rank) AS ranks, count(DISTINCT array_to_string(list_transform(sorted_tuple_pair, lambda x: coalesce(x, '')), '|')) AS n_pairs FROM pairwise_2mers_df")
def snk_1b(spark, d):
    """All columns of the 2-mer table as TSV, read back with its types."""
    scratch = Scratch(spark, "whole")
    rows = table(spark, d, "pairwise_2mers_df")
    flat = rows.withColumn("sorted_tuple_pair", F.transform("sorted_tuple_pair", lambda x: F.coalesce(x, F.lit(""))))
    tf.write_tsv(flat, scratch.path("pairs"), overwrite=True)
    schema = ", ".join(f"{n} {'string' if t.startswith('array') else t}" for n, t in rows.dtypes)
    back = spark.read.option("sep", "\t").option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").schema(schema).csv(scratch.path("pairs"))
    return back.agg(F.count("*").alias("n_rows"), F.count("iptm").alias("n_iptm"), F.count("pdockq").alias("n_pdockq"), F.sum("rank").alias("ranks"), F.count_distinct("sorted_tuple_pair").alias("n_pairs"))
