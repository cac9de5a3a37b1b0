"""Queries of kernels without SQL: features, layouts, simulations and trajectories. Their tests hold them against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions import metrics as m
from chainlake.operators import contacts as c
from chainlake.operators import exploration as ex
from chainlake.operators import lattice as la
from chainlake.plans import views as v
from chainlake.plans.catalog import query, table
from chainlake.plans.relations import passing2
from chainlake.plans.structures import _EDGE1, _GROWN, _STATES, _links, _per_pair, _ppi, _sized_models, _states, _text
from chainlake.sources import text_files as tf


@query("mat_6_features")
def mat_6(spark, d):
    """Number of components that hold 95 % of the variance of each pair's contact sets."""
    return _per_pair(spark, d, lambda dist, sets, w: np.full(len(sets), ex.component_count(sets, w))).groupBy("a", "b").agg(F.max("label").alias("n_components"))


def _domain_atoms(spark, d):
    ch = v.chains(spark, d).where("prot_id IS NOT NULL").select("file_id", F.col("chain_id").alias("chain"), "prot_id", "rank")
    a = v.atoms(spark, d).where("atom_name = 'CA'").groupBy("file_id", "chain", "res_no").agg(*(F.min_by(x, "line").alias(x) for x in ("x", "y", "z", "bfactor")))
    return a.join(ch, ["file_id", "chain"]).withColumn("domain", F.expr("CAST((res_no - 1) DIV 8 AS INT)"))


@query("mat_11_domain_rmsd")
def mat_11(spark, d):
    """RMSD of stretches of eight residues to the most confident model of the same protein."""
    return ex.reference_rmsd(_domain_atoms(spark, d).drop("rank"), ["file_id", "chain"], ["prot_id", "domain"])


@query("mat_13_pair_trajectory")
def mat_13(spark, d):
    """Per file and chain pair: pDockQ, distance of the centroids and place in order of it within the two proteins."""
    a = v.atoms(spark, d).where("atom_name = 'CA'")
    ctr = a.groupBy("file_id", "chain").agg(*(F.avg(x).alias(x) for x in "xyz"), F.avg("bfactor").alias("plddt"))
    prot = v.chains(spark, d).where("prot_id IS NOT NULL").select("file_id", F.col("chain_id").alias("chain"), "prot_id")
    x = ctr.join(prot, ["file_id", "chain"])
    one, two = (x.select("file_id", *(F.col(k).alias(f"{k}_{s}") for k in ("chain", "prot_id", "x", "y", "z", "plddt"))) for s in (1, 2))
    far = m.distance3([F.col(f"{k}_1") for k in "xyz"], [F.col(f"{k}_2") for k in "xyz"])
    both = one.join(two, "file_id").where("chain_1 < chain_2").withColumn("distance", F.round(far, 6))
    scored = both.join(c.interface_scores(a, ["file_id"]).select("file_id", "chain_1", "chain_2", "pdockq"), ["file_id", "chain_1", "chain_2"], "left")
    p, q = F.least("prot_id_1", "prot_id_2").alias("a"), F.greatest("prot_id_1", "prot_id_2").alias("b")
    rows = scored.select("file_id", "chain_1", "chain_2", p, q, "distance", F.coalesce("pdockq", F.lit(0.0)).alias("pdockq"))
    return rows.withColumn("traj_n", F.row_number().over(Window.partitionBy("a", "b").orderBy("distance", "file_id", "chain_1", "chain_2")))


@query("mat_17_layout")
def mat_17(spark, d):
    """Positions of the chains of each model by the force field, the links being its passing chain pairs."""
    links = _links(spark, d).distinct().groupBy("pred_id", "rank").agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("links"))
    rows = _sized_models(spark, d).join(links, ["pred_id", "rank"])

    def place(batches):
        for b in batches:
            out = []
            for pred, rank, n, ls in zip(b["pred_id"], b["rank"], b["n"], b["links"], strict=True):
                ok = [(int(x), int(y)) for x, y in ls if 0 <= x < n and 0 <= y < n and x != y]
                out += [(pred, rank, k, *map(float, np.round(p, 3))) for k, p in enumerate(ex.force_layout(int(n), ok, steps=60))]
            yield pd.DataFrame(out, columns=["pred_id", "rank", "chain_ix", "x", "y", "z"])

    return rows.mapInPandas(place, "pred_id bigint, rank int, chain_ix int, x double, y double, z double")


@query("sim_1_assembly_paths")
def sim_1(spark, d):
    edges = passing2(spark, d).select(F.col("p1").alias("a"), F.col("p2").alias("b"), F.coalesce("iptm", F.lit(0.01)).alias("weight"))
    return ex.assembly_paths(spark, edges).select("path", "step", *_text("combo"), "score")


@query(
    "lat_5_exploration",
    "WITH " + _STATES + _EDGE1 + """, k AS (SELECT parent AS combo, count(*) AS n_children, bool_or(s.is_stable) AS any_stable FROM le JOIN states s ON s.combo = le.child GROUP BY 1)
    SELECT array_to_string(states.combo, '|') AS combo, is_stable, CASE WHEN is_stable AND n_children IS NULL THEN NULL WHEN NOT is_stable THEN false ELSE NOT any_stable END AS is_convergent, coalesce(n_children, 0) AS n_children FROM states LEFT JOIN k ON k.combo = states.combo""",
)
def lat_5(spark, d):
    """The lattice in one table: state, convergence and number of children of every combination."""
    s = _states(spark, d)
    e = la.containment_edges(s)
    kids = e.groupBy(F.col("parent").alias("combo")).agg(F.count("*").alias("n_children"))
    return la.convergence(s, e).join(kids, "combo", "left").select(*_text("combo"), "is_stable", "is_convergent", F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query(
    "lat_5_changes",
    "WITH " + _GROWN + """ SELECT 'added' AS change, array_to_string(combo, '|') AS combo FROM cand UNION ALL SELECT 'removed', array_to_string(combo, '|') FROM (SELECT combo FROM grown_all EXCEPT SELECT combo FROM grown) WHERE combo NOT IN (SELECT combo FROM states)""".replace("grown_all", "(SELECT DISTINCT list_sort(list_append(combo, x)) AS combo FROM sm JOIN ed USING (m))"),
)
def lat_5b(spark, d):
    """Combinations that exploration adds to the lattice, and those that the rule on repeats keeps out."""
    s, links = _states(spark, d), _ppi(spark, d)
    added = la.candidates(s, links).select(F.lit("added").alias("change"), "combo")
    every = la.grown(s, links, repeat_size=1 << 30).select("combo").distinct()
    out = every.join(la.grown(s, links).select("combo").distinct(), "combo", "left_anti").join(s.select("combo"), "combo", "left_anti")
    return added.unionByName(out.select(F.lit("removed").alias("change"), "combo")).select("change", *_text("combo"))


@query("src_14_annotations", """WITH dom AS (SELECT prot_id, 1 AS domain, 1 AS s, len // 2 AS e FROM proteins UNION ALL SELECT prot_id, 2, len // 2 + 1, len FROM proteins), hit AS (SELECT prot_id, prot_name AS name, 1 AS hs, len // 3 AS he FROM proteins WHERE prot_name IS NOT NULL)
    SELECT dom.prot_id AS protein, domain, coalesce(name, 'No InterPro data') AS annotation, coalesce(hs >= s AND he <= e, false) AS "full" FROM dom LEFT JOIN hit ON dom.prot_id = hit.prot_id AND he >= s AND hs <= e""")
def src_14(spark, d):
    half = F.expr("CAST(len DIV 2 AS INT)")
    p = table(spark, d, "proteins")
    span = lambda n, s, e: p.select(F.col("prot_id").alias("Protein_ID"), F.lit(n).alias("Domain"), s.alias("Start"), e.alias("End"))
    domains = span(1, F.lit(1), half).unionByName(span(2, half + 1, F.col("len")))
    hits = p.where("prot_name IS NOT NULL").select(F.col("prot_id").alias("Protein_ID"), F.col("prot_name").alias("name"), F.lit(1).alias("hit_start"), F.expr("CAST(len DIV 3 AS INT)").alias("hit_end"))
    return tf.annotated(domains, hits).select(F.col("Protein_ID").alias("protein"), F.col("Domain").alias("domain"), F.col("InterPro").alias("annotation"), "full")


@query("src_16_models", "SELECT file_id, 0 AS model FROM all_pdb_data WHERE regexp_matches(content, '(?m)^(ATOM|HETATM)')")
def src_16(spark, d):
    from chainlake.sources.pdb import split_models

    return split_models(table(spark, d, "all_pdb_data").select("file_id", "content"), "content", ["file_id"]).select("file_id", "model")


@query("src_17_domain_spans", f"WITH {v.ATOMS}, dom AS (SELECT file_id, chain, (res_no - 1) // 8 AS domain, max(res_no) AS stop, avg(bfactor) AS p FROM atom WHERE res_no >= 1 GROUP BY 1, 2, 3), b AS (SELECT file_id || chain AS k, max(stop) AS backbone FROM dom GROUP BY 1) SELECT file_id || chain AS protein, domain, backbone FROM dom JOIN b ON k = file_id || chain WHERE p >= 40")
def src_17(spark, d):
    a = v.atoms(spark, d).where("res_no >= 1").groupBy(F.concat(F.col("file_id").cast("string"), "chain").alias("Protein_ID"), F.expr("CAST((res_no - 1) DIV 8 AS INT)").alias("Domain"))
    spans = tf.domain_spans(a.agg(F.max("res_no").alias("End"), F.avg("bfactor").alias("Mean_pLDDT")))
    return spans.select(F.col("Protein_ID").alias("protein"), F.col("Domain").alias("domain"), "backbone")


@query("rep_4_trajectory_summary", "WITH " + v.TRAJECTORY + " SELECT protein, count(*) AS n_models, round(min(min_pae), 8) AS best, round(median(min_pae), 8) AS middle, max(len(combo)) AS largest FROM traj GROUP BY 1")
def rep_4(spark, d):
    x = v.trajectory(spark, d).groupBy("protein")
    return x.agg(F.count("*").alias("n_models"), F.round(F.min("min_pae"), 8).alias("best"), F.round(F.median("min_pae"), 8).alias("middle"), F.max(F.size("combo")).alias("largest"))
