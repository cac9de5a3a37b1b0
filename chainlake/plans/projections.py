"""Queries of scalar functions, predicates and simple projections (PRJ, FLT) and of the atom sources."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions import metrics as m
from chainlake.functions import text as t
from chainlake.functions.ids import sorted_pair
from chainlake.operators import contacts as c
from chainlake.plans import views as v
from chainlake.plans.catalog import query, table
from chainlake.sources import pdb
from chainlake.storage import Scratch


@query("prj_1_sorted_pair", f"WITH {v.PW2} SELECT row_id, least(p1, p2) || '|' || greatest(p1, p2) AS pair FROM pw2")
def prj_1(spark, d):
    return v.pairwise2(spark, d).select("row_id", F.array_join(sorted_pair(F.col("p1"), F.col("p2")), "|").alias("pair"))


@query("prj_2_chain_index", f"WITH {v.PWN} SELECT row_id, ascii(upper(c1)) - 65 AS i1, ascii(upper(c2)) - 65 AS i2 FROM pwn")
def prj_2(spark, d):
    return v.pairwise_n(spark, d).select("row_id", m.chain_index(F.col("c1")).alias("i1"), m.chain_index(F.col("c2")).alias("i2"))


@query("prj_3_chain_offsets", f"WITH {v.CHAINS} SELECT file_id, chain_id, CAST(sum(length) OVER (PARTITION BY file_id ORDER BY ix) - length AS BIGINT) AS chain_offset FROM chain")
def prj_3(spark, d):
    before = F.sum("length").over(Window.partitionBy("file_id").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return v.chains(spark, d).select("file_id", "chain_id", before.cast("bigint").alias("chain_offset"))


@query(
    "prj_4_symmetric_block",
    """WITH cell AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
    m AS (SELECT vec_id, k // 8 AS i, k % 8 AS j, e::DOUBLE AS e FROM cell)
    SELECT x.vec_id, x.i, x.j - 3 AS j, round(least(x.e, y.e), 8) AS e FROM m x JOIN m y ON x.vec_id = y.vec_id AND x.i = y.j AND x.j = y.i WHERE x.i < 3 AND x.j >= 3""",
)
def prj_4(spark, d):
    """Block of chains A (3 residues) and B (5) of an 8 x 8 matrix, symmetrised with the transposed block."""
    square = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e"))
    cells = square.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).alias("j"), F.col("e").cast("double").alias("e"))
    upper = cells.where("i < 3 AND j >= 3")
    lower = cells.where("j < 3 AND i >= 3").select("vec_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("e").alias("e2"))
    return upper.join(lower, ["vec_id", "i", "j"]).select("vec_id", "i", (F.col("j") - 3).alias("j"), F.round(F.least("e", "e2"), 8).alias("e"))


@query("prj_5_min_pae", "SELECT matrix_id, round(list_min(flatten(pae))::DOUBLE, 4) AS min_pae FROM pairwise_contact_matrices WHERE pae IS NOT NULL")
def prj_5(spark, d):
    lowest = F.array_min(F.transform("pae", F.array_min)).cast("double")
    return table(spark, d, "pairwise_contact_matrices").where("pae IS NOT NULL").select("matrix_id", F.round(lowest, 4).alias("min_pae"))


_NEAR = f"""WITH {v.ATOMS}, near AS (SELECT a.file_id, a.chain AS c1, b.chain AS c2, a.res_no AS r1, b.res_no AS r2, a.bfactor AS b1, b.bfactor AS b2,
sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM atom a JOIN atom b ON a.file_id = b.file_id AND a.chain < b.chain AND (a.atom_name = 'CB' OR (a.atom_name = 'CA' AND a.res_name = 'GLY')) AND (b.atom_name = 'CB' OR (b.atom_name = 'CA' AND b.res_name = 'GLY'))
WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 8)"""
_PPV = "CASE WHEN s IS NULL THEN NULL " + " ".join(f"WHEN {a} >= s THEN {b}" for a, b in reversed(m.PPV_STEPS)) + f" ELSE {m.PPV_STEPS[0][1]} END"


@query(
    "prj_6_pdockq",
    _NEAR
    + f""", n AS (SELECT file_id, c1, c2, count(*) AS n FROM near GROUP BY ALL),
    ends AS (SELECT file_id, c1, c2, 1 AS side, r1 AS r, b1 AS b FROM near UNION SELECT file_id, c1, c2, 2, r2, b2 FROM near),
    p AS (SELECT file_id, c1, c2, avg(b) AS plddt FROM ends GROUP BY ALL),
    s AS (SELECT file_id, c1 AS chain_1, c2 AS chain_2, n AS n_contacts, plddt, round(0.724 / (1 + exp(-0.052 * (plddt * log10(n) - 152.611))) + 0.018, 3) AS s FROM n JOIN p USING (file_id, c1, c2))
    SELECT file_id, chain_1, chain_2, n_contacts, round(plddt, 8) AS plddt, s AS pdockq, {_PPV} AS ppv FROM s""",
)
def prj_6(spark, d):
    points = pdb.side_chain_points(v.atoms(spark, d)).select("file_id", "chain", "res_no", "bfactor", "x", "y", "z")
    points = Scratch(spark, "points").save(points, "points")  # the join reads them twice; texts are parsed once
    scores = c.interface_scores(points, ["file_id"])
    return scores.select("file_id", "chain_1", "chain_2", "n_contacts", F.round("plddt", 8).alias("plddt"), "pdockq", "ppv")


@query("prj_7_ppv", f"WITH {v.PW2}, s AS (SELECT row_id, pdockq AS s FROM pw2) SELECT row_id, {_PPV} AS ppv FROM s")
def prj_7(spark, d):
    return v.pairwise2(spark, d).select("row_id", m.ppv(F.col("pdockq")).alias("ppv"))


@query(
    "prj_8_edge_weight",
    f"""WITH {v.PW2}, e AS (SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, min(min_pae) AS pae, count(*) AS n FROM pw2 GROUP BY 1, 2)
    SELECT a, b, coalesce(greatest(round((1 - pae / 30.0) * least(n / 5.0, 1.0) * 5.0, 4), 0.5), 0.5) AS weight, round(0.5 + 4.5 / (1 + exp(-0.5 * (pae - 10.0))), 8) AS rescaled FROM e""",
)
def prj_8(spark, d):
    e = v.pairwise2(spark, d).groupBy(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).agg(F.min("min_pae").alias("pae"), F.count("*").alias("n"))
    return e.select("a", "b", m.edge_weight(F.col("pae"), F.col("n")).alias("weight"), F.round(m.sigmoid(F.col("pae"), 0.5, 5.0, 10.0, 0.5), 8).alias("rescaled"))


_INTERVALS = ("[0.0;0.5)", "[0.5;1.0)", "[1.0;1.0]", "(1.0;inf)")


@query(
    "prj_9_intervals",
    f"""WITH {v.PW2} SELECT row_id, CASE WHEN iptm >= 0 AND iptm < 0.5 THEN '[0.0;0.5)' WHEN iptm >= 0.5 AND iptm < 1 THEN '[0.5;1.0)' WHEN iptm = 1 THEN '[1.0;1.0]' WHEN iptm > 1 THEN '(1.0;inf)' END AS interval_text FROM pw2""",
)
def prj_9(spark, d):
    found = F.coalesce(*(F.when(m.in_interval(F.col("iptm"), m.parse_interval(F.lit(i))), F.lit(i)) for i in _INTERVALS))
    return v.pairwise2(spark, d).select("row_id", found.alias("interval_text"))


_COPIES = "len(list_filter(pim, lambda q: q = {0}))"


@query(
    "prj_10_combination_label",
    f"""WITH {v.PWN}, firsts AS (SELECT row_id, pim, list_filter(pim, lambda x, i: list_position(pim, x) = i) AS d FROM pwn WHERE pim IS NOT NULL)
    SELECT row_id, array_to_string(list_transform(d, lambda p: CASE WHEN len(list_filter(pim, lambda q: q = p)) > 1 THEN len(list_filter(pim, lambda q: q = p)) || ' x (' || p || ')' ELSE p END), ', ') AS label FROM firsts""",
)
def prj_10(spark, d):
    return v.pairwise_n(spark, d).where("pim IS NOT NULL").select("row_id", m.combination_label(F.col("pim")).alias("label"))


@query(
    "prj_11_state_labels",
    f"""WITH {v.PWN}, s AS (SELECT combo[1] AS protein, len(combo) AS n, count(DISTINCT rank) FILTER (WHERE min_pae <= 7.5) >= 4 AS stable FROM pwn WHERE len(combo) > 2 AND len(list_distinct(combo)) = 1 GROUP BY 1, 2)
    SELECT protein, string_agg(CASE WHEN stable THEN n::VARCHAR ELSE n || 'f' END, '|' ORDER BY n) AS states FROM s GROUP BY 1""",
)
def prj_11(spark, d):
    homo = v.pairwise_n(spark, d).where((F.size("combo") > 2) & (F.size(F.array_distinct("combo")) == 1))
    s = homo.groupBy(F.col("combo")[0].alias("protein"), F.size("combo").alias("n")).agg((F.count_distinct(F.when(F.col("min_pae") <= 7.5, F.col("rank"))) >= 4).alias("stable"))
    one = F.struct("n", m.state_label(F.col("n"), F.col("stable"), F.lit(True)).alias("label"))
    return s.groupBy("protein").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["label"]), "|").alias("states"))


@query(
    "prj_12_extra_proteins",
    f"""WITH {v.PWN}, n AS (SELECT *, {_COPIES.format('p1')} AS k1, {_COPIES.format('p2')} AS k2 FROM pwn WHERE pim IS NOT NULL)
    SELECT row_id, array_to_string(list_concat(list_filter(pim, lambda q: q <> p1 AND q <> p2), CASE WHEN p1 = p2 THEN CASE WHEN k1 > 2 THEN [p1 || ' as ' || k1 || '-mer'] ELSE [] END
    ELSE list_concat(CASE WHEN k1 > 1 THEN [p1 || ' as ' || k1 || '-mer'] ELSE [] END, CASE WHEN k2 > 1 THEN [p2 || ' as ' || k2 || '-mer'] ELSE [] END) END), ', ') AS extra FROM n""",
)
def prj_12(spark, d):
    return v.pairwise_n(spark, d).where("pim IS NOT NULL").select("row_id", F.array_join(m.extra_proteins(F.col("pim"), F.col("p1"), F.col("p2")), ", ").alias("extra"))


@query("prj_13_copies", f"WITH {v.PWN} SELECT row_id, {_COPIES.format('p1')} >= 2 AS twice, {_COPIES.format('p1')} AS n_copies FROM pwn WHERE pim IS NOT NULL")
def prj_13(spark, d):
    n = m.copies(F.col("pim"), F.col("p1"))
    return v.pairwise_n(spark, d).where("pim IS NOT NULL").select("row_id", (n >= 2).alias("twice"), n.cast("bigint").alias("n_copies"))


_WORDS = r"""list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[()]', '', 'g'), '[_\-/\s]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND regexp_matches(w, '^[a-z]+$') AND NOT list_contains({1}, w))"""
_STOP = "[" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + "]"


@query("prj_14_normal_words", f"SELECT doc_id, array_to_string({_WORDS.format('text', _STOP)}, ' ') AS words FROM documents WHERE text IS NOT NULL")
def prj_14(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(t.normal_words(F.col("text")), " ").alias("words"))


@query(
    "prj_15_ngrams",
    f"""WITH w AS (SELECT doc_id, {_WORDS.format('text', _STOP)} AS w FROM documents WHERE text IS NOT NULL),
    one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    gram AS ({" UNION ALL ".join(f"SELECT doc_id, {n} AS n, " + " || ' ' || ".join(["x"] + [f"lead(x, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, n)]) + " AS g FROM one" for n in range(1, 5))})
    SELECT doc_id, n AS n_words, g AS gram, count(*) AS n_times FROM gram WHERE g IS NOT NULL GROUP BY ALL""",
)
def prj_15(spark, d):
    words = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", t.normal_words(F.col("text")).alias("w"))
    grams = words.select("doc_id", F.explode(t.ngrams(F.col("w"))).alias("gram"))
    return grams.groupBy("doc_id", (F.size(F.split("gram", " "))).alias("n_words"), "gram").agg(F.count("*").alias("n_times"))


@query(
    "prj_16_string_helpers",
    r"""SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_the, len(string_split(regexp_replace(text, '<[^>]+>', '', 'g'), chr(10))) AS n_lines,
    list_max(list_transform(string_split(regexp_replace(text, '<[^>]+>', '', 'g'), chr(10)), lambda x: length(x))) AS longest_line,
    repeat('-', (greatest(12 - length(lang), 0) // 2)::INT) || lang || repeat('-', (greatest(12 - length(lang), 0) - greatest(12 - length(lang), 0) // 2)::INT) AS flag FROM documents WHERE text IS NOT NULL""",
)
def prj_16(spark, d):
    lengths = t.line_lengths(F.col("text"))
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.size(t.occurrences(F.col("text"), "the")).cast("bigint").alias("n_the"), F.size(lengths).alias("n_lines"), F.array_max(lengths).alias("longest_line"), t.centred(F.col("lang"), 12).alias("flag"))


@query(
    "prj_17_plddt_bands",
    f"""WITH {v.ATOMS} SELECT file_id, chain, res_no, line, CASE WHEN bfactor IS NULL THEN NULL WHEN bfactor > 90 THEN 'very high' WHEN bfactor > 70 THEN 'high' WHEN bfactor > 50 THEN 'low' ELSE 'very low' END AS band,
    '#' || {" || ".join(f"lpad(upper(format('{{:x}}', round({a} + greatest(0.0, least(1.0, bfactor / 100)) * {b - a})::BIGINT)), 2, '0')" for a, b in ((255, 0), (128, 83), (0, 214)))} AS colour FROM atom WHERE bfactor IS NOT NULL""",
)
def prj_17(spark, d):
    rows = v.atoms(spark, d).where("bfactor IS NOT NULL")
    return rows.select("file_id", "chain", "res_no", "line", m.plddt_band(F.col("bfactor")).alias("band"), m.blend((255, 128, 0), (0, 83, 214), F.col("bfactor") / 100).alias("colour"))


@query(
    "prj_18_segments",
    f"""WITH {v.CHAINS} SELECT file_id, chain_id, coalesce(lead(length) OVER w - 1, length) AS segment_end, regexp_matches(upper(coalesce(p.seq, '')), '^[ACDEFGHIKLMNPQRSTVWYBXZUOJ]+$') AS valid
    FROM chain LEFT JOIN proteins p USING (prot_id) WINDOW w AS (PARTITION BY file_id ORDER BY ix)""",
)
def prj_18(spark, d):
    rows = v.chains(spark, d)
    rows = rows.withColumn("following", F.lead("length").over(Window.partitionBy("file_id").orderBy("ix")))
    known = rows.join(table(spark, d, "proteins").select("prot_id", "seq"), "prot_id", "left")
    return known.select("file_id", "chain_id", m.segments_end(F.col("length") * 0, F.col("following"), F.col("length")).alias("segment_end"), m.is_protein_sequence(F.col("seq")).alias("valid"))


@query(
    "prj_19_centroids",
    f"""WITH {v.ATOMS}, c AS (SELECT file_id, chain, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM atom GROUP BY 1, 2)
    SELECT file_id, chain, round(cx, 8) AS cx, round(cy, 8) AS cy, round(cz, 8) AS cz, round(max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))), 8) AS radius FROM atom JOIN c USING (file_id, chain) GROUP BY ALL""",
)
def prj_19(spark, d):
    a = v.atoms(spark, d)
    centre = a.groupBy("file_id", "chain").agg(*(F.avg(x).alias(f"c{x}") for x in "xyz"))
    far = m.distance3([F.col(x) for x in "xyz"], [F.col(f"c{x}") for x in "xyz"])
    out = a.join(centre, ["file_id", "chain"]).groupBy("file_id", "chain", "cx", "cy", "cz").agg(F.max(far).alias("radius"))
    return out.select("file_id", "chain", *(F.round(x, 8).alias(x) for x in ("cx", "cy", "cz", "radius")))


@query(
    "prj_20_rotation",
    f"""WITH {v.ATOMS} SELECT file_id, line, round(x * {math.cos(0.5)} - y * {math.sin(0.5)}, 8) AS rx, round(x * {math.sin(0.5)} + y * {math.cos(0.5)}, 8) AS ry, round(z, 8) AS rz FROM atom""",
)
def prj_20(spark, d):
    from chainlake.functions.geometry import rotated

    point = rotated([F.col(x) for x in "xyz"], (0.0, 0.0, 1.0), 0.5)
    return v.atoms(spark, d).select("file_id", "line", *(F.round(p, 8).alias(f"r{x}") for p, x in zip(point, "xyz", strict=True)))


@query("prj_21_domain_atoms", f"WITH {v.ATOMS} SELECT file_id, chain, res_no, bfactor FROM atom WHERE atom_name = 'CA' AND res_no BETWEEN 2 AND 6")
def prj_21(spark, d):
    return v.atoms(spark, d).where("atom_name = 'CA' AND res_no BETWEEN 2 AND 6").select("file_id", "chain", "res_no", "bfactor")


@query(
    "prj_22_residue_pair",
    f"""WITH {v.ATOMS}, a AS (SELECT file_id, list(bfactor ORDER BY line) AS b FROM atom GROUP BY 1)
    SELECT file_id, least(b[1], b[len(b)]) AS least_plddt FROM a""",
)
def prj_22(spark, d):
    ends = v.atoms(spark, d).groupBy("file_id").agg(F.min_by("bfactor", "line").alias("first"), F.max_by("bfactor", "line").alias("last"))
    return ends.select("file_id", F.least("first", "last").alias("least_plddt"))


@query("flt_1_two_mers", f"WITH {v.PW2} SELECT row_id FROM pw2 WHERE min_pae <= 7.5 AND iptm >= 0.5")
def flt_1(spark, d):
    return v.pairwise2(spark, d).where("min_pae <= 7.5 AND iptm >= 0.5").select("row_id")


@query("flt_2_n_mers", f"WITH {v.PWN} SELECT row_id FROM pwn WHERE min_pae <= 7.5 AND pdockq >= 0.23")
def flt_2(spark, d):
    return v.pairwise_n(spark, d).where("min_pae <= 7.5 AND pdockq >= 0.23").select("row_id")


@query("flt_3_contacts", f"WITH {v.CONTACTS} SELECT matrix_id, i, j FROM contact")
def flt_3(spark, d):
    return v.contacts(spark, d).select("matrix_id", "i", "j")


@query("flt_4_homo_n_mers", f"WITH {v.PWN} SELECT row_id FROM pwn WHERE len(list_distinct(pim)) = 1 AND len(pim) > 2")
def flt_4(spark, d):
    return v.pairwise_n(spark, d).where((F.size(F.array_distinct("pim")) == 1) & (F.size("pim") > 2)).select("row_id")


@query("flt_5_expanded", f"WITH {v.PWN} SELECT row_id FROM pwn WHERE list_sort(list_distinct(pim)) = list_sort(list_distinct([p1, p2]))")
def flt_5(spark, d):
    return v.pairwise_n(spark, d).where(F.array_sort(F.array_distinct("pim")) == F.array_sort(F.array_distinct(F.array("p1", "p2")))).select("row_id")


@query("flt_6_valid_matrices", f"WITH {v.CONTACTS} SELECT matrix_id, count(*) AS n_contacts FROM contact GROUP BY 1 HAVING count(*) >= 3")
def flt_6(spark, d):
    return c.contact_counts(v.contacts(spark, d)).select("matrix_id", "n_contacts")


@query("flt_7_ordered_chains", f"WITH {v.ATOMS} SELECT file_id, chain, round(avg(bfactor), 8) AS mean_plddt, count(*) FILTER (WHERE bfactor >= 70) AS n_kept FROM atom GROUP BY 1, 2 HAVING avg(bfactor) >= 60")
def flt_7(spark, d):
    a = v.atoms(spark, d).groupBy("file_id", "chain").agg(F.avg("bfactor").alias("p"), F.count_if(F.col("bfactor") >= 70).alias("n_kept")).where("p >= 60")
    return a.select("file_id", "chain", F.round("p", 8).alias("mean_plddt"), "n_kept")


@query("src_4_atoms", f"WITH {v.ATOMS} SELECT * FROM atom")
def src_4(spark, d):
    return v.atoms(spark, d)


@query(
    "src_3_chain_sequences",
    f"""WITH {v.ATOMS}, r AS (SELECT file_id, chain, res_no, ins, min(CASE res_name {" ".join(f"WHEN '{k}' THEN '{x}'" for k, x in m.AMINO_ACIDS.items())} END) AS aa FROM atom GROUP BY ALL)
    SELECT file_id, chain, string_agg(aa, '' ORDER BY res_no, ins) AS sequence, count(aa)::INT AS length FROM r WHERE aa IS NOT NULL GROUP BY 1, 2""",
)
def src_3(spark, d):
    return pdb.chain_sequences(v.atoms(spark, d), ["file_id"])


@query("src_5_side_chain_points", f"WITH {v.ATOMS} SELECT file_id, line, chain, bfactor FROM atom WHERE atom_name = 'CB' OR (atom_name = 'CA' AND res_name = 'GLY')")
def src_5(spark, d):
    return pdb.side_chain_points(v.atoms(spark, d)).select("file_id", "line", "chain", "bfactor")


_BASE = r"regexp_extract(replace(pdb_file, '\', '/'), '([^/]*)$', 1)"
_PAT = r"^(.*)_(unrelaxed|relaxed)_rank_(\d{3})_(.*)_model_(\d+)_seed_(\d+)\.pdb\s*$"


@query(
    "src_2_prediction_names",
    f"""WITH b AS (SELECT file_id, {_BASE} AS b FROM all_pdb_data WHERE pdb_file IS NOT NULL)
    SELECT file_id, {", ".join(f"CASE WHEN regexp_matches(b, '{_PAT}') THEN regexp_extract(b, '{_PAT}', {k}){cast} END AS {n}" for k, n, cast in ((1, "combination", ""), (2, "relaxation", ""), (3, "name_rank", "::INT"), (5, "model", "::INT"), (6, "seed", "::BIGINT")))} FROM b""",
)
def src_2(spark, d):
    rows = table(spark, d, "all_pdb_data").where("pdb_file IS NOT NULL")
    return rows.select("file_id", *pdb.prediction_name(F.col("pdb_file")))
