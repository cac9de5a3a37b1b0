"""Queries of joins, aggregations, windows and set operations (JN, AGG, WIN, SRT, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions import metrics as m
from chainlake.functions import text as t
from chainlake.operators import contacts as c
from chainlake.operators import lattice as la
from chainlake.operators import ppi, series
from chainlake.operators import statistics as st
from chainlake.plans import views as v
from chainlake.plans.catalog import query, table

def ab():
    """The unordered pair of p1 and p2 as columns a and b."""
    return F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")


def _combo():
    return F.array_join("combo", "|").alias("combo")


# --- detection ---

_AGG1 = f"""WITH {v.PW2}, f1 AS (SELECT p1, p2, count(*) AS n_models FROM pw2 WHERE min_pae <= 7.5 AND iptm >= 0 GROUP BY 1, 2 HAVING count(*) >= 4),
f2 AS (SELECT p1, p2, max(iptm) AS iptm, min(min_pae) AS min_pae FROM pw2 GROUP BY 1, 2), f3 AS (SELECT * FROM f1 JOIN f2 USING (p1, p2))"""
_AGG2 = f"""WITH {v.PWN}, r AS (SELECT p1, p2, combo, rank, min(min_pae) AS min_pae, max(pdockq) AS pdockq FROM pwn WHERE combo IS NOT NULL GROUP BY ALL),
f1 AS (SELECT p1, p2, combo, count(*) AS n_models FROM r WHERE min_pae <= 7.5 AND pdockq >= 0 GROUP BY ALL HAVING count(*) >= 4),
f2 AS (SELECT p1, p2, combo, max(pdockq) AS pdockq, min(min_pae) AS min_pae FROM r GROUP BY ALL), f3n AS (SELECT * FROM f1 JOIN f2 USING (p1, p2, combo))"""


def passing2(spark, d):
    return ppi.detect_2mers(v.pairwise2(spark, d))


def passing_n(spark, d):
    return ppi.detect_nmers(v.pairwise_n(spark, d).where("combo IS NOT NULL"))


@query("agg_1_2mer_ppi", _AGG1 + " SELECT p1, p2, n_models, iptm, min_pae FROM f3")
def agg_1(spark, d):
    return passing2(spark, d)


@query("agg_2_nmer_ppi", _AGG2 + " SELECT p1, p2, array_to_string(combo, '|') AS combo, n_models, pdockq, min_pae FROM f3n")
def agg_2(spark, d):
    return passing_n(spark, d).select("p1", "p2", _combo(), "n_models", "pdockq", "min_pae")


@query("agg_3_interacting_proteins", _AGG1 + " SELECT p1 AS protein FROM f3 UNION SELECT p2 FROM f3")
def agg_3(spark, d):
    return ppi.interacting_proteins(passing2(spark, d))


@query(
    "agg_4_reference_occurrence",
    f"""WITH {v.ATOMS}, {v.CHAINS}, o AS (SELECT c.prot_id, a.file_id, a.chain, avg(bfactor) AS p FROM atom a JOIN chain c ON c.file_id = a.file_id AND c.chain_id = a.chain WHERE c.prot_id IS NOT NULL GROUP BY ALL)
    SELECT prot_id, arg_min(file_id, (round(p, 8), file_id, chain)) AS lowest, arg_min(file_id, (-round(p, 8), file_id, chain)) AS highest, round(avg(round(p, 8)), 8) AS mean_value, count(*) AS n_occurrences FROM o GROUP BY 1""",
)
def agg_4(spark, d):
    chains = v.chains(spark, d).where("prot_id IS NOT NULL").select("file_id", F.col("chain_id").alias("chain"), "prot_id")
    o = v.atoms(spark, d).groupBy("file_id", "chain").agg(F.round(F.avg("bfactor"), 8).alias("p")).join(chains, ["file_id", "chain"])
    ref = ppi.occurrences(o, F.col("p"), "prot_id", ["file_id", "chain"])
    return ref.select("prot_id", F.col("lo.file_id").alias("lowest"), F.col("hi.file_id").alias("highest"), F.round("mean_value", 8).alias("mean_value"), "n_occurrences")


@query(
    "agg_5_first_predictions",
    f"""WITH {v.PWN}, k AS (SELECT pred_id, min(combo) AS members, min(row_id) AS first FROM pwn WHERE combo IS NOT NULL AND pred_id IS NOT NULL GROUP BY 1),
    e AS (SELECT pred_id, first, unnest(members) AS p FROM k), q AS (SELECT pred_id, first, list_sort(list(coalesce(seq, '?' || e.p))) AS key FROM e LEFT JOIN proteins ON prot_id = e.p GROUP BY 1, 2)
    SELECT md5(array_to_string(key, '|')) AS key, len(key) AS n_chains, arg_min(pred_id, (first, pred_id)) AS pred_id, count(*) AS n_predictions FROM q GROUP BY q.key""",
)
def agg_5(spark, d):
    """The first prediction of each multiset of chain sequences; a chain of an unknown protein stands for itself."""
    k = v.pairwise_n(spark, d).where("combo IS NOT NULL AND pred_id IS NOT NULL").groupBy("pred_id").agg(F.min("combo").alias("combo"), F.min("row_id").alias("first"))
    seqs = table(spark, d, "proteins").select(F.col("prot_id").alias("p"), "seq")
    chains = k.select("pred_id", F.explode("combo").alias("p"), "first").join(seqs, "p", "left")
    out = ppi.first_predictions(chains.select("pred_id", F.coalesce("seq", F.concat(F.lit("?"), "p")).alias("seq"), "first"), F.col("first"))
    return out.select(F.md5(F.array_join("key", "|")).alias("key"), F.size("key").alias("n_chains"), "pred_id", "n_predictions")


def _models(spark, d):
    """One row per contact record with both IDs: (matrix_id, p1, p2, a, b, c1, c2, combo, rank, n_chains)."""
    from chainlake.functions.ids import protein_id

    pim = F.filter(F.transform("proteins_in_model", protein_id), lambda p: p.isNotNull())
    rows = table(spark, d, "pairwise_contact_matrices").select(
        "matrix_id", protein_id("protein1").alias("p1"), protein_id("protein2").alias("p2"), F.array_sort(pim).alias("combo"), "rank",
        F.element_at("pair_chains_tuple", 1).alias("c1"), F.element_at("pair_chains_tuple", 2).alias("c2"), F.size("proteins_in_model").alias("n_chains"),
    )
    return rows.where("p1 IS NOT NULL AND p2 IS NOT NULL AND combo IS NOT NULL").select("*", *ab())


_MODELS = f"""model AS (SELECT matrix_id, {v.sql_id('protein1')} AS p1, {v.sql_id('protein2')} AS p2, least({v.sql_id('protein1')}, {v.sql_id('protein2')}) AS a, greatest({v.sql_id('protein1')}, {v.sql_id('protein2')}) AS b,
list_sort(list_filter(list_transform(proteins_in_model, lambda x: {v.sql_id('x')}), lambda x: x IS NOT NULL)) AS combo, rank, pair_chains_tuple[1] AS c1, pair_chains_tuple[2] AS c2, len(proteins_in_model) AS n_chains
FROM pairwise_contact_matrices WHERE {v.sql_id('protein1')} IS NOT NULL AND {v.sql_id('protein2')} IS NOT NULL AND proteins_in_model IS NOT NULL)"""


@query(
    "agg_6_rank_support",
    f"""WITH {v.CONTACTS}, {_MODELS}, n AS (SELECT matrix_id FROM contact GROUP BY 1 HAVING count(*) >= 5)
    SELECT a, b, array_to_string(combo, '|') AS combo, count(DISTINCT rank) FILTER (WHERE matrix_id IN (SELECT matrix_id FROM n)) AS n_ranks FROM model GROUP BY a, b, combo""",
)
def agg_6(spark, d):
    return c.rank_support(v.contacts(spark, d), _models(spark, d)).select("a", "b", _combo(), "n_ranks")


@query(
    "agg_7_hover_values",
    f"""WITH {v.PWN} SELECT p1, p2, array_to_string(combo, '|') AS combo, max(ptm) AS ptm, max(iptm) AS iptm, max(pdockq) AS pdockq, min(min_pae) AS min_pae, count(DISTINCT rank) FILTER (WHERE min_pae < 7.5 AND pdockq > 0) AS n_models,
    CASE WHEN count(DISTINCT rank) FILTER (WHERE min_pae < 7.5 AND pdockq > 0) > 0 THEN repeat('✔', count(DISTINCT rank) FILTER (WHERE min_pae < 7.5 AND pdockq > 0)) ELSE 'x' END AS mark FROM pwn WHERE combo IS NOT NULL GROUP BY p1, p2, combo""",
)
def agg_7(spark, d):
    return ppi.hover_values(v.pairwise_n(spark, d).where("combo IS NOT NULL")).withColumn("combo", _combo())


_AGG8 = f"""WITH {v.CONTACTS}, {_MODELS}, ok AS (SELECT matrix_id FROM contact GROUP BY 1 HAVING count(*) >= 5), hit AS (SELECT * FROM model WHERE matrix_id IN (SELECT matrix_id FROM ok)),
side AS (SELECT p1 AS protein, c1 AS chain, p2 AS partner, combo, rank FROM hit UNION ALL SELECT p2, c2, p1, combo, rank FROM hit),
inter AS (SELECT protein, combo, rank, chain, partner, count(*) AS n FROM side GROUP BY ALL)"""


def _interactions(spark, d):
    return c.chain_interactions(v.contacts(spark, d), _models(spark, d))


@query("agg_8_chain_interactions", _AGG8 + " SELECT protein, array_to_string(combo, '|') AS combo, rank, chain, partner, n AS n_contacts_with FROM inter")
def agg_8(spark, d):
    return _interactions(spark, d).withColumn("combo", _combo())


@query("agg_9_max_valency", _AGG8 + " SELECT least(protein, partner) AS a, greatest(protein, partner) AS b, max(n) AS max_valency FROM inter GROUP BY 1, 2")
def agg_9(spark, d):
    return c.max_valency(_interactions(spark, d))


_AGG10 = _AGG8 + """, f AS (SELECT least(protein, partner) AS a, greatest(protein, partner) AS b, count(*) FILTER (WHERE n > 1) AS n_multivalent, count(*) AS n_chains,
coalesce(avg((n > 1)::INT) FILTER (WHERE len(combo) > 2 AND len(list_filter(combo, lambda q: q = protein)) + len(list_filter(combo, lambda q: q = partner)) = 3), 0) AS fraction_3,
coalesce(avg((n > 1)::INT) FILTER (WHERE len(combo) > 2), 0) AS fn FROM inter GROUP BY 1, 2)"""


@query("agg_10_multivalent_fraction", _AGG10 + " SELECT a, b, n_multivalent, n_chains, round(fraction_3, 8) AS fraction_3, round(greatest(fraction_3, fn), 8) AS fraction FROM f")
def agg_10(spark, d):
    return c.multivalent_fraction(_interactions(spark, d)).select("a", "b", "n_multivalent", "n_chains", F.round("fraction_3", 8).alias("fraction_3"), F.round("fraction", 8).alias("fraction"))


@query("agg_11_multivalent_pairs", _AGG10 + " SELECT a, b FROM f WHERE greatest(fraction_3, fn) >= 0.2")
def agg_11(spark, d):
    return c.multivalent_fraction(_interactions(spark, d)).where("fraction >= 0.2").select("a", "b")


@query(
    "agg_12_multivalency_metrics",
    _AGG8
    + """, am AS (SELECT least(protein, partner) AS a, greatest(protein, partner) AS b, combo, rank, bool_or(n > 1) AS x FROM inter WHERE len(combo) > 0 GROUP BY 1, 2, combo, rank), cs AS (SELECT a, b, round(avg(x::INT), 8) AS model_consistency, count(*) AS n_models FROM am GROUP BY 1, 2)
    SELECT least(protein, partner) AS a, greatest(protein, partner) AS b, max(n) AS max_value, round(avg((n > 1)::INT), 8) AS fraction, round(sum((n > 1)::INT / len(combo)::DOUBLE) / sum(1 / len(combo)::DOUBLE), 8) AS weighted_fraction,
    round(avg(n), 8) AS mean_value, round(var_samp(n), 8) AS var_value, round(quantile_cont(n, 0.25), 8) AS q1, round(median(n), 8) AS q2, round(quantile_cont(n, 0.75), 8) AS q3,
    round(avg(n / greatest(len(list_filter(combo, lambda q: q = partner)), 1)::DOUBLE), 8) AS normalised_mean, round(avg((n / greatest(len(list_filter(combo, lambda q: q = partner)), 1)::DOUBLE > 0.5)::INT), 8) AS normalised_fraction,
    count(*) AS n_chains, count(*) FILTER (WHERE n > 1) AS n_multivalent, any_value(cs.model_consistency) AS model_consistency, any_value(cs.n_models) AS n_models FROM inter JOIN cs ON cs.a = least(protein, partner) AND cs.b = greatest(protein, partner) WHERE len(combo) > 0 GROUP BY 1, 2""",
)
def agg_12(spark, d):
    x = _interactions(spark, d).where(F.size("combo") > 0)
    n, size = F.col("n_contacts_with"), F.size("combo").cast("double")
    share = n / F.greatest(m.copies(F.col("combo"), F.col("partner")), F.lit(1))
    many = (n > 1).cast("double")
    values = {
        "fraction": F.avg(many), "weighted_fraction": F.sum(many / size) / F.sum(1 / size), "mean_value": F.avg(n), "var_value": F.var_samp(n), "q1": F.percentile(n, F.lit(0.25)), "q2": F.median(n),
        "q3": F.percentile(n, F.lit(0.75)), "normalised_mean": F.avg(share), "normalised_fraction": F.avg((share > 0.5).cast("double")),
    }
    pair = F.least("protein", "partner").alias("a"), F.greatest("protein", "partner").alias("b")
    steady = x.groupBy(*pair, "combo", "rank").agg(F.bool_or(n > 1).alias("any")).groupBy("a", "b").agg(F.round(F.avg(F.col("any").cast("double")), 8).alias("model_consistency"), F.count("*").alias("n_models"))
    return steady.join(x.groupBy(*pair).agg(
        F.max(n).alias("max_value"), *(F.round(e, 8).alias(k) for k, e in values.items()), F.count("*").alias("n_chains"), F.count_if(n > 1).alias("n_multivalent")
    ), ["a", "b"])


_FIVE = "round(avg({0}), 8) AS {1}mean, round(stddev_samp({0}), 8) AS {1}sd, round(median({0}), 8) AS {1}median, round(quantile_cont({0}, 0.25), 8) AS {1}q1, round(quantile_cont({0}, 0.75), 8) AS {1}q3"


_FILE_PAIRS = """fp AS (SELECT file_id, rank, list_sort(list(prot_id)) AS combo, min(prot_id) AS a, max(prot_id) AS b FROM chain WHERE prot_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT prot_id) <= 2)"""


@query(
    "agg_13_plddt_stability",
    f"""WITH {v.ATOMS}, {v.CHAINS}, {_FILE_PAIRS}, r AS (SELECT fp.*, c.prot_id, bfactor FROM fp JOIN chain c ON c.file_id = fp.file_id JOIN atom t ON t.file_id = c.file_id AND t.chain = c.chain_id WHERE atom_name = 'CA'),
    s AS (SELECT *, 'general' AS side FROM r UNION ALL SELECT *, 'prot1' FROM r WHERE prot_id = a UNION ALL SELECT *, 'prot2' FROM r WHERE prot_id = b)
    SELECT a, b, array_to_string(combo, '|') AS combo, rank, side, {_FIVE.format('bfactor', '')} FROM s GROUP BY a, b, s.combo, rank, side""",
)
def agg_13(spark, d):
    """Per pair, combination and rank the residues of the first, the second and all proteins, pooled over chains and files of one or two proteins."""
    ch = v.chains(spark, d).where("prot_id IS NOT NULL")
    ids = F.collect_list("prot_id")
    files = ch.groupBy("file_id", "rank").agg(F.array_sort(ids).alias("combo")).select("file_id", "rank", "combo", F.col("combo")[0].alias("a"), F.element_at("combo", -1).alias("b"))
    files = files.where((F.size("combo") > 1) & F.forall("combo", lambda p: (p == F.col("a")) | (p == F.col("b"))))
    rows = v.atoms(spark, d).where("atom_name = 'CA'").join(ch.select("file_id", F.col("chain_id").alias("chain"), "prot_id"), ["file_id", "chain"]).join(files, "file_id")
    sides = F.filter(F.array(F.lit("general"), F.when(F.col("prot_id") == F.col("a"), "prot1"), F.when(F.col("prot_id") == F.col("b"), "prot2")), lambda x: x.isNotNull())
    out = rows.select("a", "b", "combo", "rank", F.explode(sides).alias("side"), "bfactor").groupBy("a", "b", "combo", "rank", "side").agg(*st.five_numbers(F.col("bfactor")))
    return out.select("a", "b", _combo(), "rank", "side", *(F.round(x, 8).alias(x) for x in ("mean", "sd", "median", "q1", "q3")))


@query(
    "agg_14_pae_stability",
    f"""WITH {v.CELLS}, {_MODELS}, p AS (SELECT matrix_id, round(min(pae), 8) AS mipae, round(avg(pae), 8) AS aipae FROM cell WHERE pae IS NOT NULL GROUP BY 1)
    SELECT a, b, array_to_string(combo, '|') AS combo, rank, {_FIVE.format('mipae', 'mipae_')}, {_FIVE.format('aipae', 'aipae_')} FROM p JOIN model USING (matrix_id) GROUP BY a, b, model.combo, rank""",
)
def agg_14(spark, d):
    """Per pair, combination and rank over its chain pairs."""
    p = v.cells(spark, d).where("pae IS NOT NULL").groupBy("matrix_id").agg(F.round(F.min("pae"), 8).alias("mipae"), F.round(F.avg("pae"), 8).alias("aipae"))
    out = st.pae_stability(_models(spark, d).select("matrix_id", "a", "b", "combo", "rank").join(p, "matrix_id"), ["a", "b", "combo", "rank"])
    return out.select("a", "b", _combo(), "rank", *(F.round(x, 8).alias(x) for x in out.columns[4:]))


@query(
    "agg_15_contact_frequency",
    f"""WITH {v.CONTACTS}, md AS (SELECT DISTINCT matrix_id, least(p1, p2) AS a, greatest(p1, p2) AS b, n_chains FROM cell WHERE p1 IS NOT NULL AND p2 IS NOT NULL),
    n AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE n_chains = 2) AS n2, count(*) FILTER (WHERE n_chains > 2) AS nn FROM md GROUP BY 1, 2),
    k AS (SELECT a, b, i, j, count(*) AS k, count(*) FILTER (WHERE n_chains = 2) AS k2, count(*) FILTER (WHERE n_chains > 2) AS kn FROM contact GROUP BY ALL)
    SELECT a, b, i, j, round(k / n, 8) AS freq, round(CASE WHEN n2 > 0 THEN k2 / n2 ELSE 0 END, 8) AS freq2, round(CASE WHEN nn > 0 THEN kn / nn ELSE 0 END, 8) AS freqn FROM k JOIN n USING (a, b)""",
)
def agg_15(spark, d):
    out = _frequency(spark, d)
    return out.select("a", "b", "i", "j", *(F.round(x, 8).alias(x) for x in ("freq", "freq2", "freqn")))


def _frequency(spark, d):
    return c.contact_frequency(v.contacts(spark, d), v.shapes(spark, d).select("matrix_id", "a", "b", "n_chains"))


@query(
    "agg_16_rank_metrics",
    f"""WITH {v.PWN}, r AS (SELECT combo, rank, round(avg(ptm), 8) AS ptm, round(avg(iptm), 8) AS iptm, max(pdockq) AS pdockq, min(min_pae) AS mipae, round(avg(min_pae), 8) AS aipae FROM pwn WHERE combo IS NOT NULL GROUP BY 1, 2)
    SELECT array_to_string(combo, '|') AS combo, count(*) AS n_ranks, {", ".join(f"string_agg(coalesce(format('{{:.4f}}', {x}), '-'), ',' ORDER BY rank) AS {x}s" for x in ("pdockq", "mipae"))}, max(ptm) AS best_ptm, max(iptm) AS best_iptm, min(aipae) AS best_aipae FROM r GROUP BY combo""",
)
def agg_16(spark, d):
    r = v.pairwise_n(spark, d).where("combo IS NOT NULL").groupBy("combo", "rank").agg(*(F.round(F.avg(x), 8).alias(x) for x in ("ptm", "iptm")), F.max("pdockq").alias("pdockq"), F.min("min_pae").alias("mipae"), F.round(F.avg("min_pae"), 8).alias("aipae"))
    series_of = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(F.when(F.col(x).isNotNull(), F.format_string("%.4f", F.col(x))), F.lit("-")).alias("s")))), lambda y: y["s"]), ",")
    return r.groupBy("combo").agg(F.count("*").alias("n_ranks"), series_of("pdockq").alias("pdockqs"), series_of("mipae").alias("mipaes"), F.max("ptm").alias("best_ptm"), F.max("iptm").alias("best_iptm"), F.min("aipae").alias("best_aipae")).withColumn("combo", _combo())


@query("agg_17_metadata_stats", f"WITH {v.PWN} SELECT len(combo) AS size, min(min_pae) AS lo, max(min_pae) AS hi, round(avg(min_pae), 8) AS mean, round(median(min_pae), 8) AS median FROM pwn WHERE combo IS NOT NULL GROUP BY 1")
def agg_17(spark, d):
    """The sizes are few and each holds a share of all rows: the median comes from running counts of the values, not from one task."""
    x = v.pairwise_n(spark, d).where("combo IS NOT NULL").select(F.size("combo").alias("size"), "min_pae")
    whole = x.groupBy("size").agg(F.min("min_pae").alias("lo"), F.max("min_pae").alias("hi"), F.round(F.avg("min_pae"), 8).alias("mean"))
    return whole.join(st.quantile(x, ["size"], "min_pae", 0.5, "median"), "size", "left").withColumn("median", F.round("median", 8))


@query(
    "agg_19_residue_variation",
    f"""WITH {v.ATOMS}, {v.CHAINS} SELECT prot_id, res_no, round(avg(bfactor), 8) AS mean, round(stddev_pop(bfactor) / (avg(bfactor) + 1e-8), 8) AS cv FROM atom a JOIN chain c ON c.file_id = a.file_id AND c.chain_id = a.chain WHERE prot_id IS NOT NULL GROUP BY 1, 2""",
)
def agg_19(spark, d):
    chains = v.chains(spark, d).where("prot_id IS NOT NULL").select("file_id", F.col("chain_id").alias("chain"), "prot_id")
    rows = v.atoms(spark, d).join(chains, ["file_id", "chain"]).groupBy("prot_id", "res_no").agg(*st.variation(F.col("bfactor")))
    return rows.select("prot_id", "res_no", F.round("mean", 8).alias("mean"), F.round("cv", 8).alias("cv"))


@query(
    "agg_20_partner_enrichment",
    f"""WITH {v.PWN}, e AS (SELECT p1 AS protein, unnest(combo) AS partner FROM pwn WHERE combo IS NOT NULL), n AS (SELECT protein, partner, count(*) - CASE WHEN protein = partner THEN (SELECT count(*) FROM pwn w WHERE w.p1 = protein AND w.combo IS NOT NULL AND list_contains(w.combo, w.p1)) ELSE 0 END AS n FROM e GROUP BY 1, 2)
    SELECT protein, partner AS representative, n FROM n WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY protein ORDER BY n DESC, partner) = 1""",
)
def agg_20(spark, d):
    """The protein itself counts one time less in each model that has it."""
    x = v.pairwise_n(spark, d).where("combo IS NOT NULL")
    others = F.filter("combo", lambda q: q != F.col("p1"))
    itself = F.array_repeat(F.col("p1"), F.greatest(m.copies(F.col("combo"), F.col("p1")) - 1, F.lit(0)))
    n = x.select(F.col("p1").alias("protein"), F.explode(F.concat(others, itself)).alias("partner")).groupBy("protein", "partner").agg(F.count("*").alias("n"))
    return ppi.best_rows(n, ["protein"], [F.col("n").desc(), F.col("partner")]).select("protein", F.col("partner").alias("representative"), "n")


@query(
    "agg_21_ngram_scores",
    r"""WITH w AS (SELECT p_brand, p_partkey, list_filter(string_split(trim(regexp_replace(lower(p_type || ' ' || p_name), '[_\-/\s]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND regexp_matches(w, '^[a-z]+$') AND NOT list_contains(STOP, w)) AS w FROM part),
    one AS (SELECT p_brand, p_partkey, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    g AS (GRAMS), n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), f AS (SELECT p_brand, g, k, count(*) / any_value(n) AS freq FROM g JOIN n USING (p_brand) WHERE g IS NOT NULL GROUP BY 1, 2, 3)
    SELECT p_brand, g AS pattern, round(freq + 0.15 * k + CASE WHEN freq BETWEEN 0.1 AND 0.7 THEN 0.1 ELSE 0 END, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(freq + 0.15 * k + CASE WHEN freq BETWEEN 0.1 AND 0.7 THEN 0.1 ELSE 0 END, 6) DESC, g) = 1"""
    .replace("STOP", str(list(t.STOP_WORDS)))
    .replace("GRAMS", " UNION ".join(f"SELECT DISTINCT p_brand, p_partkey, {n} AS k, " + " || ' ' || ".join(["x"] + [f"lead(x, {k}) OVER (PARTITION BY p_partkey ORDER BY i)" for k in range(1, n)]) + " AS g FROM one" for n in range(1, 5))),
)
def agg_21(spark, d):
    """The most telling pattern of the descriptions of each group."""
    parts = table(spark, d, "part").select("p_brand", "p_partkey", t.normal_words(F.concat_ws(" ", "p_type", "p_name")).alias("w"))
    grams = parts.select("p_brand", "p_partkey", F.explode(F.array_distinct(t.ngrams(F.col("w")))).alias("g"))
    total = parts.groupBy("p_brand").agg(F.count("*").alias("n"))
    f = grams.groupBy("p_brand", "g").agg(F.count("*").alias("c")).join(total, "p_brand").withColumn("freq", F.col("c") / F.col("n"))
    score = F.round(F.col("freq") + 0.15 * F.size(F.split("g", " ")) + F.when(F.col("freq").between(0.1, 0.7), 0.1).otherwise(0.0), 6)
    return ppi.best_rows(f.withColumn("score", score), ["p_brand"], [F.col("score").desc(), F.col("g")]).select("p_brand", F.col("g").alias("pattern"), "score")


@query(
    "agg_23_gyration",
    f"""WITH {v.ATOMS}, c AS (SELECT file_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM atom GROUP BY 1)
    SELECT file_id, round(sqrt(avg((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz))), 8) AS rog, round((stddev_pop(x) + stddev_pop(y) + stddev_pop(z)) / 3, 8) AS rmsf FROM atom JOIN c USING (file_id) GROUP BY 1""",
)
def agg_23(spark, d):
    axes = [F.stddev_pop(x) for x in "xyz"]
    rog = F.sqrt(sum(F.var_pop(x) for x in "xyz"))
    return v.atoms(spark, d).groupBy("file_id").agg(F.round(rog, 8).alias("rog"), F.round(sum(axes) / 3, 8).alias("rmsf"))


_EVAL = f"""WITH {v.PW2}, e0 AS (SELECT rank AS k, CASE WHEN pdockq >= 0.5 THEN 2 WHEN pdockq >= 0.23 THEN 1 WHEN pdockq IS NOT NULL THEN 0 END AS t, CASE WHEN iptm >= 0.8 THEN 2 WHEN iptm >= 0.5 THEN 1 WHEN iptm IS NOT NULL THEN 0 END AS g FROM pw2 WHERE rank IS NOT NULL),
e AS (SELECT * FROM e0 WHERE t IS NOT NULL AND g IS NOT NULL)"""


def _grades(spark, d):
    grade = lambda s, a, b: F.when(F.col(s) >= a, 2).when(F.col(s) >= b, 1).when(F.col(s).isNotNull(), 0)
    return v.pairwise2(spark, d).where("rank IS NOT NULL").select(F.col("rank").alias("k"), grade("pdockq", 0.5, 0.23).alias("t"), grade("iptm", 0.8, 0.5).alias("g"))


@query(
    "agg_24_classification_scores",
    _EVAL
    + """, w AS (SELECT k, avg((t = g)::INT) AS accuracy, avg((abs(t - g) <= 1)::INT) AS within_one, avg(abs(t - g)) AS mae, avg((t - g) * (t - g)) AS mse, sqrt(avg((t - g) * (t - g))) AS rmse, corr(t, g) AS pearson, count(*) AS n FROM e GROUP BY 1),
    c AS (SELECT k, c, (SELECT count(*) FROM e x WHERE x.k = y.k AND x.t = c) AS nt, (SELECT count(*) FROM e x WHERE x.k = y.k AND x.g = c) AS ng, (SELECT count(*) FROM e x WHERE x.k = y.k AND x.t = c AND x.g = c) AS hit FROM (SELECT k, t AS c FROM e UNION SELECT k, g FROM e) y),
    pr AS (SELECT *, CASE WHEN ng > 0 THEN hit / ng ELSE 0 END AS p, CASE WHEN nt > 0 THEN hit / nt ELSE 0 END AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),
    m AS (SELECT k, avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f1) AS macro_f1, sum(p * nt) / sum(nt) AS weighted_precision, sum(r * nt) / sum(nt) AS weighted_recall, sum(f1 * nt) / sum(nt) AS weighted_f1 FROM f GROUP BY 1),
    rk AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY t) + (count(*) OVER (PARTITION BY k, t) - 1) / 2 AS rt, rank() OVER (PARTITION BY k ORDER BY g) + (count(*) OVER (PARTITION BY k, g) - 1) / 2 AS rg FROM e), sp AS (SELECT k, corr(rt, rg) AS spearman FROM rk GROUP BY 1),
    cov AS (SELECT k, avg((t IS NOT NULL AND g IS NOT NULL)::INT) AS coverage FROM e0 GROUP BY 1)
    SELECT k, n, round(coverage, 8) AS coverage, round(accuracy, 8) AS accuracy, round(within_one, 8) AS within_one, round(mae, 8) AS mae, round(mse, 8) AS mse, round(rmse, 8) AS rmse, round(pearson, 8) AS pearson, round(spearman, 8) AS spearman, round(macro_precision, 8) AS macro_precision,
    round(macro_recall, 8) AS macro_recall, round(macro_f1, 8) AS macro_f1, round(weighted_precision, 8) AS weighted_precision, round(weighted_recall, 8) AS weighted_recall, round(weighted_f1, 8) AS weighted_f1 FROM w JOIN m USING (k) JOIN sp USING (k) JOIN cov USING (k)""",
)
def agg_24(spark, d):
    out = st.classification_scores(_grades(spark, d), ["k"], "t", "g")
    return out.select("k", "n", *(F.round(y, 8).alias(y) for y in out.columns if y not in ("k", "n")))


_ROC = f"""WITH {v.PW2}, e AS (SELECT rank AS k, iptm AS s, pdockq >= 0.23 AS l FROM pw2 WHERE iptm IS NOT NULL AND pdockq IS NOT NULL AND rank IS NOT NULL),
    a AS (SELECT k, s, count(*) FILTER (WHERE l) AS p, count(*) FILTER (WHERE NOT l) AS n FROM e GROUP BY 1, 2),
    r AS (SELECT k, s, sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY k), 0) AS tpr, sum(n) OVER w / nullif(sum(n) OVER (PARTITION BY k), 0) AS fpr FROM a WINDOW w AS (PARTITION BY k ORDER BY s DESC)),
    z AS (SELECT *, (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS area FROM r WINDOW w AS (PARTITION BY k ORDER BY s DESC)),
    best AS (SELECT k, round(sum(area), 8) AS auc, arg_max(s, (round(tpr - fpr, 9), s)) AS best_threshold FROM z GROUP BY 1)"""


def _scored(spark, d):
    return v.pairwise2(spark, d).where("iptm IS NOT NULL AND pdockq IS NOT NULL AND rank IS NOT NULL").select(F.col("rank").alias("k"), F.col("iptm").alias("s"), (F.col("pdockq") >= 0.23).alias("l"))


@query("agg_25_roc", _ROC + " SELECT k, auc, best_threshold FROM best")
def agg_25(spark, d):
    out = st.auc(st.roc(_scored(spark, d), ["k"], "s", "l"), ["k"], "s")
    return out.select("k", F.round("auc", 8).alias("auc"), "best_threshold")


@query(
    "agg_25_confusion",
    _ROC + " SELECT k, count(*) FILTER (WHERE l AND s >= best_threshold) AS tp, count(*) FILTER (WHERE NOT l AND s >= best_threshold) AS fp, count(*) FILTER (WHERE l AND s < best_threshold) AS fn, count(*) FILTER (WHERE NOT l AND s < best_threshold) AS tn FROM e JOIN best USING (k) GROUP BY 1",
)
def agg_25b(spark, d):
    """Confusion matrix of each key at its best threshold."""
    x = _scored(spark, d).join(agg_25(spark, d), "k")
    hit = F.col("s") >= F.col("best_threshold")
    return x.groupBy("k").agg(F.count_if(F.col("l") & hit).alias("tp"), F.count_if(~F.col("l") & hit).alias("fp"), F.count_if(F.col("l") & ~hit).alias("fn"), F.count_if(~F.col("l") & ~hit).alias("tn"))


@query(
    "agg_25_comparison",
    " UNION ALL ".join(
        f"""SELECT '{metric}' AS metric, * FROM (WITH {v.PW2}, e AS (SELECT {sign}{metric} AS s, pdockq >= 0.23 AS l FROM pw2 WHERE {metric} IS NOT NULL AND pdockq IS NOT NULL), a AS (SELECT s, count(*) FILTER (WHERE l) AS p, count(*) FILTER (WHERE NOT l) AS n FROM e GROUP BY 1),
        r AS (SELECT s, sum(p) OVER w / nullif(sum(p) OVER (), 0) AS tpr, sum(n) OVER w / nullif(sum(n) OVER (), 0) AS fpr FROM a WINDOW w AS (ORDER BY s DESC)), z AS (SELECT *, (fpr - coalesce(lag(fpr) OVER (ORDER BY s DESC), 0)) * (tpr + coalesce(lag(tpr) OVER (ORDER BY s DESC), 0)) / 2 AS area FROM r)
        SELECT round(sum(area), 8) AS auc, arg_max(s, (round(tpr - fpr, 9), s)) AS best_threshold FROM z)"""
        for metric, sign in (("iptm", ""), ("ptm", ""), ("min_pae", "-"))
    ),
)
def agg_25c(spark, d):
    """Comparison of methods: the same curve for every metric (a smaller PAE is better)."""
    metrics = F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), s.alias("s")) for n, s in (("iptm", F.col("iptm")), ("ptm", F.col("ptm")), ("min_pae", -F.col("min_pae"))))))
    x = v.pairwise2(spark, d).where("pdockq IS NOT NULL").select((F.col("pdockq") >= 0.23).alias("l"), metrics).where("s IS NOT NULL")
    out = st.auc(st.roc(x, ["metric"], "s", "l"), ["metric"], "s")
    return out.select("metric", F.round("auc", 8).alias("auc"), "best_threshold")


_CONVERGENT = f"""{v.PWN}, states AS (SELECT combo, count(DISTINCT rank) FILTER (WHERE min_pae <= 7.5) >= 4 AS is_stable FROM pwn WHERE combo IS NOT NULL AND len(combo) > 0 GROUP BY 1),
    del AS (SELECT DISTINCT combo AS child, list_filter(combo, lambda x, i: i <> k) AS parent FROM (SELECT combo, unnest(range(1, len(combo) + 1)) AS k FROM states)), le AS (SELECT parent, child FROM del WHERE parent IN (SELECT combo FROM states)),
    kid AS (SELECT parent AS combo, bool_or(s.is_stable) AS any_stable FROM le JOIN states s ON s.combo = le.child GROUP BY 1), conv AS (SELECT states.combo FROM states JOIN kid ON kid.combo = states.combo WHERE is_stable AND NOT any_stable)"""


@query(
    "agg_26_convergent_sizes",
    f"""WITH {_CONVERGENT}, m AS (SELECT unnest(list_distinct(combo)) AS protein, len(combo) AS n FROM conv), p AS (SELECT DISTINCT unnest(combo) AS protein FROM states)
    SELECT p.protein, coalesce(min(m.n), 1) AS size FROM p LEFT JOIN m USING (protein) GROUP BY 1""",
)
def agg_26(spark, d):
    """Smallest convergent combination of each protein (LAT-3), 1 where there is none."""
    x = v.pairwise_n(spark, d).where("combo IS NOT NULL AND size(combo) > 0")
    states = x.groupBy("combo").agg((F.count_distinct(F.when(F.col("min_pae") <= 7.5, F.col("rank"))) >= 4).alias("is_stable"))
    each = la.convergence(states, la.containment_edges(states)).select(F.explode(F.array_distinct("combo")).alias("protein"), F.size("combo").alias("n"), "is_convergent")
    return each.groupBy("protein").agg(F.coalesce(F.min(F.when(F.col("is_convergent"), F.col("n"))), F.lit(1)).alias("size"))


# --- joins ---


@query("jn_1_passing_best", _AGG1 + " SELECT f1.p1, f1.p2, n_models, iptm FROM f1 JOIN f2 ON f1.p1 = f2.p1 AND f1.p2 = f2.p2")
def jn_1(spark, d):
    x = v.pairwise2(spark, d)
    f1 = x.where("min_pae <= 7.5 AND iptm >= 0").groupBy("p1", "p2").agg(F.count("*").alias("n_models")).where("n_models >= 4")
    return f1.join(x.groupBy("p1", "p2").agg(F.max("iptm").alias("iptm")), ["p1", "p2"])


@query("jn_2_combination_join", _AGG2 + " SELECT f3n.p1, f3n.p2, array_to_string(f3n.combo, '|') AS combo, count(*) AS n_rows FROM f3n JOIN pwn USING (p1, p2, combo) GROUP BY f3n.p1, f3n.p2, f3n.combo")
def jn_2(spark, d):
    rows = v.pairwise_n(spark, d).select("p1", "p2", "combo")
    return passing_n(spark, d).select("p1", "p2", "combo").join(rows, ["p1", "p2", "combo"]).groupBy("p1", "p2", "combo").agg(F.count("*").alias("n_rows")).withColumn("combo", _combo())


@query("jn_3_chain_proteins", f"WITH {v.CHAINS} SELECT file_id, chain_id, prot_id, p.len AS known_length, p.prot_name FROM chain JOIN proteins p USING (prot_id)")
def jn_3(spark, d):
    """The protein table is joined as it comes: the planner broadcasts it only below its size threshold."""
    p = table(spark, d, "proteins").select("prot_id", F.col("len").alias("known_length"), "prot_name")
    return v.chains(spark, d).join(p, "prot_id").select("file_id", "chain_id", "prot_id", "known_length", "prot_name")


@query("jn_4_unordered_join", _AGG1 + " SELECT DISTINCT w.row_id FROM pw2 w JOIN f3 ON (w.p1 = f3.p1 AND w.p2 = f3.p2) OR (w.p1 = f3.p2 AND w.p2 = f3.p1)")
def jn_4(spark, d):
    keys = passing2(spark, d).select(*ab()).distinct()
    return v.pairwise2(spark, d).select("row_id", *ab()).join(keys, ["a", "b"], "left_semi").select("row_id")


@query("jn_5_semi_join", _AGG2 + " SELECT row_id FROM pwn SEMI JOIN f3n USING (p1, p2, combo)")
def jn_5(spark, d):
    return v.pairwise_n(spark, d).join(passing_n(spark, d), ["p1", "p2", "combo"], "left_semi").select("row_id")


@query("jn_6_chain_pairs", f"WITH {v.CHAINS} SELECT a.file_id, a.chain_id AS c1, b.chain_id AS c2, a.prot_id AS p1, b.prot_id AS p2 FROM chain a JOIN chain b ON a.file_id = b.file_id AND a.ix < b.ix")
def jn_6(spark, d):
    """All chain pairs of a file, from its own array: no shuffle."""
    x = table(spark, d, "all_pdb_data").select("file_id", "chains", F.posexplode("chains").alias("ix", "one"))
    y = x.select("file_id", "one", F.explode(F.slice("chains", F.col("ix") + 2, F.size("chains"))).alias("two"))
    from chainlake.functions.ids import protein_id

    return y.select("file_id", F.col("one.chain_id").alias("c1"), F.col("two.chain_id").alias("c2"), protein_id("one.protein_id").alias("p1"), protein_id("two.protein_id").alias("p2"))


@query(
    "jn_7_contacts_by_distance",
    f"""WITH {v.ATOMS} SELECT a.file_id, a.chain AS chain_1, b.chain AS chain_2, a.res_no AS res_no_1, b.res_no AS res_no_2, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 8) AS dist
    FROM atom a JOIN atom b ON a.file_id = b.file_id AND a.chain < b.chain WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 8""",
)
def jn_7(spark, d):
    near = c.near_points(v.atoms(spark, d), ["file_id"], "chain", 8.0, ["res_no"])
    return near.select("file_id", "chain_1", "chain_2", "res_no_1", "res_no_2", F.round("dist", 8).alias("dist"))


@query(
    "jn_9_interval_overlap",
    f"""WITH {v.CHAINS}, seg AS (SELECT file_id, chain_id, prot_id, ix * 40 AS s, ix * 40 + least(length, 60) AS e FROM chain)
    SELECT x.file_id, x.chain_id AS c1, y.chain_id AS c2, x.s >= y.s AND x.e <= y.e AS contained FROM seg x JOIN seg y ON x.file_id = y.file_id AND x.chain_id < y.chain_id AND x.e >= y.s AND x.s <= y.e""",
)
def jn_9(spark, d):
    s = F.col("ix") * 40
    seg = v.chains(spark, d).select("file_id", "chain_id", s.alias("s"), (s + F.least("length", F.lit(60))).alias("e"))
    x, y = (seg.select("file_id", F.col("chain_id").alias(f"c{k}"), F.col("s").alias(f"s{k}"), F.col("e").alias(f"e{k}")) for k in (1, 2))
    both = x.join(y, "file_id").where("c1 < c2 AND e1 >= s2 AND s1 <= e2")
    return both.select("file_id", "c1", "c2", F.expr("s1 >= s2 AND e1 <= e2").alias("contained"))


@query("jn_11_edges_with_rows", _AGG1 + ", e AS (SELECT DISTINCT least(p1, p2) AS a, greatest(p1, p2) AS b FROM f3) SELECT a, b, count(*) AS n_rows, max(w.ptm) AS best_ptm FROM e JOIN pw2 w ON least(w.p1, w.p2) = a AND greatest(w.p1, w.p2) = b GROUP BY 1, 2")
def jn_11(spark, d):
    e = passing2(spark, d).select(*ab()).distinct()
    return v.pairwise2(spark, d).select(*ab(), "ptm").join(e, ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("n_rows"), F.max("ptm").alias("best_ptm"))


_KNOWN = f"""{v.PW2}, known AS (SELECT DISTINCT unnest([p1, p2]) AS p FROM pw2)"""


def _known(spark, d):
    return v.pairwise2(spark, d).select(F.explode(F.array("p1", "p2")).alias("p")).distinct()


_LEFT = """, o AS (SELECT p, count(*) OVER () - row_number() OVER (ORDER BY p) + 1 AS n_partners FROM known), c AS (SELECT a, count(*) AS n_done FROM done WHERE a IN (FROM known) AND b IN (FROM known) GROUP BY 1)
    SELECT p AS item, n_partners, coalesce(n_done, 0) AS n_done, n_partners - coalesce(n_done, 0) AS n_left FROM o LEFT JOIN c ON c.a = o.p"""


@query("jn_12_untested_pairs", f"WITH {_KNOWN}, done AS (SELECT DISTINCT least(p1, p2) AS a, greatest(p1, p2) AS b FROM pw2)" + _LEFT)
def jn_12(spark, d):
    """How many pairs of modelled proteins are untested, by the first protein of the pair."""
    return la.open_pairs(_known(spark, d), v.pairwise2(spark, d).select("p1", "p2"))


@query("jn_13_suggestions_left", f"WITH {_KNOWN}, f3 AS (SELECT {v.sql_id('protein1')} AS p1, {v.sql_id('protein2')} AS p2 FROM pairwise_2mers_df_f3), done AS (SELECT least(p1, p2) AS a, greatest(p1, p2) AS b FROM pw2 UNION SELECT least(p1, p2), greatest(p1, p2) FROM f3 WHERE p1 IS NOT NULL AND p2 IS NOT NULL)" + _LEFT)
def jn_13(spark, d):
    """The same less the pairs of the filtered table."""
    from chainlake.functions.ids import protein_id

    f3 = table(spark, d, "pairwise_2mers_df_f3").select(protein_id("protein1").alias("p1"), protein_id("protein2").alias("p2")).where("p1 IS NOT NULL AND p2 IS NOT NULL")
    return la.open_pairs(_known(spark, d), v.pairwise2(spark, d).select("p1", "p2").unionByName(f3))


@query("jn_14_parent_models", f"WITH {v.PWN}, {_MODELS} SELECT DISTINCT m.matrix_id, w.pred_id FROM model m JOIN pwn w ON m.combo = w.combo AND m.rank = w.rank")
def jn_14(spark, d):
    parents = v.pairwise_n(spark, d).select("combo", "rank", "pred_id").distinct()
    return _models(spark, d).select("matrix_id", "combo", "rank").join(parents, ["combo", "rank"]).select("matrix_id", "pred_id").distinct()


@query("jn_15_model_lookup", f"WITH {v.PW2} SELECT f.file_id, count(*) AS n_rows, max(w.iptm) AS iptm FROM all_pdb_data f JOIN pw2 w ON f.pred_id = w.pred_id AND f.rank = w.rank GROUP BY 1")
def jn_15(spark, d):
    files = table(spark, d, "all_pdb_data").select("file_id", "pred_id", "rank")
    return files.join(v.pairwise2(spark, d).select("pred_id", "rank", "iptm"), ["pred_id", "rank"]).groupBy("file_id").agg(F.count("*").alias("n_rows"), F.max("iptm").alias("iptm"))


@query("jn_18_nearest", """WITH q AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings)
    SELECT q.vec_id, arg_min(x.vec_id, (round(array_distance(q.e, x.e), 9), x.vec_id)) AS nearest FROM q JOIN x ON q.vec_id <> x.vec_id GROUP BY 1""")
def jn_18(spark, d):
    """Nearest other vector of every query vector (id divisible by 50), over all 64 numbers."""
    from chainlake.operators.clusters import nearest

    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(x.where("vec_id % 50 = 0"), x, "vec_id", "embedding")


@query("jn_19_radius_neighbours", f"""WITH {v.ATOMS} SELECT a.file_id, a.chain AS chain_1, b.chain AS chain_2, count(*) AS n_close FROM atom a JOIN atom b ON a.file_id = b.file_id AND a.chain < b.chain
    WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 4 GROUP BY 1, 2, 3""")
def jn_19(spark, d):
    return c.near_points(v.atoms(spark, d), ["file_id"], "chain", 4.0, []).groupBy("file_id", "chain_1", "chain_2").agg(F.count("*").alias("n_close"))


@query("jn_20_closest_candidate", f"""WITH {v.ATOMS}, c AS (SELECT file_id, chain, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atom GROUP BY 1, 2),
    o AS (SELECT a.file_id, a.chain, b.chain AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM c a LEFT JOIN c b ON a.file_id = b.file_id AND a.chain <> b.chain)
    SELECT file_id, chain, coalesce(arg_min(other, (round(dist, 9), other)), '') AS closest FROM o GROUP BY 1, 2""")
def jn_20(spark, d):
    """Closest other chain of each chain; empty where there is none."""
    ctr = v.atoms(spark, d).groupBy("file_id", "chain").agg(*(F.avg(x).alias(x) for x in "xyz"))
    other = ctr.select("file_id", F.col("chain").alias("other"), *(F.col(x).alias(f"{x}2") for x in "xyz"))
    dist = F.round(m.distance3([F.col(x) for x in "xyz"], [F.col(f"{x}2") for x in "xyz"]), 9)
    both = ctr.join(other, "file_id", "left").withColumn("other", F.when(F.col("chain") != F.col("other"), F.col("other")))
    best = F.min_by(F.col("other"), F.when(F.col("other").isNotNull(), F.struct(dist.alias("d"), "other")))
    return both.groupBy("file_id", "chain").agg(F.coalesce(best, F.lit("")).alias("closest"))


@query("jn_21_reconcile", f"""WITH {v.CHAINS}, c AS (SELECT DISTINCT prot_id FROM chain WHERE prot_id IS NOT NULL), j AS (SELECT c.prot_id AS c, p.prot_id AS p FROM c FULL JOIN proteins p ON c.prot_id = p.prot_id)
    SELECT CASE WHEN c IS NULL THEN 'only known' WHEN p IS NULL THEN 'only modelled' ELSE 'both' END AS side, count(*) AS n FROM j GROUP BY 1""")
def jn_21(spark, d):
    ch = v.chains(spark, d).where("prot_id IS NOT NULL").select("prot_id", F.lit(1).alias("c")).distinct()
    p = table(spark, d, "proteins").select("prot_id", F.lit(1).alias("p"))
    side = F.when(F.col("c").isNull(), "only known").when(F.col("p").isNull(), "only modelled").otherwise("both")
    return ch.join(p, "prot_id", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


# --- windows and sorts ---

_WIN1 = v.TRAJECTORY + """, x AS (SELECT protein, row_number() OVER o AS ord, (len(list_filter(combo, lambda q: q = protein)) >= 2)::INT AS present FROM traj WINDOW o AS (PARTITION BY protein ORDER BY min_pae, row_id)),
r AS (SELECT *, avg(present) OVER (PARTITION BY protein) AS f, CASE WHEN count(*) OVER w = 5 THEN avg(present) OVER w END AS r FROM x WINDOW w AS (PARTITION BY protein ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT protein, ord, CASE WHEN r IS NULL THEN NULL WHEN f IN (0, 1) THEN 0 WHEN r >= f THEN (r - f) / (1 - f) ELSE (r - f) / f END AS bias FROM r)"""


def _bias(spark, d):
    x = v.trajectory(spark, d).withColumn("present", m.copies(F.col("combo"), F.col("protein")) >= 2)
    return series.rolling_bias(x, ["protein"], ["min_pae", "row_id"], "present", 5)


_WIN1B = v.TRAJECTORY + """, t AS (SELECT protein, row_number() OVER (PARTITION BY protein ORDER BY min_pae, row_id) AS ord, combo, count(*) OVER (PARTITION BY protein) AS n FROM traj),
pt AS (SELECT DISTINCT protein, partner FROM (SELECT protein, unnest(list_distinct(combo)) AS partner, combo FROM t) WHERE len(list_filter(combo, lambda q: q = partner)) > (protein = partner)::INT),
x AS (SELECT t.protein, partner, ord, n, (len(list_filter(combo, lambda q: q = partner)) > (t.protein = partner)::INT)::INT AS present FROM t JOIN pt ON pt.protein = t.protein),
f AS (SELECT *, avg(present) OVER (PARTITION BY protein, partner) AS f FROM x), s AS (SELECT *, unnest([5, 10, 15, 20]) AS w FROM f),
c AS (SELECT *, (SELECT sum(y.present) FROM f y WHERE y.protein = s.protein AND y.partner = s.partner AND y.ord BETWEEN s.ord - w // 2 AND s.ord + w - 1 - w // 2) / w AS r FROM s WHERE ord > w // 2 AND ord <= n - (w - 1 - w // 2)),
b AS (SELECT protein, partner, w, ord, f, CASE WHEN f IN (0, 1) THEN 0 WHEN r >= f THEN (r - f) / (1 - f) ELSE (r - f) / f END AS bias FROM c)"""


@query(
    "win_1_bias_summary",
    "WITH " + _WIN1B + """ SELECT protein, partner, w AS width, round(any_value(f), 8) AS share, count(*) AS n_places, round(max(bias), 8) AS max_bias, round(min(bias), 8) AS min_bias, round(avg(bias), 8) AS mean_bias, arg_min(ord, (-round(bias, 9), ord)) AS peak FROM b GROUP BY 1, 2, 3""",
)
def win_1b(spark, d):
    """Bias of every partner of every protein, for all four windows."""
    placed = series.numbered(v.trajectory(spark, d), ["protein"], ["min_pae", "row_id"])
    out = series.partner_bias(placed, "protein", "ord", "combo")
    return out.select("protein", "partner", "width", "n_places", "peak", *(F.round(x, 8).alias(x) for x in ("share", "max_bias", "min_bias", "mean_bias")))


@query("win_1_rolling_bias", "WITH " + _WIN1 + " SELECT protein, ord, round(bias, 8) AS bias FROM b")
def win_1(spark, d):
    return _bias(spark, d).select("protein", "ord", F.round("bias", 8).alias("bias"))


@query("win_2_padded_bias", "WITH " + _WIN1 + """ SELECT protein, ord, round(coalesce(bias, last_value(bias IGNORE NULLS) OVER (PARTITION BY protein ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(bias IGNORE NULLS) OVER (PARTITION BY protein ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS bias FROM b""")
def win_2(spark, d):
    return series.padded(_bias(spark, d), ["protein"], "ord", "bias").select("protein", "ord", F.round("bias", 8).alias("bias"))


@query("win_3_stoichiometry", "WITH " + v.TRAJECTORY + " SELECT protein, row_number() OVER (PARTITION BY protein ORDER BY min_pae, row_id) AS ord, len(list_filter(combo, lambda q: q = protein)) AS n_copies FROM traj")
def win_3(spark, d):
    placed = series.numbered(v.trajectory(spark, d), ["protein"], ["min_pae", "row_id"])
    return placed.select("protein", "ord", m.copies(F.col("combo"), F.col("protein")).alias("n_copies"))


@query("win_4_moving_average", "SELECT event_id, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 8) AS mean_value FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def win_4(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return series.moving_average(rows, "value", ["event_type"], ["ts", "event_id"], 5).select("event_id", F.round("mean_value", 8).alias("mean_value"))


_SIZES = v.PWN + ", r AS (SELECT p1 AS protein, len(combo) AS n, round(avg(min_pae), 8) AS mean, round(stddev_samp(min_pae), 8) AS sd, count(*) AS k FROM pwn WHERE combo IS NOT NULL AND min_pae IS NOT NULL GROUP BY 1, 2)"


def _sizes(spark, d):
    x = v.pairwise_n(spark, d).where("combo IS NOT NULL AND min_pae IS NOT NULL")
    return x.groupBy(F.col("p1").alias("protein"), F.size("combo").alias("n")).agg(F.round(F.avg("min_pae"), 8).alias("mean"), F.round(F.stddev_samp("min_pae"), 8).alias("sd"), F.count("*").alias("k"))


@query("win_5_fallback_ranges", "WITH " + _SIZES + """, m AS (SELECT *, (mean + lead(mean) OVER w) / 2 AS mid, lead(mean) OVER w IS NULL AS final FROM r WINDOW w AS (PARTITION BY protein ORDER BY n)),
    u AS (SELECT protein, n, CASE WHEN final THEN 1000.0 ELSE max(mid) OVER (PARTITION BY protein ORDER BY n ROWS UNBOUNDED PRECEDING) END AS upper FROM m)
    SELECT protein, n, round(upper, 8) AS upper, round(coalesce(lag(upper) OVER (PARTITION BY protein ORDER BY n), 0), 8) AS lower FROM u""")
def win_5(spark, d):
    return series.fallback_ranges(_sizes(spark, d), "protein", "n", "mean").select("protein", "n", F.round("upper", 8).alias("upper"), F.round("lower", 8).alias("lower"))


@query("win_6_first_drop", "WITH " + _SIZES + ", b AS (SELECT *, lag(mean) OVER (PARTITION BY protein ORDER BY n) AS b FROM r) SELECT protein, min(n) FILTER (WHERE mean < b * 0.8) AS first_drop FROM b GROUP BY 1")
def win_6(spark, d):
    return series.first_drop(_sizes(spark, d), "protein", "n", "mean")


@query("win_7_islands", """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c), s AS (SELECT user_id, run, count(*) AS n, min(event_type) AS l FROM r GROUP BY 1, 2),
    f AS (SELECT user_id, run, CASE WHEN lag(l) OVER w = lead(l) OVER w AND n <= 1 THEN lag(l) OVER w ELSE l END AS merged FROM s WINDOW w AS (PARTITION BY user_id ORDER BY run)),
    g AS (SELECT event_id, r.user_id, ts, merged FROM r JOIN f USING (user_id, run)), h AS (SELECT *, CASE WHEN lag(merged) OVER w IS NOT DISTINCT FROM merged AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, merged, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM h""")
def win_7(spark, d):
    return series.merge_loops(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 1).select("event_id", "merged", "run")


@query("win_8_longest_start", "WITH " + _SIZES + ", i AS (SELECT DISTINCT protein, n, n - row_number() OVER w AS i, min(n) OVER (PARTITION BY protein) AS lo FROM r WINDOW w AS (PARTITION BY protein ORDER BY n)) SELECT protein, max(n) AS last FROM i WHERE i = lo - 1 GROUP BY 1")
def win_8(spark, d):
    return series.longest_start(_sizes(spark, d), "protein", "n")


@query("win_8_missing_states", "WITH " + _SIZES + ", t AS (SELECT protein, max(n) AS top FROM r GROUP BY 1 HAVING max(n) >= 3), a AS (SELECT protein, unnest(range(3, top + 1))::INT AS n FROM t) SELECT protein, n FROM a EXCEPT SELECT protein, n FROM r")
def win_8b(spark, d):
    return series.missing_states(_sizes(spark, d), "protein", "n")


@query("win_9_min_max", "SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 8) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def win_9(spark, d):
    return series.min_max(table(spark, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"]).select("event_id", F.round("scaled", 8).alias("scaled"))


@query("srt_1_sorted_rows", f"WITH {v.PWN} SELECT row_id, row_number() OVER (PARTITION BY pred_id ORDER BY combo NULLS FIRST, c1 NULLS FIRST, c2 NULLS FIRST, rank NULLS FIRST, row_id) AS place FROM pwn")
def srt_1(spark, d):
    return v.pairwise_n(spark, d).select("row_id", F.row_number().over(Window.partitionBy("pred_id").orderBy("combo", "c1", "c2", "rank", "row_id")).alias("place"))


@query("srt_2_trajectory_order", "WITH " + v.TRAJECTORY + " SELECT protein, row_id, row_number() OVER (PARTITION BY protein ORDER BY min_pae, row_id) AS traj_n FROM traj")
def srt_2(spark, d):
    return series.numbered(v.trajectory(spark, d), ["protein"], ["min_pae", "row_id"], name="traj_n").select("protein", "row_id", "traj_n")


@query("srt_3_best_index", f"WITH {v.PW2} SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, arg_min(row_id, (min_pae, row_id)) FILTER (WHERE min_pae IS NOT NULL) AS best FROM pw2 GROUP BY 1, 2")
def srt_3(spark, d):
    return v.pairwise2(spark, d).groupBy(*ab()).agg(F.min_by("row_id", F.when(F.col("min_pae").isNotNull(), F.struct("min_pae", "row_id"))).alias("best"))


@query("srt_4_relabel", f"WITH {v.CONTACTS}, t AS (SELECT a, b, rank, count(*) AS n FROM contact WHERE rank IS NOT NULL GROUP BY 1, 2, 3) SELECT a, b, rank AS old_label, dense_rank() OVER (PARTITION BY a, b ORDER BY n DESC, rank) - 1 AS new_label FROM t")
def srt_4(spark, d):
    totals = v.contacts(spark, d).where("rank IS NOT NULL").groupBy("a", "b", "rank").agg(F.count("*").alias("n"))
    w = Window.partitionBy("a", "b").orderBy(F.col("n").desc(), "rank")
    return totals.select("a", "b", F.col("rank").alias("old_label"), (F.dense_rank().over(w) - 1).alias("new_label"))


@query("srt_5_largest_state", _AGG2 + " SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, array_to_string(arg_max(combo, (len(combo), combo)), '|') AS state FROM f3n GROUP BY 1, 2")
def srt_5(spark, d):
    return passing_n(spark, d).groupBy(*ab()).agg(F.array_join(F.max_by("combo", F.struct(F.size("combo"), "combo")), "|").alias("state"))


@query("srt_6_best_methods", f"WITH {v.PW2} SELECT row_id, iptm FROM pw2 WHERE iptm IS NOT NULL ORDER BY iptm DESC, row_id LIMIT 15")
def srt_6(spark, d):
    return v.pairwise2(spark, d).where("iptm IS NOT NULL").select("row_id", "iptm").orderBy(F.col("iptm").desc(), "row_id").limit(15)


# --- sets ---


@query("set_1_edge_union", f"WITH {v.PW2}, {v.PWN} SELECT least(p1, p2) AS a, greatest(p1, p2) AS b FROM pw2 UNION SELECT least(p1, p2), greatest(p1, p2) FROM pwn")
def set_1(spark, d):
    return v.pairwise2(spark, d).select(*ab()).unionByName(v.pairwise_n(spark, d).select(*ab())).distinct()


@query("set_2_combinations", "SELECT a.r_name || '|' || b.r_name || '|' || c.r_name AS members FROM region a JOIN region b ON a.r_name <= b.r_name JOIN region c ON b.r_name <= c.r_name")
def set_2(spark, d):
    return la.combinations(table(spark, d, "region").select("r_name"), 3).select(F.array_join("members", "|").alias("members"))


@query("set_2_limited_combinations", "SELECT a.r_name || '|' || b.r_name || '|' || c.r_name AS members FROM region a JOIN region b ON a.r_name <= b.r_name JOIN region c ON b.r_name <= c.r_name WHERE NOT (a.r_name = b.r_name AND b.r_name = c.r_name)")
def set_2b(spark, d):
    return la.combinations(table(spark, d, "region").select("r_name"), 3, most_copies=2).select(F.array_join("members", "|").alias("members"))


@query("set_3_computed", f"WITH {v.PWN} SELECT DISTINCT array_to_string(combo, '|') AS combo FROM pwn WHERE combo IS NOT NULL")
def set_3(spark, d):
    return v.pairwise_n(spark, d).where("combo IS NOT NULL").select("combo").distinct().select(_combo())


@query("set_4_difference", f"WITH {v.PW2}, {v.PWN} SELECT least(p1, p2) AS a, greatest(p1, p2) AS b FROM pwn EXCEPT SELECT least(p1, p2), greatest(p1, p2) FROM pw2")
def set_4(spark, d):
    return v.pairwise_n(spark, d).select(*ab()).subtract(v.pairwise2(spark, d).select(*ab()))


@query("set_5_iou", f"""WITH {v.CONTACTS}, s AS (SELECT a, b, matrix_id, list(i * 100000 + j) AS s, row_number() OVER (PARTITION BY a, b ORDER BY matrix_id) AS k FROM contact GROUP BY 1, 2, 3)
    SELECT x.matrix_id AS m1, y.matrix_id AS m2, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 8) AS iou FROM s x JOIN s y ON x.a = y.a AND x.b = y.b AND y.k = x.k + 1""")
def set_5(spark, d):
    """Intersection over union of each record's contacts with the next record of its pair."""
    s = v.contacts(spark, d).groupBy("a", "b", "matrix_id").agg(F.collect_set(F.col("i") * 100000 + F.col("j")).alias("s"))
    w = Window.partitionBy("a", "b").orderBy("matrix_id")
    n = s.select("matrix_id", "s", F.lead("matrix_id").over(w).alias("m2"), F.lead("s").over(w).alias("s2")).where("m2 IS NOT NULL")
    return n.select(F.col("matrix_id").alias("m1"), "m2", F.round(F.size(F.array_intersect("s", "s2")) / F.size(F.array_union("s", "s2")), 8).alias("iou"))


@query("set_6_multisets", f"""WITH {v.PWN}, s AS (SELECT DISTINCT combo FROM pwn WHERE combo IS NOT NULL AND len(combo) > 0), p AS (SELECT combo, lead(combo) OVER (ORDER BY combo) AS next FROM s),
    n AS (SELECT combo, next, list_distinct(list_concat(combo, next)) AS u FROM p WHERE next IS NOT NULL)
    SELECT array_to_string(combo, '|') AS combo, list_sum(list_transform(u, lambda x: least(len(list_filter(combo, lambda q: q = x)), len(list_filter(next, lambda q: q = x)))))::INT AS common,
    list_sum(list_transform(u, lambda x: greatest(len(list_filter(combo, lambda q: q = x)), len(list_filter(next, lambda q: q = x)))))::INT AS united FROM n""")
def set_6(spark, d):
    """Multiset intersection and union with the next combination in order, found by range sort, not in one window."""
    s = v.pairwise_n(spark, d).where("combo IS NOT NULL AND size(combo) > 0").select("combo").distinct()
    pairs = la.consecutive(s, "combo")
    sized = pairs.withColumns({"common": la.multiset_common(F.col("combo"), F.col("next")), "united": la.multiset_united(F.col("combo"), F.col("next"))})
    return sized.select(_combo(), "common", "united")


@query("set_7_isolated", f"""WITH {v.PW2}, e AS (SELECT p1 AS p, p2 AS q, min_pae FROM pw2 UNION ALL SELECT p2, p1, min_pae FROM pw2) SELECT p AS protein, count(DISTINCT q) AS n_tested FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE min_pae <= 7.5) = 0 AND count(DISTINCT q) >= 2""")
def set_7(spark, d):
    x = v.pairwise2(spark, d).select(F.inline(F.array(F.struct(F.col("p1").alias("p"), F.col("p2").alias("q"), "min_pae"), F.struct(F.col("p2").alias("p"), F.col("p1").alias("q"), "min_pae"))))
    return x.groupBy(F.col("p").alias("protein")).agg(F.count_distinct("q").alias("n_tested"), F.count_if(F.col("min_pae") <= 7.5).alias("hits")).where("hits = 0 AND n_tested >= 2").drop("hits")
