"""The test tables in the clean logical form that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions.ids import protein_id
from chainlake.plans.catalog import table


def sql_id(column: str) -> str:
    return rf"nullif(upper(regexp_replace({column}, '^\s+|\s+$', '', 'g')), '')"


def _score(name: str):
    return F.when(~F.isnan(name), F.col(name)).alias(name)


def pairwise2(spark: SparkSession, folder: str) -> DataFrame:
    """2-mer rows with both IDs, canonical; NaN scores are null."""
    rows = table(spark, folder, "pairwise_2mers_df").select(
        "row_id", "pred_id", protein_id("protein1").alias("p1"), protein_id("protein2").alias("p2"), "length1", "length2", "rank", "ptm", _score("iptm"), "min_pae", "pdockq", "ppv"
    )
    return rows.where("p1 IS NOT NULL AND p2 IS NOT NULL")


PW2 = f"""pw2 AS (SELECT row_id, pred_id, {sql_id('protein1')} AS p1, {sql_id('protein2')} AS p2, length1, length2, rank, ptm,
CASE WHEN isnan(iptm) THEN NULL ELSE iptm END AS iptm, min_pae, pdockq, ppv FROM pairwise_2mers_df
WHERE {sql_id('protein1')} IS NOT NULL AND {sql_id('protein2')} IS NOT NULL)"""


def pairwise_n(spark: SparkSession, folder: str) -> DataFrame:
    """N-mer rows with both IDs; pim is the model's IDs in chain order (null and blank members dropped, null for a null list), combo the sorted ones."""
    pim = F.filter(F.transform("proteins_in_model", protein_id), lambda p: p.isNotNull())
    rows = table(spark, folder, "pairwise_nmers_df").select(
        "row_id", "pred_id", protein_id("protein1").alias("p1"), protein_id("protein2").alias("p2"), pim.alias("pim"), F.array_sort(pim).alias("combo"),
        F.element_at("pair_chains_tuple", 1).alias("c1"), F.element_at("pair_chains_tuple", 2).alias("c2"), "length1", "length2", "rank", "ptm", _score("iptm"), "min_pae", "pdockq", "cluster",
    )
    return rows.where("p1 IS NOT NULL AND p2 IS NOT NULL")


PWN = f"""pwn AS (SELECT row_id, pred_id, {sql_id('protein1')} AS p1, {sql_id('protein2')} AS p2,
list_filter(list_transform(proteins_in_model, lambda x: {sql_id('x')}), lambda x: x IS NOT NULL) AS pim,
list_sort(list_filter(list_transform(proteins_in_model, lambda x: {sql_id('x')}), lambda x: x IS NOT NULL)) AS combo,
pair_chains_tuple[1] AS c1, pair_chains_tuple[2] AS c2, length1, length2, rank, ptm, CASE WHEN isnan(iptm) THEN NULL ELSE iptm END AS iptm, min_pae, pdockq, cluster
FROM pairwise_nmers_df WHERE {sql_id('protein1')} IS NOT NULL AND {sql_id('protein2')} IS NOT NULL)"""


def chains(spark: SparkSession, folder: str) -> DataFrame:
    """One row per delivered file and chain."""
    rows = table(spark, folder, "all_pdb_data").select("file_id", "pred_id", "rank", F.posexplode("chains").alias("ix", "c"))
    return rows.select("file_id", "pred_id", "rank", "ix", "c.chain_id", protein_id("c.protein_id").alias("prot_id"), "c.length")


CHAINS = f"""chain AS (SELECT file_id, pred_id, rank, ix, c.chain_id AS chain_id, {sql_id('c.protein_id')} AS prot_id, c.length AS length FROM (
SELECT file_id, pred_id, rank, unnest(chains) AS c, generate_subscripts(chains, 1) - 1 AS ix FROM all_pdb_data))"""


def atoms(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ATOM line of every delivered file."""
    from chainlake.sources.pdb import parse_atoms

    return parse_atoms(table(spark, folder, "all_pdb_data").select("file_id", "content"), "content", ["file_id"])


ATOMS = r"""atom AS (SELECT file_id, line, trim(substr(r, 1, 6)) AS record, TRY_CAST(trim(substr(r, 7, 5)) AS INTEGER) AS atom_no, trim(substr(r, 13, 4)) AS atom_name, trim(substr(r, 17, 1)) AS alt,
trim(substr(r, 18, 3)) AS res_name, substr(r, 22, 1) AS chain, TRY_CAST(trim(substr(r, 23, 4)) AS INTEGER) AS res_no, trim(substr(r, 27, 1)) AS ins,
TRY_CAST(trim(substr(r, 31, 8)) AS DOUBLE) AS x, TRY_CAST(trim(substr(r, 39, 8)) AS DOUBLE) AS y, TRY_CAST(trim(substr(r, 47, 8)) AS DOUBLE) AS z,
TRY_CAST(trim(substr(r, 55, 6)) AS DOUBLE) AS occ, TRY_CAST(trim(substr(r, 61, 6)) AS DOUBLE) AS bfactor
FROM (SELECT file_id, unnest(string_split_regex(content, '\r?\n|\r')) AS r, generate_subscripts(string_split_regex(content, '\r?\n|\r'), 1) - 1 AS line FROM all_pdb_data) WHERE starts_with(r, 'ATOM '))"""


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """One row per cell of every contact record whose matrices tell its contacts, rows belonging to protein1.

    That is is_contact, or pae and distance; pae, plddt, dist and given (is_contact) are null where their matrix is.
    """
    m = table(spark, folder, "pairwise_contact_matrices")
    told = m.where("is_contact IS NOT NULL OR (pae IS NOT NULL AND distance IS NOT NULL)")
    zipped = F.arrays_zip(*(F.coalesce(x, F.array()).alias(x) for x in ("is_contact", "pae", "min_plddt", "distance")))
    rows = told.select(
        "matrix_id", protein_id("protein1").alias("p1"), protein_id("protein2").alias("p2"), "rank", F.size("proteins_in_model").alias("n_chains"), F.posexplode(zipped).alias("i", "r"),
    )
    cols = {"given": "is_contact", "pae": "pae", "plddt": "min_plddt", "dist": "distance"}
    row = F.arrays_zip(*(F.coalesce(F.col(f"r.{x}"), F.array()).alias(n) for n, x in cols.items()))
    each = rows.select("matrix_id", "p1", "p2", "rank", "n_chains", "i", F.posexplode(row).alias("j", "c"))
    return each.select("matrix_id", "p1", "p2", "rank", "n_chains", "i", "j", *(F.col(f"c.{n}").cast("double").alias(n) for n in ("pae", "plddt", "dist")), "c.given")


CELLS = f"""crec AS (SELECT matrix_id, {sql_id('protein1')} AS p1, {sql_id('protein2')} AS p2, rank, len(proteins_in_model) AS n_chains, is_contact, pae, min_plddt, distance,
unnest(range(greatest(coalesce(len(is_contact), 0), coalesce(len(pae), 0), coalesce(len(min_plddt), 0), coalesce(len(distance), 0)))) AS i FROM pairwise_contact_matrices
WHERE is_contact IS NOT NULL OR (pae IS NOT NULL AND distance IS NOT NULL)),
crow AS (SELECT matrix_id, p1, p2, rank, n_chains, i, is_contact[i + 1] AS gr, pae[i + 1] AS pr, min_plddt[i + 1] AS lr, distance[i + 1] AS dr FROM crec),
cell AS (SELECT matrix_id, p1, p2, rank, n_chains, i, j, gr[j + 1] AS given, pr[j + 1]::DOUBLE AS pae, lr[j + 1]::DOUBLE AS plddt, dr[j + 1]::DOUBLE AS dist
FROM (SELECT *, unnest(range(greatest(coalesce(len(gr), 0), coalesce(len(pr), 0), coalesce(len(lr), 0), coalesce(len(dr), 0)))) AS j FROM crow))"""

#: Whether a cell is a contact: by pae and distance where they tell, else by is_contact; an unknown pLDDT is no objection.
TOLD = "coalesce(pae < 7.5 AND dist < 8, given, false) AND coalesce(plddt > 0, true)"


def shapes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per contact record with both IDs that cells() has any cell of, and their number, from the lengths of its arrays: (matrix_id, a, b, rank, n_chains, n_cells)."""
    told = table(spark, folder, "pairwise_contact_matrices").where("is_contact IS NOT NULL OR (pae IS NOT NULL AND distance IS NOT NULL)")
    names = ("is_contact", "pae", "min_plddt", "distance")
    lengths = (F.transform(F.coalesce(n, F.array()), lambda r: F.coalesce(F.size(r), F.lit(0))).alias(n) for n in names)
    longest = F.transform(F.arrays_zip(*lengths), lambda r: F.greatest(*(F.coalesce(r[n], F.lit(0)) for n in names)))
    n_cells = F.aggregate(longest, F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = told.select("matrix_id", protein_id("protein1").alias("p1"), protein_id("protein2").alias("p2"), "rank", F.size("proteins_in_model").alias("n_chains"), n_cells.alias("n_cells"))
    rows = rows.where("p1 IS NOT NULL AND p2 IS NOT NULL AND n_cells > 0")
    return rows.select("matrix_id", F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), "rank", "n_chains", "n_cells")


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """The contact cells, turned so that the smaller ID has the rows."""
    from chainlake.operators.contacts import contact_cells

    return contact_cells(cells(spark, folder))


CONTACTS = f"""{CELLS},
contact AS (SELECT matrix_id, least(p1, p2) AS a, greatest(p1, p2) AS b, rank, n_chains, CASE WHEN p1 > p2 THEN j ELSE i END AS i, CASE WHEN p1 > p2 THEN i ELSE j END AS j, pae, plddt, dist
FROM cell WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND {TOLD})"""


def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    """Models of each protein in order of a score: (protein, ord, combo), as the rolling operators take them."""
    rows = pairwise_n(spark, folder).where("pim IS NOT NULL AND min_pae IS NOT NULL")
    return rows.select(F.col("p1").alias("protein"), "min_pae", "row_id", "combo")


TRAJECTORY = PWN + """, traj AS (SELECT p1 AS protein, min_pae, row_id, combo FROM pwn WHERE pim IS NOT NULL AND min_pae IS NOT NULL)"""
