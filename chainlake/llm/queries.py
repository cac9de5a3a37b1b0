"""Named queries of this subpackage over the test tables, each over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions.ids import protein_id
from chainlake.llm import contact_modes, cooccurrence, leaks, packing, residue, topn
from chainlake.llm.components import connected_groups


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return contact_modes.recurring(contact_modes.contact_modes(_table(spark, folder, "pairwise_contact_matrices")))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return contact_modes.describe_clusters(contact_modes.contact_modes(_table(spark, folder, "pairwise_contact_matrices")))


def _pairs(spark: SparkSession, folder: str, min_count: int) -> DataFrame:
    return cooccurrence.supported_pairs(_table(spark, folder, "pairwise_nmers_df"), min_count=min_count)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence.above_chance(_pairs(spark, folder, 8)).select(F.col("item_a").alias("protein_a"), F.col("item_b").alias("protein_b"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    measures = [F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction")]
    return _pairs(spark, folder, 1).select(F.col("item_a").alias("protein_a"), F.col("item_b").alias("protein_b"), "n_ab", "n_a", "n_b", "n", *measures)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _table(spark, folder, "pairwise_2mers_df_f3").select(protein_id("protein1").alias("left"), protein_id("protein2").alias("right"))
    return connected_groups(pairs, "left", "right").withColumnRenamed("vertex", "protein")


def p3_complexes(spark: SparkSession, folder: str) -> DataFrame:
    return p3_found(spark, folder).groupBy("group_id").agg(F.count("*").alias("n_proteins"), F.max("protein").alias("last_protein"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return topn.best_models(_table(spark, folder, "pairwise_2mers_df")).select("protein_a", "protein_b", "row_id")


def p4_ranked(spark: SparkSession, folder: str) -> DataFrame:
    best = topn.best_models(_table(spark, folder, "pairwise_2mers_df"), n=10)
    return best.select("protein_a", "protein_b", "row_id", "iptm", "rank", F.col("position").cast("bigint").alias("position"))


def p6_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return packing.contexts(_table(spark, folder, "documents"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    packed = p6_contexts(spark, folder).groupBy("context_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_parts"))
    return packed.groupBy(F.col("n_tokens").alias("filled_tokens")).agg(F.count("*").alias("n_contexts"), F.sum("n_parts").alias("n_parts"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaking_documents(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("kind = 'verbatim'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(_table(spark, folder, "documents")).select("doc_id")


def p8_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_clusters, p2_found, p2_pairs, p3_found, p3_complexes, p4_found, p4_ranked, p6_contexts, p6_fill, p7_found, p7_leaks, p8_found, p8_reasons)
    return {f.__name__: f for f in named}


def _id(column: str) -> str:
    return rf"nullif(upper(regexp_replace({column}, '^\s+|\s+$', '', 'g')), '')"


_P2 = f"""
WITH counted AS (SELECT pred_id FROM pairwise_nmers_df WHERE pred_id IS NOT NULL GROUP BY pred_id HAVING bool_or(coalesce(contains(cluster, '✔'), false))),
raw AS (SELECT pred_id, unnest(proteins_in_model) AS x FROM pairwise_nmers_df WHERE pred_id IN (SELECT pred_id FROM counted)),
member AS (SELECT DISTINCT pred_id, {_id('x')} AS p FROM raw WHERE {_id('x')} IS NOT NULL),
alone AS (SELECT p, count(*) AS n FROM member GROUP BY p),
pair AS (SELECT a.p AS protein_a, b.p AS protein_b, count(*) AS n_ab FROM member a JOIN member b ON a.pred_id = b.pred_id AND a.p < b.p GROUP BY 1, 2),
scored AS (SELECT protein_a, protein_b, n_ab, a.n AS n_a, b.n AS n_b, (SELECT count(*) FROM counted) AS n FROM pair JOIN alone a ON a.p = protein_a JOIN alone b ON b.p = protein_b)
"""

_P3 = f"""
WITH RECURSIVE link AS (SELECT DISTINCT {_id('protein1')} AS a, {_id('protein2')} AS b FROM pairwise_2mers_df_f3 WHERE {_id('protein1')} IS NOT NULL AND {_id('protein2')} IS NOT NULL),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(protein, other) AS (SELECT a, b FROM edge UNION SELECT r.protein, e.b FROM reach r JOIN edge e ON r.other = e.a),
grouped AS (SELECT protein, least(protein, min(other)) AS group_id FROM reach GROUP BY protein)
"""

_P4 = f"""
WITH named AS (SELECT row_id, pred_id, rank, iptm, {_id('protein1')} AS p, {_id('protein2')} AS q FROM pairwise_2mers_df),
once AS (SELECT * FROM named WHERE p IS NOT NULL AND q IS NOT NULL AND iptm IS NOT NULL AND NOT isnan(iptm) QUALIFY row_number() OVER (PARTITION BY pred_id, rank ORDER BY row_id) = 1),
placed AS (SELECT least(p, q) AS protein_a, greatest(p, q) AS protein_b, row_id, iptm, rank, row_number() OVER (PARTITION BY least(p, q), greatest(p, q) ORDER BY iptm DESC, rank, row_id) AS position FROM once)
"""


_P1 = f"""
WITH rec AS (SELECT matrix_id AS m, {_id('protein1')} AS p, {_id('protein2')} AS q, is_contact, pae, distance, unnest(range(greatest(coalesce(len(is_contact), 0), coalesce(len(pae), 0)))) AS i FROM pairwise_contact_matrices WHERE is_contact IS NOT NULL OR (pae IS NOT NULL AND distance IS NOT NULL)),
line AS (SELECT m, p, q, i, is_contact[i + 1] AS g, pae[i + 1] AS pr, distance[i + 1] AS dr FROM rec WHERE p IS NOT NULL AND q IS NOT NULL),
cell AS (SELECT m, p, q, i, unnest(range(greatest(coalesce(len(g), 0), coalesce(len(pr), 0)))) AS j, g, pr, dr FROM line),
hit AS (SELECT m, least(p, q) AS a, greatest(p, q) AS b, CASE WHEN p > q THEN j ELSE i END AS i, CASE WHEN p > q THEN i ELSE j END AS j FROM cell WHERE CASE WHEN g IS NOT NULL THEN g[j + 1] ELSE pr[j + 1] < 7.5 AND dr[j + 1] < 8 END),
k AS (SELECT m, count(*) AS k FROM hit GROUP BY m HAVING count(*) >= 5), con AS (SELECT hit.* FROM hit JOIN k USING (m)),
shared AS (SELECT x.m AS m1, y.m AS m2, count(*) AS c FROM con x JOIN con y USING (a, b, i, j) GROUP BY 1, 2),
alike AS (SELECT m1, m2 FROM shared JOIN k k1 ON k1.m = m1 JOIN k k2 ON k2.m = m2 WHERE 2 * c >= k1.k + k2.k - c),
grouped AS (SELECT m1 AS matrix_id, min(m2) AS cluster_id, count(*) AS n FROM alike GROUP BY 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        # the records of a cluster are all alike and alike to no other, so each record's alike records are its cluster
        "p1_found": _P1 + "SELECT matrix_id, cluster_id FROM grouped WHERE n >= 2",
        "p2_found": _P2 + "SELECT protein_a, protein_b FROM scored WHERE n_ab >= 8 AND n_ab * n >= 4 * n_a * n_b",
        "p2_pairs": _P2
        + """SELECT *, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift,
        CASE WHEN n_ab < n_a THEN round((1 - n_b / n::DOUBLE) / (1 - n_ab / n_a::DOUBLE), 6) ELSE 'infinity'::DOUBLE END AS conviction FROM scored""",
        "p3_found": _P3 + "SELECT protein, group_id FROM grouped",
        "p3_complexes": _P3 + "SELECT group_id, count(*) AS n_proteins, max(protein) AS last_protein FROM grouped GROUP BY group_id",
        "p4_found": _P4 + "SELECT protein_a, protein_b, row_id FROM placed WHERE position <= 3",
        "p4_ranked": _P4 + "SELECT protein_a, protein_b, row_id, iptm, rank, position FROM placed WHERE position <= 10",
    }
