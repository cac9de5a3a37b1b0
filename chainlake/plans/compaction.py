"""Queries of the consolidation of small files (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators.compaction import compact
from chainlake.plans.catalog import query, table

_PATH = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    replace(regexp_replace(pdb_file, '^\s+|\s+$', '', 'g'), '\', '/'), '^(?i:file):(//(?i:localhost)?/)?', '/'), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '/(\./)+', '/', 'g'),
    '/[^/.][^/]*/\.\./', '/', 'g'), '/[^/.][^/]*/\.\./', '/', 'g'), '/[^/.][^/]*/\.\./', '/', 'g'), '/\.$', '')"""

_FILES = f"""
WITH file AS (SELECT {_PATH} AS path, min(file_id) AS file_id, arg_min(content, file_id) FILTER (WHERE content IS NOT NULL) AS content FROM all_pdb_data GROUP BY 1),
lines AS (SELECT file_id, unnest(string_split_regex(content, '\r?\n|\r')) AS record FROM file),
atom AS (SELECT * FROM lines WHERE starts_with(record, 'ATOM '))
"""


@query("p5_found", _FILES + "SELECT DISTINCT file_id FROM atom")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return compact(table(spark, folder, "all_pdb_data")).select("file_id").distinct()


@query("p5_compacted", _FILES + "SELECT file_id, count(*) AS n_atoms, min(record) AS first_record, max(record) AS last_record FROM atom GROUP BY file_id")
def p5_compacted(spark: SparkSession, folder: str) -> DataFrame:
    rows = compact(table(spark, folder, "all_pdb_data"))
    return rows.groupBy("file_id").agg(F.count("*").alias("n_atoms"), F.min("record").alias("first_record"), F.max("record").alias("last_record"))


@query("p5_balance", _FILES + "SELECT ceil(sum(strlen(record) + 16) / 65536)::BIGINT AS n_files, true AS balanced FROM atom")
def p5_balance(spark: SparkSession, folder: str) -> DataFrame:
    """The same consolidation into files of 64 KiB: how many are written, and whether none holds more than one and a half times the mean or less than half of it."""
    rows = compact(table(spark, folder, "all_pdb_data"), target_bytes=65536).withColumn("f", F.input_file_name())
    sizes = rows.groupBy("f").agg(F.sum(F.octet_length("record") + 16).alias("n"))
    return sizes.agg(F.count("*").alias("n_files"), ((F.max("n") <= 1.5 * F.avg("n")) & (F.min("n") >= 0.5 * F.avg("n"))).alias("balanced"))
