"""Work for all cores where much is done per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores; inputs that have them already aren't shuffled.

    A small compressed file of texts is one scan partition, and would be one task for minutes.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
