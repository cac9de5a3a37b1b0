"""New predictions arrive as files: detection and lattice states are brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainlake.config import DEFAULT, Cutoffs
from chainlake.operators import lattice


def read_new(spark: SparkSession, folder: str, schema, files_a_batch: int = 1000) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream with a bounded batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def support(rows: DataFrame, cut: Cutoffs = DEFAULT) -> DataFrame:
    """Per (combo, pred_id, rank) whether some chain pair passes. Mergeable: or of the parts."""
    return rows.where("combo IS NOT NULL").groupBy("combo", "pred_id", "rank").agg(F.coalesce(F.bool_or(F.col("min_pae") <= cut.min_pae), F.lit(False)).alias("ok"))


def windowed_counts(rows: DataFrame, time: str, key: str, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """Predictions per time window and key, with a watermark for late rows; a row delivered twice (same row_id and time) counts once."""
    once = rows.withWatermark(time, late).dropDuplicates(["row_id", time])
    return once.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n_rows")).select(F.col("w.start").alias("start"), key, "n_rows")


def keep_states(stream: DataFrame, table: str, checkpoint: str, cut: Cutoffs = DEFAULT) -> StreamingQuery:
    """Appends each batch's support to a table; a batch that is run again after a failure replaces its own part."""

    def append(batch: DataFrame, number: int) -> None:
        support(batch, cut).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark: SparkSession, table: str, n_models: int = 4) -> DataFrame:
    """(combo, is_stable) from all batches so far, ready for lattice.convergence()."""
    merged = spark.read.parquet(table).groupBy("combo", "pred_id", "rank").agg(F.bool_or("ok").alias("ok"))
    return merged.groupBy("combo").agg((F.count_distinct(F.when(F.col("ok"), F.col("rank"))) >= n_models).alias("is_stable"))


def convergence(spark: SparkSession, table: str) -> DataFrame:
    """LAT-3 over what has arrived."""
    s = states(spark, table)
    return lattice.convergence(s, lattice.containment_edges(s))
