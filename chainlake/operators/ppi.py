"""Which pairs interact in which context: thresholds, support and best values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.config import DEFAULT, Cutoffs


def detect_2mers(rows: DataFrame, cut: Cutoffs = DEFAULT) -> DataFrame:
    """AGG-1: ordered pairs with enough passing models, and the best values over all their models.

    rows: (p1, p2, iptm, min_pae). One aggregation: counts of passing rows and the extremes of all rows
    travel together, so there is no join. Null scores never pass. No rows give no rows.
    """
    ok = (F.col("min_pae") <= cut.min_pae) & (F.col("iptm") >= cut.iptm)
    agg = rows.groupBy("p1", "p2").agg(F.count_if(ok).alias("n_models"), F.max("iptm").alias("iptm"), F.min("min_pae").alias("min_pae"))
    return agg.where(F.col("n_models") >= cut.n_models)


def detect_nmers(rows: DataFrame, cut: Cutoffs = DEFAULT) -> DataFrame:
    """AGG-2: ordered pairs and combinations with enough passing ranks.

    rows: (p1, p2, combo, rank, min_pae, pdockq). Chain pairs of a rank collapse to the lowest min_pae and the
    highest pdockq, which may come from different ones. The first level combines on the map side, so
    the second shuffles one row per rank.
    """
    ranks = rows.groupBy("p1", "p2", "combo", "rank").agg(F.min("min_pae").alias("min_pae"), F.max("pdockq").alias("pdockq"))
    ok = (F.col("min_pae") <= cut.min_pae) & (F.col("pdockq") >= cut.pdockq)
    agg = ranks.groupBy("p1", "p2", "combo").agg(F.count_if(ok).alias("n_models"), F.max("pdockq").alias("pdockq"), F.min("min_pae").alias("min_pae"))
    return agg.where(F.col("n_models") >= cut.n_models)


def interacting_proteins(pairs: DataFrame) -> DataFrame:
    """AGG-3: every protein of a passing pair, once."""
    return pairs.select(F.explode(F.array("p1", "p2")).alias("protein")).distinct()


def hover_values(rows: DataFrame, cut: Cutoffs = DEFAULT) -> DataFrame:
    """AGG-7: per ordered pair and combination the best scores and the number of models by strict cutoffs, with marks."""
    ok = (F.col("min_pae") < cut.min_pae) & (F.col("pdockq") > cut.pdockq)
    agg = rows.groupBy("p1", "p2", "combo").agg(
        F.max("ptm").alias("ptm"), F.max("iptm").alias("iptm"), F.max("pdockq").alias("pdockq"), F.min("min_pae").alias("min_pae"), F.count_distinct(F.when(ok, F.col("rank"))).alias("n_models")
    )
    return agg.withColumn("mark", F.when(F.col("n_models") > 0, F.repeat(F.lit("✔"), F.col("n_models").cast("int"))).otherwise("x"))


def first_predictions(chains: DataFrame, order: Column) -> DataFrame:
    """AGG-5: one prediction per multiset of chains: the first in order.

    chains: one row per chain (pred_id, chain key, order columns).
    """
    keyed = chains.groupBy("pred_id").agg(F.array_sort(F.collect_list("seq")).alias("key"), F.min(order).alias("first"))
    return keyed.groupBy("key").agg(F.min_by("pred_id", F.struct("first", "pred_id")).alias("pred_id"), F.count("*").alias("n_predictions"))


def occurrences(rows: DataFrame, value: Column, key: str, order: list[str]) -> DataFrame:
    """AGG-4: occurrences with the lowest and highest value per key; ties go to the first in order."""
    first = F.struct(value.alias("v"), *order)
    last = F.struct((-value).alias("v"), *order)
    return rows.groupBy(key).agg(F.min(first).alias("lo"), F.min(last).alias("hi"), F.avg(value).alias("mean_value"), F.count(value).alias("n_occurrences"))


def best_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """SRC-7/SRT-3: the first row of each key in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
