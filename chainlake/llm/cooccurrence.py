"""Problem 2: items that appear together, by basket collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.functions.ids import protein_id
from chainlake.storage import Scratch


def collapse_baskets(items: DataFrame, basket: str = "basket", item: str = "item") -> DataFrame:
    """(items, weight): the different sorted item arrays and how many baskets hold exactly those items."""
    arrays = items.groupBy(basket).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return arrays.groupBy("items").agg(F.count("*").alias("weight"))


def item_pairs(
    items: DataFrame, n_baskets: int, basket: str = "basket", item: str = "item", min_count: int = 1, wide: int = 512, scratch: Scratch | None = None
) -> DataFrame:
    """How often each two items share a basket, against chance.

    items holds each (basket, item) once. Items of fewer than min_count baskets cannot be in a pair of
    min_count and are left out first, which changes no count that is returned. Baskets of up to `wide` items become sorted arrays; equal arrays
    are collapsed into one with a weight, and pairs are enumerated once per different array. A basket of
    more items is never gathered in one place: its pairs come from a join of its rows, whose left side
    is spread over blocks.

    Returns item_a < item_b, n_ab, n_a, n_b, n (baskets in all), lift, and conviction of a -> b
    ((1 - n_b / n) / (1 - n_ab / n_a); infinite where a never comes without b). Null baskets and items
    are ignored; no rows give no rows.
    """
    scratch = scratch or Scratch(items.sparkSession, "pairs")
    rows = items.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    counts = scratch.save(rows.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= min_count), "counts")
    kept = rows.join(counts.select("item"), "item", "left_semi")
    sizes = kept.groupBy("basket").agg(F.count("*").alias("size")).where("size >= 2")
    kept = scratch.save(kept.join(sizes, "basket"), "kept")

    distinct = collapse_baskets(kept.where(F.col("size") <= wide))
    firsts = distinct.select("items", "weight", F.posexplode("items").alias("i", "item_a"))
    narrow = firsts.select("weight", "item_a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("item_b"))

    big = kept.where(F.col("size") > wide).select("basket", "item")
    blocks = 32
    left = big.select("basket", F.col("item").alias("item_a"), F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
    right = big.select("basket", F.col("item").alias("item_b"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))
    broad = left.join(right, ["basket", "block"]).where("item_a < item_b").select(F.lit(1).cast("bigint").alias("weight"), "item_a", "item_b")

    pairs = narrow.unionByName(broad).groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_count)
    a = counts.withColumnsRenamed({"item": "item_a", "n_item": "n_a"})
    b = counts.withColumnsRenamed({"item": "item_b", "n_item": "n_b"})
    n = F.lit(n_baskets).cast("bigint")
    without = 1 - F.col("n_ab") / F.col("n_a")
    return pairs.join(a, "item_a").join(b, "item_b").select(
        "item_a",
        "item_b",
        "n_ab",
        "n_a",
        "n_b",
        n.alias("n"),
        (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / n) / without).otherwise(F.lit(float("inf"))).alias("conviction"),
    )


def supported(cluster: Column) -> Column:
    """Whether a mark says that the pair is supported: one or more check marks."""
    return F.coalesce(F.contains(cluster, F.lit("✔")), F.lit(False))


def supported_pairs(pairwise: DataFrame, min_count: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """item_pairs of the proteins of each supported prediction of an N-mer table.

    Rows that repeat a prediction's list are combined before anything is exploded. A prediction counts
    if any of its rows is marked, and holds every protein that any of its rows names; null lists and null
    or blank members name none, and such a prediction still counts into n.
    """
    scratch = scratch or Scratch(pairwise.sparkSession, "supported")
    lists = pairwise.where("pred_id IS NOT NULL").groupBy("pred_id", "proteins_in_model").agg(F.max(supported(F.col("cluster"))).alias("marked"))
    lists = scratch.save(lists, "lists")
    counted = lists.groupBy("pred_id").agg(F.max("marked").alias("marked")).where("marked").select("pred_id")
    members = lists.join(counted, "pred_id", "left_semi").select("pred_id", F.explode("proteins_in_model").alias("raw"))
    members = members.select(F.col("pred_id").alias("basket"), protein_id("raw").alias("item")).where("item IS NOT NULL").distinct()
    return item_pairs(scratch.save(members, "members"), counted.count(), min_count=min_count, scratch=scratch)


def above_chance(pairs: DataFrame, times: int = 4) -> DataFrame:
    """Pairs that come together at least so many times as often as chance gives, in whole numbers."""
    return pairs.where(F.col("n_ab") * F.col("n") >= F.lit(times) * F.col("n_a") * F.col("n_b"))
