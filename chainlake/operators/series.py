"""Windows over ordered models: rolling partner bias, ranges, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.storage import Scratch


def numbered(rows: DataFrame, keys: list[str], order: list, scratch: Scratch | None = None, name: str = "ord") -> DataFrame:
    """SRT-2: number of each row within its key, from 1, without a window over any key's rows.

    Rows are range-partitioned by key and order and written with their place, so a key that holds a third of all rows lies in
    many tasks; the places before each task's stretch of a key are summed from one row a task and key. Null keys are a key.
    """
    scratch = scratch or Scratch(rows.sparkSession, "numbered")
    by = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    laid = scratch.save(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), f"laid-{name}").withColumn("_part", F.shiftright("_at", 33))
    stretches = laid.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = laid.join(starts, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return joined.select(*rows.columns, name)


def framed(rows: DataFrame, keys: list[str], order: str, before: int, after: int, aggregates: dict[str, Column], block: int = 50_000) -> DataFrame:
    """Aggregates over the rows from `before` places before each row to `after` places after it, for numbered rows.

    Rows go to blocks of so many places, those near a block's ends to the next as well, so no window holds more than a block.
    """
    at = lambda shift: F.floor((F.col(order) + F.lit(shift - 1)) / F.lit(block)).cast("bigint")
    spread = rows.withColumn("_own", at(0)).withColumn("_block", F.explode(F.sequence(at(-after), at(before))))
    frame = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(-before, after)
    out = spread.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items()))
    return out.where("_block = _own").drop("_own", "_block")


def _scaled_share(share: Column, overall: Column) -> Column:
    """Share of presence against the overall one: (r - f) / (1 - f) from f on, else (r - f) / f; 0 where f is 0 or 1."""
    return F.when((overall == 0) | (overall == 1), 0.0).when(share >= overall, (share - overall) / (1 - overall)).otherwise((share - overall) / overall)


def rolling_bias(rows: DataFrame, keys: list[str], order: list[str], present: str, width: int, scratch: Scratch | None = None) -> DataFrame:
    """WIN-1: bias of a partner along ordered models.

    Centred rolling share of presence (full frames only), scaled to the overall share. Adds ord (from 1), overall, rolling and bias.
    """
    placed = numbered(rows.withColumn("_x", F.col(present).cast("double")), keys, order, scratch)
    overall = placed.groupBy(*keys).agg(F.avg("_x").alias("overall"))
    half = width // 2
    out = framed(placed, keys, "ord", half, width - 1 - half, {"_n": F.count("*"), "rolling": F.avg("_x")}).join(overall, keys)
    out = out.withColumn("rolling", F.when(F.col("_n") == width, F.col("rolling"))).drop("_n", "_x")
    return out.withColumn("bias", F.when(F.col("rolling").isNotNull(), _scaled_share(F.col("rolling"), F.col("overall"))))


def padded(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """WIN-2: a series whose missing ends take the first and last known value, from the two known ends of each key."""
    known = F.when(F.col(value).isNotNull(), F.struct(order, value))
    ends = rows.groupBy(*keys).agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    filled = F.when(F.col(order) < F.col(f"_lo.{order}"), F.col(f"_lo.{value}")).when(F.col(order) > F.col(f"_hi.{order}"), F.col(f"_hi.{value}")).otherwise(F.col(value))
    return rows.join(ends, keys).withColumn(value, filled).drop("_lo", "_hi")


def partner_bias(rows: DataFrame, key: str, order: str, members: str, widths: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """WIN-1: bias of every partner along the ordered models of a key: largest, least and mean value, first place of the largest, and number of places, per width.

    rows: numbered models (key, order, members). The key itself is present from two copies on. A place's share follows
    from the presences within its frame, so each presence is sent to the places it counts for and all other places have a share of
    0: the work grows with the presences, not with models times partners. Widths that no frame fits give no row.
    """
    total = rows.groupBy(key).agg(F.count("*").alias("n"))
    each = rows.select(key, order, members, F.explode(F.array_distinct(members)).alias("partner"))
    copies = F.size(F.filter(members, lambda q: q == F.col("partner")))
    present = each.where(copies > (F.col(key) == F.col("partner")).cast("int")).select(key, order, "partner")
    share = present.groupBy(key, "partner").agg(F.count("*").alias("m")).join(total, key).select(key, "partner", "n", (F.col("m") / F.col("n")).alias("share"))
    width = F.explode(F.array(*map(F.lit, widths))).alias("width")
    half = F.floor(F.col("width") / 2).cast("int")
    wide = present.select("*", width).join(total, key)
    places = wide.select(key, "partner", "width", "n", half.alias("half"), F.explode(F.sequence(F.col(order) - (F.col("width") - 1 - half), F.col(order) + half)).alias("place"))
    inside = places.where((F.col("place") > F.col("half")) & (F.col("place") <= F.col("n") - (F.col("width") - 1 - F.col("half"))))
    held = inside.groupBy(key, "partner", "width", "place").agg(F.count("*").alias("c"))
    frame = share.select("*", width).where(F.col("n") >= F.col("width")).withColumn("valid", F.col("n") - F.col("width") + 1)
    bias = _scaled_share(F.col("c") / F.col("width"), F.col("share"))
    some = held.join(frame, [key, "partner", "width"]).select(key, "partner", "width", "place", bias.alias("bias"))
    agg = some.groupBy(key, "partner", "width").agg(F.count("*").alias("k"), F.max("bias").alias("hi"), F.min("bias").alias("lo"), F.sum("bias").alias("sum"), F.min_by("place", F.struct(-F.round("bias", 9), "place")).alias("top"))
    x = frame.join(agg, [key, "partner", "width"], "left")
    rest = F.col("valid") - F.coalesce("k", F.lit(0))
    none = _scaled_share(F.lit(0.0), F.col("share"))  # of the places without the partner
    first_free = F.floor(F.col("width") / 2) + 1
    any_rest = rest > 0
    high = F.when(any_rest, F.greatest(F.coalesce("hi", none), none)).otherwise(F.col("hi"))
    peak = F.when(F.col("k").isNull(), first_free).when((F.col("share") == 1) | (F.round("hi", 9) > F.round(none, 9)), F.col("top")).otherwise(first_free)
    return x.select(
        key, "partner", "width", "share", F.col("valid").alias("n_places"), high.alias("max_bias"), F.when(any_rest, F.least(F.coalesce("lo", none), none)).otherwise(F.col("lo")).alias("min_bias"),
        ((F.coalesce("sum", F.lit(0.0)) + rest * none) / F.col("valid")).alias("mean_bias"), peak.cast("bigint").alias("peak"),
    )


def moving_average(rows: DataFrame, value: str, keys: list[str], order: list[str], width: int, name: str = "mean_value", scratch: Scratch | None = None) -> DataFrame:
    """WIN-4: mean of each full stretch of `width` values, at its last row; null before."""
    out = framed(numbered(rows, keys, order, scratch), keys, "ord", width - 1, 0, {"_n": F.count("*"), "_mean": F.avg(value)})
    return out.withColumn(name, F.when(F.col("_n") == width, F.col("_mean"))).drop("_n", "_mean")


def running_total(rows: DataFrame, keys: list[str], order: list, values: list[str], scratch: Scratch | None = None, block: int = 50_000) -> DataFrame:
    """Sums of values up to each row of its key in order (columns upto_<value>), by the sums of blocks of numbered rows: no window holds more than a block or one row a block."""
    placed = numbered(rows, keys, order, scratch).withColumn("_block", F.floor((F.col("ord") - 1) / block))
    sums = placed.groupBy(*keys, "_block").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_block", *(F.coalesce(F.sum(f"_{v}").over(w), F.lit(0)).alias(f"_before_{v}") for v in values))
    inside = Window.partitionBy(*keys, "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(before, [*keys, "_block"]).select(*rows.columns, "ord", *((F.sum(v).over(inside) + F.col(f"_before_{v}")).alias(f"upto_{v}") for v in values))


def fallback_ranges(rows: DataFrame, key: str, n: str, mean: str, top: float = 1000.0) -> DataFrame:
    """WIN-5: ranges between the midpoints of neighbouring means; uppers never fall, the first starts at 0, the last ends at top."""
    w = Window.partitionBy(key).orderBy(n)
    middle = (F.col(mean) + F.lead(mean).over(w)) / 2
    up = rows.withColumn("_mid", middle)
    running = F.max("_mid").over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = up.withColumn("upper", F.when(F.lead(mean).over(w).isNull(), F.lit(top)).otherwise(running))
    return up.withColumn("lower", F.coalesce(F.lag("upper").over(w), F.lit(0.0))).drop("_mid")


def first_drop(rows: DataFrame, key: str, n: str, mean: str, share: float = 0.2) -> DataFrame:
    """WIN-6: the first n whose mean is below the one before by more than the share; null where there is none."""
    before = F.lag(mean).over(Window.partitionBy(key).orderBy(n))
    marked = rows.withColumn("_b", before)
    return marked.groupBy(key).agg(F.min(F.when(F.col(mean) < F.col("_b") * (1 - share), F.col(n))).alias("first_drop"))


def runs(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """WIN-7 (islands): number of the run of equal labels each row is in, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_c", change)
    return marked.withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def merge_loops(rows: DataFrame, keys: list[str], order: list[str], label: str, most: int) -> DataFrame:
    """WIN-7: runs of at most `most` rows between two runs of one label take that label; runs are then numbered anew.

    The neighbours are judged by the labels as given, so one pass is enough.
    """
    first = runs(rows, keys, order, label)
    size = first.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(label).alias("l"))
    w = Window.partitionBy(*keys).orderBy("run")
    wrapped = (F.lag("l").over(w) == F.lead("l").over(w)) & (F.col("n") <= most)
    fixed = size.select(*keys, "run", F.when(wrapped, F.lag("l").over(w)).otherwise(F.col("l")).alias("merged"))
    return runs(first.join(fixed, [*keys, "run"]).drop("run"), keys, order, "merged")


def longest_start(values: DataFrame, key: str, n: str) -> DataFrame:
    """WIN-8: the end of the unbroken stretch of whole numbers that starts at the least one."""
    distinct = values.select(key, n).distinct()
    w = Window.partitionBy(key).orderBy(n)
    island = distinct.select(key, n, (F.col(n) - F.row_number().over(w)).alias("i"), F.min(n).over(Window.partitionBy(key)).alias("least"))
    return island.where(F.col("i") == F.col("least") - 1).groupBy(key).agg(F.max(n).alias("last"))


def missing_states(values: DataFrame, key: str, n: str, start: int = 3) -> DataFrame:
    """WIN-8: the whole numbers from start to the largest that are not there."""
    have = values.select(key, n).distinct()
    top = have.groupBy(key).agg(F.max(n).alias("top")).where(F.col("top") >= start)
    all_ = top.select(key, F.explode(F.sequence(F.lit(start), F.col("top").cast("int"))).alias(n))
    return all_.join(have, [key, n], "left_anti")


def min_max(rows: DataFrame, value: str, keys: list[str], name: str = "scaled") -> DataFrame:
    """WIN-9: a value scaled to 0..1 within its key; 0 where all are equal. The ends are aggregated and joined, for a key may hold most rows."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return rows.join(ends, keys).withColumn(name, scaled).drop("_lo", "_hi")
