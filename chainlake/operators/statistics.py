"""Stability profiles, association measures and evaluation of classifications."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from chainlake.operators.series import running_total
from chainlake.storage import Scratch


def five_numbers(value: Column, prefix: str = "") -> list[Column]:
    """AGG-13/14: mean, SD of a sample, median and quartiles (linear interpolation); the SD of one value is null."""
    return [
        F.avg(value).alias(f"{prefix}mean"), F.stddev_samp(value).alias(f"{prefix}sd"), F.median(value).alias(f"{prefix}median"),
        F.percentile(value, F.lit(0.25)).alias(f"{prefix}q1"), F.percentile(value, F.lit(0.75)).alias(f"{prefix}q3"),
    ]


def pae_stability(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-14: five numbers of the least and the mean PAE over the chain pairs of each key."""
    return rows.groupBy(*keys).agg(*five_numbers(F.col("mipae"), "mipae_"), *five_numbers(F.col("aipae"), "aipae_"))


def variation(value: Column) -> list[Column]:
    """AGG-19: mean and coefficient of variation (population SD over the mean, kept from division by 0)."""
    return [F.avg(value).alias("mean"), (F.stddev_pop(value) / (F.avg(value) + F.lit(1e-8))).alias("cv")]


def phi(a: Column, b: Column) -> list[Column]:
    """STA-1: the four counts of two flags and their phi coefficient; null on an empty margin. Rows with a null flag don't count."""
    both = a.isNotNull() & b.isNotNull()
    n11, n10, n01, n00 = (F.count_if(both & (a == F.lit(x)) & (b == F.lit(y))) for x, y in ((True, True), (True, False), (False, True), (False, False)))
    margins = (n11 + n10).cast("double") * (n01 + n00) * (n11 + n01) * (n10 + n00)
    value = F.when(margins > 0, (n11.cast("double") * n00 - n10.cast("double") * n01) / F.sqrt(margins))
    return [n11.alias("n11"), n10.alias("n10"), n01.alias("n01"), n00.alias("n00"), value.alias("phi")]


def needed_copies(partner: Column, *own: Column) -> Column:
    """How many copies of a partner must be in a model besides those that the pair (or protein) itself takes up."""
    return sum(((partner == o).cast("int") for o in own), F.lit(1))


def partner_phi(models: DataFrame, partners: str = "combo") -> DataFrame:
    """STA-1: for each edge and partner, how the partner's presence in a model goes with the edge's detection.

    models: one row per model (a, b, hit, combo). A partner is present when the model holds a copy of it besides the two of
    the pair. Only presences are enumerated; absences follow from the totals of the edge, so no edge meets all proteins.
    phi is null on an empty margin. A null combo names no partner, a null hit doesn't count.
    """
    rows = models.where(F.col("hit").isNotNull())
    whole = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))
    each = rows.select("a", "b", "hit", partners, F.explode(F.array_distinct(partners)).alias("partner"))
    present = each.where(F.size(F.filter(partners, lambda q: q == F.col("partner"))) >= needed_copies(F.col("partner"), F.col("a"), F.col("b")))
    n = present.groupBy("a", "b", "partner").agg(F.count("*").alias("m"), F.count_if("hit").alias("n11")).join(whole, ["a", "b"])
    x = n.select("a", "b", "partner", "n11", (F.col("m") - F.col("n11")).alias("n10"), (F.col("h") - F.col("n11")).alias("n01"), (F.col("n") - F.col("m") - F.col("h") + F.col("n11")).alias("n00"))
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    margins = (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)
    return x.withColumn("phi", F.when(margins > 0, (n11 * n00 - n10 * n01) / F.sqrt(margins)))


def partner_correlation(rows: DataFrame) -> DataFrame:
    """STA-2: for each protein and partner, the point-biserial correlation of a value with the partner's presence.

    rows: one row per model (protein, value, combo); the protein itself is present from two copies on. Only presences
    are enumerated, the rest follows from the protein's totals. Null where the value or the presence does not vary.
    """
    rows = rows.where(F.col("value").isNotNull() & F.col("combo").isNotNull())
    whole = rows.groupBy("protein").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    each = rows.select("protein", "value", "combo", F.explode(F.array_distinct("combo")).alias("partner"))
    present = each.where(F.size(F.filter("combo", lambda x: x == F.col("partner"))) >= needed_copies(F.col("partner"), F.col("protein")))
    x = present.groupBy("protein", "partner").agg(F.count("*").alias("m"), F.sum("value").alias("t")).join(whole, "protein")
    n, m, s, t, q = (F.col(c).cast("double") for c in ("n", "m", "s", "t", "q"))
    spread = (n * m - m * m) * (n * q - s * s)
    r = F.when((F.col("m") < F.col("n")) & (F.col("lo") < F.col("hi")) & (spread > 0), (n * t - m * s) / F.sqrt(spread))
    return x.select("protein", "partner", "n", F.col("m").alias("n_with"), r.alias("r"), (t / m).alias("mean_with"), F.when(n > m, (s - t) / (n - m)).alias("mean_without"))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution of one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v is not None and v == v and v >= 0 else None)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two values; null where one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


def point_biserial(value: Column, flag: Column) -> list[Column]:
    """STA-2: correlation of a value with a flag, and the two means; null where one side is empty."""
    x = flag.cast("double")
    return [pearson(value, x).alias("r"), F.avg(F.when(flag, value)).alias("mean_with"), F.avg(F.when(~flag, value)).alias("mean_without"), F.count("*").alias("n")]


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of a t value."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n pairs, by the t distribution; null where it isn't defined."""
    return pd.Series([t_sf2(abs(x) * math.sqrt((k - 2) / max(1 - x * x, 1e-300)), k - 2) if x is not None and x == x and k > 2 else None for x, k in zip(r, n, strict=True)], dtype="float64")


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of the t distribution: the t whose two-sided p is 2 (1 - p)."""
    low, high = 0.0, 1.0
    while t_sf2(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf2(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def fallback_target(rows: DataFrame, key: str, n: str, mean: str, sd: str, size: str, level: float = 0.95) -> DataFrame:
    """STA-3: for each size the smaller size it falls back to.

    rows: one per key and n, with mean radius, SD and number of models. A smaller size matches when the
    confidence intervals of the means overlap; without a match the nearest radius penalised by the SDs is taken.
    Matches come first, then the smaller penalised gap, then the larger size.
    """

    @F.pandas_udf("double")
    def half_width(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([t_quantile(0.5 + level / 2, c - 1) * v / math.sqrt(c) if c and c > 1 and v == v and v is not None else 0.0 for v, c in zip(s, k, strict=True)])

    ci = rows.select(key, F.col(n).alias("n"), F.col(mean).alias("m"), F.coalesce(sd, F.lit(0.0)).alias("s"), half_width(F.col(sd), F.col(size)).alias("h"))
    small = ci.select(key, *(F.col(c).alias(f"{c}_t") for c in ("n", "m", "s", "h")))
    both = ci.join(small, key).where("n_t < n")
    gap = F.abs(F.col("m") - F.col("m_t"))
    scored = both.select(key, "n", "n_t", (gap <= F.col("h") + F.col("h_t")).alias("matches"), (gap * (1 + F.col("s") + F.col("s_t"))).alias("penalised"))
    order = Window.partitionBy(key, "n").orderBy(F.col("matches").desc(), "penalised", F.col("n_t").desc())
    return scored.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(key, "n", F.col("n_t").alias("target"), "matches", "penalised")


def classification_scores(rows: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """AGG-24: accuracy, accuracy within one, MAE, MSE, RMSE, Pearson and Spearman, and macro and weighted precision, recall and F1 per key.

    A class that is never guessed has precision 0; one that never occurs has recall 0. Weights are the classes' true counts.
    Spearman correlates mean ranks, which follow from the counts of the classes. Rows without truth or guess count only for coverage, the share of rows that have both.
    """
    t, g = F.col(truth), F.col(guess)
    total = rows.groupBy(*keys).agg(F.avg((t.isNotNull() & g.isNotNull()).cast("double")).alias("coverage"))
    rows = rows.where(t.isNotNull() & g.isNotNull())
    cells = rows.groupBy(*keys, t.alias("t"), g.alias("g")).agg(F.count("*").alias("c"))  # as many rows as pairs of classes

    def mean_ranks(column: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(column)
        n = cells.groupBy(*keys, column).agg(F.sum("c").alias("c"))
        return n.select(*keys, column, (F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("c") - 1) / 2).alias(f"r{column}"))

    ranked = cells.join(mean_ranks("t"), [*keys, "t"]).join(mean_ranks("g"), [*keys, "g"])
    c, x, y = F.col("c").cast("double"), F.col("rt"), F.col("rg")
    sums = ranked.groupBy(*keys).agg(*(F.sum(e).alias(k) for k, e in {"n": c, "x": c * x, "y": c * y, "xx": c * x * x, "yy": c * y * y, "xy": c * x * y}.items()))
    spread = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    spearman = sums.select(*keys, F.when(spread > 0, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread)).alias("spearman"))
    whole = rows.groupBy(*keys).agg(
        F.avg((t == g).cast("double")).alias("accuracy"), F.avg((F.abs(t - g) <= 1).cast("double")).alias("within_one"), F.avg(F.abs(t - g).cast("double")).alias("mae"), F.avg(F.pow((t - g).cast("double"), 2)).alias("mse"),
        F.sqrt(F.avg(F.pow((t - g).cast("double"), 2))).alias("rmse"), pearson(t.cast("double"), g.cast("double")).alias("pearson"), F.count("*").alias("n"),
    )
    ends = cells.select(*keys, F.inline(F.array(F.struct(F.col("t").alias("_class"), F.col("c").alias("nt"), F.lit(0).cast("bigint").alias("ng"), F.when(F.col("t") == F.col("g"), F.col("c")).otherwise(0).alias("hit")), F.struct(F.col("g").alias("_class"), F.lit(0).cast("bigint").alias("nt"), F.col("c").alias("ng"), F.lit(0).cast("bigint").alias("hit")))))
    by = ends.groupBy(*keys, "_class").agg(F.sum("nt").alias("nt"), F.sum("ng").alias("ng"), F.sum("hit").alias("hit"))
    by = by.withColumn("p", F.when(F.col("ng") > 0, F.col("hit") / F.col("ng")).otherwise(0.0)).withColumn("r", F.when(F.col("nt") > 0, F.col("hit") / F.col("nt")).otherwise(0.0))
    by = by.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    names = {"p": "precision", "r": "recall", "f": "f1"}
    scores = by.groupBy(*keys).agg(*(F.avg(v).alias(f"macro_{n}") for v, n in names.items()), *((F.sum(F.col(v) * F.col("nt")) / F.sum("nt")).alias(f"weighted_{n}") for v, n in names.items()))
    return total.join(whole, keys).join(scores, keys).join(spearman, keys)


def roc(rows: DataFrame, keys: list[str], score: str, label: str, scratch: Scratch | None = None) -> DataFrame:
    """AGG-25: points of the ROC curve, one per different score, from the highest; tpr and fpr are null without positives or negatives.

    The running counts are taken block by block, so a key with most of the scores doesn't meet in one task.
    """
    at = rows.groupBy(*keys, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    upto = running_total(at, keys, [F.col(score).desc()], ["p", "n"], scratch)
    whole = at.groupBy(*keys).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    share = lambda up, own, all_: (F.col(up) - F.col(own)) / F.nullif(F.col(all_), F.lit(0))
    x = upto.join(whole, keys)
    return x.select(
        *keys, score, (F.col("upto_p") / F.nullif(F.col("_p"), F.lit(0))).alias("tpr"), (F.col("upto_n") / F.nullif(F.col("_n"), F.lit(0))).alias("fpr"), share("upto_p", "p", "_p").alias("tpr_before"), share("upto_n", "n", "_n").alias("fpr_before")
    )


def auc(points: DataFrame, keys: list[str], score: str) -> DataFrame:
    """AGG-25: area under the curve by trapezia, and the threshold with the largest tpr - fpr (ties: the higher)."""
    area = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    best = F.struct(F.round(F.col("tpr") - F.col("fpr"), 9).alias("j"), F.col(score))
    return points.groupBy(*keys).agg(F.sum(area).alias("auc"), F.max_by(score, best).alias("best_threshold"))


def quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str, scratch: Scratch | None = None) -> DataFrame:
    """AGG-17: exact quantile (linear interpolation) per key from running counts of its different values; no key's values meet in one place. Nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = running_total(counts, keys, [value], ["c"], scratch)
    place = counts.groupBy(*keys).agg(((F.sum("c") - 1) * F.lit(q)).alias("_at"))
    x = upto.join(place, keys)
    first = lambda k: F.min(F.when(F.col("upto_c") > k, F.col(value)))
    ends = x.groupBy(*keys, "_at").agg(first(F.floor("_at")).alias("_lo"), first(F.ceil("_at")).alias("_hi"))
    return ends.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias(name))
