"""The interaction graph as vertex and edge tables: status, connectivity, stability, classification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions.metrics import in_interval, parse_interval


def edge_weights(pairs: DataFrame, score: str) -> DataFrame:
    """GRF-1: weight round(n_models · score / min_pae · 2, 2) of each unordered pair, by key; null for a PAE of 0."""
    w = F.round(F.col("n_models") * F.col(score) / F.nullif(F.col("min_pae"), F.lit(0.0)) * 2, 2)
    return pairs.select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), w.alias("weight"))


def vertex_status(proteins: DataFrame, tested2: DataFrame, tested_n: DataFrame, hits2: DataFrame, hits_n: DataFrame) -> DataFrame:
    """GRF-2: (protein, status): Static, Positive, Negative, No N-mers Data, No interaction or Untested.

    The other tables hold proteins (first column); membership is by left join, so unknown stays distinct from false.
    """
    x = proteins.select(F.col(proteins.columns[0]).alias("protein")).distinct()
    for name, t in (("t2", tested2), ("tn", tested_n), ("h2", hits2), ("hn", hits_n)):
        x = x.join(t.select(F.col(t.columns[0]).alias("protein"), F.lit(True).alias(name)).distinct(), "protein", "left")
    t2, tn, h2, hn = (F.coalesce(c, F.lit(False)) for c in ("t2", "tn", "h2", "hn"))
    status = F.when(h2 & hn, "Static").when(hn, "Positive").when(h2 & ~tn, "No N-mers Data").when(h2, "Negative").when(t2 | tn, "No interaction").otherwise("Untested")
    return x.select("protein", status.alias("status"))


def _connected(batch: pd.DataFrame) -> list[bool]:
    out = []
    for n, links in zip(batch["n"], batch["links"], strict=True):
        root = list(range(n))

        def find(v: int, root: list[int] = root) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for a, b in links:
            root[find(a)] = find(b)
        out.append(n > 0 and len({find(v) for v in range(n)}) == 1)
    return out


def connected_models(links: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """GRF-4/GRF-5: whether the chains of each model form one connected graph.

    models: (keys, n chains); links: (keys, a, b chain positions). A model's graph has at most as many links as
    chain pairs, so each is decided in one row; models without links are not connected (unless of one chain).
    """
    inside = links.distinct().join(models, keys).where("a < n AND b < n AND a >= 0 AND b >= 0")
    each = inside.groupBy(*keys).agg(F.collect_list(F.array("a", "b")).alias("links"))
    rows = models.join(each, keys, "left").withColumn("links", F.coalesce("links", F.array().cast("array<array<int>>")))

    @F.pandas_udf("boolean")
    def whole(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for n, lists in parts:
            yield pd.Series(_connected(pd.DataFrame({"n": n, "links": lists})), dtype=bool)

    return rows.select(*keys, whole("n", "links").alias("connected"))


def stability(ranks: DataFrame, keys: list[str], n_models: int = 4) -> DataFrame:
    """GRF-5: stable when enough ranks are connected (and free of clashes where `valid` says so)."""
    ok = F.col("connected") & (F.col("valid") if "valid" in ranks.columns else F.lit(True))
    return ranks.groupBy(*keys).agg(F.count_distinct(F.when(ok, F.col("rank"))).alias("n_ranks")).withColumn("is_stable", F.col("n_ranks") >= n_models)


def dynamic_stability(rows: DataFrame, keys: list[str], cutoffs: list[tuple[float, int]]) -> DataFrame:
    """GRF-5 (dynamic): the first (PAE cutoff, ranks) pair that holds, in order; null where none does.

    rows: (keys, rank, pae), the PAE below which the rank's chains are connected.
    """
    counts = [F.count_distinct(F.when(F.col("pae") <= c, F.col("rank"))).alias(f"k{i}") for i, (c, _) in enumerate(cutoffs)]
    agg = rows.groupBy(*keys).agg(*counts)
    first = F.coalesce(*(F.when(F.col(f"k{i}") >= n, F.lit(n)) for i, (_, n) in enumerate(cutoffs)))
    return agg.select(*keys, first.alias("triggering_n"), first.isNotNull().alias("is_stable"))


def _bottlenecks(n: pd.Series, links: pd.Series) -> np.ndarray:
    """Least value at which the first n nodes are connected by links of at most that value; infinite where they never are."""
    out = np.full(len(n), np.inf)
    sizes = n.to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        far = np.full((len(at), size, size), np.inf)
        far[:, np.arange(size), np.arange(size)] = -np.inf
        for row, k in enumerate(at):
            for x in links.iloc[k]:
                a, b = x["a"], x["b"]
                far[row, a, b] = far[row, b, a] = min(far[row, a, b], x["pae"])
        for m in range(size):  # all models of one size at once: the least largest step over paths through m
            far = np.minimum(far, np.maximum(far[:, :, m, None], far[:, None, m, :]))
        out[at] = far[:, 0, :].max(axis=1) if size else np.inf
    return out


def connecting_pae(links: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """GRF-5 (dynamic): the least PAE cutoff at which the chains of each model are one graph; null where no cutoff connects them.

    models: (keys, n chains); links: (keys, a, b chain positions, pae). It is the largest step of the best
    spanning tree, not the largest PAE of the model. A model of one chain is connected at any cutoff (minus infinity).
    """
    each = links.where("a <> b").groupBy(*keys, "a", "b").agg(F.min("pae").alias("pae")).where("pae IS NOT NULL")
    inside = each.join(models, keys).where("a < n AND b < n AND a >= 0 AND b >= 0").groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "pae")).alias("links"))
    rows = models.join(inside, keys, "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<a:int,b:int,pae:double>>")))

    @F.pandas_udf("double")
    def least(n: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series(_bottlenecks(n, lists))

    value = least("n", "links")
    return rows.select(*keys, value.alias("pae")).withColumn("pae", F.when(F.col("pae") < float("inf"), F.col("pae")))


def all_chains_supported(rows: DataFrame, keys: list[str], n_models: int = 4, pae: float = 7.5) -> DataFrame:
    """GRF-6: stable when every chain has a passing partner in enough ranks. rows: (keys, rank, c1, c2, min_pae)."""
    ends = rows.select(*keys, "rank", F.explode(F.array("c1", "c2")).alias("chain"), (F.col("min_pae") <= pae).alias("ok")).where("chain IS NOT NULL")
    chain = ends.groupBy(*keys, "chain", "rank").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok")).groupBy(*keys, "chain").agg(F.count_if("ok").alias("n"))
    return chain.groupBy(*keys).agg(F.bool_and(F.col("n") >= n_models).alias("is_stable"), F.count("*").alias("n_chains"))


#: Proposed rules, in order; None is any. Columns: tested in 2-mers, in N-mers, seen in 2-mers, in N-mers, variation, contacts, class, style.
RULES = (
    (False, None, None, None, None, None, "No 2-mers Data", "#ff8c00", "dash"),
    (True, False, True, False, None, None, "No N-mers Data", "#9370db", "dash"),
    (True, True, True, False, None, None, "Strong Negative", "#b22222", "solid"),
    (True, True, True, True, "[1.0;1.0]", None, "Static", "#808080", "solid"),
    (True, True, True, True, "[0.5;1.0)", None, "Weak Negative", "#fa8072", "solid"),
    (True, True, True, True, "[0.0;0.5)", None, "Negative", "#ff0000", "solid"),
    (True, True, False, True, "[1.0;1.0]", True, "Strong Positive", "#006400", "solid"),
    (True, True, False, True, "[0.5;1.0)", True, "Positive", "#32cd32", "solid"),
    (True, True, False, True, "[0.0;0.5)", True, "Weak Positive", "#98fb98", "solid"),
    (True, True, False, True, None, False, "Indirect", "#d3d3d3", "dot"),
)
_RULE_SCHEMA = "tested2 boolean, tested_n boolean, in2 boolean, in_n boolean, variation_range string, contacts boolean, dynamics string, colour string, line string"


def default_rules(spark: SparkSession) -> DataFrame:
    """SRC-13: the rule table as a DataFrame; a table with the same columns may replace it."""
    return spark.createDataFrame(list(RULES), _RULE_SCHEMA)


def classify_edges(edges: DataFrame, rules: DataFrame, contact_cutoff: int = 5) -> DataFrame:
    """CLS-1/JN-10: dynamics class and style of each edge, in five stages.

    edges: (a, b, tested2, tested_n, in2, in_n, variation, n_contacts). Stage 1 takes the rules whose 2-mer test flag
    is the edge's: one gives the class, none makes it Indirect. Stage 2 narrows to those that agree on being seen in 2-mers,
    in N-mers, and on the N-mer test; stage 3 to those whose interval holds the variation, stage 4 to those
    whose contact flag says whether there are more than contact_cutoff contact cells. The first stage that leaves one
    rule decides; one that leaves none makes the edge Indirect; several after stage 4 are an ERROR (stage 5). Null columns of a rule match anything.
    The rules are few by nature, so they are broadcast.
    """
    any_or = lambda rule, value: F.col(rule).isNull() | (F.col(rule) == value)
    r = rules.select(*(F.col(c).alias(f"r_{c}") for c in rules.columns))
    enough = F.col("n_contacts") > contact_cutoff
    in_range = F.col("r_variation_range").isNull() | F.coalesce(in_interval(F.col("variation"), parse_interval(F.col("r_variation_range"))), F.lit(False))
    first = any_or("r_tested2", F.col("tested2"))
    second = any_or("r_in2", F.col("in2")) & any_or("r_in_n", F.col("in_n")) & any_or("r_tested_n", F.col("tested_n"))
    joined = edges.join(F.broadcast(r), first, "left")
    held = F.col("r_dynamics").isNotNull()
    stages = [held, held & second, held & second & in_range, held & second & in_range & any_or("r_contacts", enough)]
    style = F.struct("r_dynamics", "r_colour", "r_line")
    agg = joined.groupBy(*edges.columns).agg(*(f for k, c in enumerate(stages) for f in (F.count_if(c).alias(f"n{k}"), F.first(F.when(c, style), ignorenulls=True).alias(f"s{k}"))))

    def decided(name: str, none: str) -> Column:
        out = F.lit("ERROR")
        for k in range(3, -1, -1):
            out = F.when(F.col(f"n{k}") == 0, F.lit(none)).when(F.col(f"n{k}") == 1, F.col(f"s{k}.r_{name}")).otherwise(out)
        return out

    stage = F.lit(5)
    for k in range(3, -1, -1):
        stage = F.when(F.col(f"n{k}") <= 1, k + 1).otherwise(stage)
    return agg.select(*edges.columns, decided("dynamics", "Indirect").alias("dynamics"), decided("colour", "#d3d3d3").alias("colour"), decided("line", "dot").alias("line"), stage.alias("stage"))


def layout_weights(freq2: Column, freqn: Column) -> Column:
    """GRF-9: weight of an edge from its contact frequencies in 2-mers and N-mers."""
    return freq2 / 50 + freqn * 49 / 50
