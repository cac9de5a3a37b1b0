"""Residue contacts as sparse relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.config import DEFAULT, Cutoffs
from chainlake.functions.metrics import copies, distance3, pdockq, ppv


def is_contact(pae: Column, plddt: Column, dist: Column, cut: Cutoffs = DEFAULT) -> Column:
    """FLT-3: all cutoffs strict; null where a value is null."""
    return (pae < cut.min_pae) & (plddt > cut.plddt) & (dist < cut.distance)


def told_contact(cells: DataFrame, cut: Cutoffs = DEFAULT) -> Column:
    """FLT-3 where matrices may be missing: by pae and distance where they tell, else by the column given, if there is one; an unknown pLDDT is no objection."""
    given = [F.col("given")] if "given" in cells.columns else []
    return F.coalesce((F.col("pae") < cut.min_pae) & (F.col("dist") < cut.distance), *given, F.lit(False)) & F.coalesce(F.col("plddt") > cut.plddt, F.lit(True))


def contact_cells(cells: DataFrame, cut: Cutoffs = DEFAULT) -> DataFrame:
    """MAT-1/MAT-2: contact cells under the sorted pair, turned by ID (never by shape); scores are null where unknown."""
    turn = F.col("p1") > F.col("p2")
    kept = cells.where("p1 IS NOT NULL AND p2 IS NOT NULL").where(told_contact(cells, cut))
    return kept.select(
        "matrix_id", F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), "rank", "n_chains", F.when(turn, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turn, F.col("i")).otherwise(F.col("j")).alias("j"), "pae", "plddt", "dist"
    )


def contact_counts(contacts: DataFrame, least: int = 3) -> DataFrame:
    """FLT-6: records with at least so many contacts, and how many they have."""
    return contacts.groupBy("matrix_id", "a", "b").agg(F.count("*").alias("n_contacts")).where(F.col("n_contacts") >= least)


def near_points(points: DataFrame, keys: list[str], group: str, radius: float, extra: list[str]) -> DataFrame:
    """JN-7/JN-19: pairs of points of different groups of one key within a radius (inclusive).

    Points fall into voxels of the radius' size; the left side is copied to its 27 neighbours, so the join is
    by voxel and never all against all, and by shuffle only, for files of points are small and their rows many. group_1 < group_2. Points with a null coordinate are left out.
    """
    voxel = [F.floor(F.col(c) / F.lit(radius)).alias(f"v{c}") for c in "xyz"]
    p = points.dropna(subset=["x", "y", "z"]).select(*keys, group, *extra, "x", "y", "z", *voxel)
    around = F.array(*(F.lit(float(d)).cast("bigint") for d in (-1, 0, 1)))
    left = p.select(*keys, *(F.col(c).alias(f"{c}_1") for c in (group, *extra, "x", "y", "z")), "vx", "vy", "vz")
    for v in ("vx", "vy", "vz"):
        left = left.withColumn("d", F.explode(around)).withColumn(v, F.col(v) + F.col("d")).drop("d")
    right = p.select(*keys, *(F.col(c).alias(f"{c}_2") for c in (group, *extra, "x", "y", "z")), "vx", "vy", "vz")
    both = left.hint("shuffle_merge").join(right, [*keys, "vx", "vy", "vz"]).where(F.col(f"{group}_1") < F.col(f"{group}_2"))
    dist = distance3([F.col(f"{c}_1") for c in "xyz"], [F.col(f"{c}_2") for c in "xyz"])
    return both.withColumn("dist", dist).where(F.col("dist") <= radius).drop("vx", "vy", "vz")


def interface_scores(points: DataFrame, keys: list[str], radius: float = 8.0) -> DataFrame:
    """PRJ-6: pDockQ and PPV of every two chains: contacts within the radius, mean pLDDT of the interface residues (each once)."""
    near = near_points(points, keys, "chain", radius, ["res_no", "bfactor"])
    sides = [F.collect_set(F.struct(F.col(f"res_no_{s}").alias("r"), F.col(f"bfactor_{s}").alias("b"))).alias(f"e{s}") for s in (1, 2)]  # no more than the chains' residues
    both = near.groupBy(*keys, "chain_1", "chain_2").agg(F.count("*").alias("n_contacts"), *sides)
    values = F.filter(F.transform(F.concat("e1", "e2"), lambda x: x["b"]), lambda b: b.isNotNull())
    mean = F.aggregate(F.array_sort(values), F.lit(0.0), lambda s, b: s + b) / F.nullif(F.size(values), F.lit(0))
    both = both.withColumn("plddt", mean)
    score = F.round(pdockq(F.col("plddt"), F.col("n_contacts")), 3)
    return both.select(*keys, "chain_1", "chain_2", "n_contacts", "plddt", score.alias("pdockq"), ppv(score).alias("ppv"))


def rank_support(contacts: DataFrame, rows: DataFrame, cut: Cutoffs = DEFAULT) -> DataFrame:
    """AGG-6: per pair and combination, in how many ranks some chain pair has enough contacts.

    rows: one row per chain pair (matrix_id, a, b, combo, rank); contacts: their contact cells.
    """
    enough = contacts.groupBy("matrix_id").agg(F.count("*").alias("n")).where(F.col("n") >= cut.contacts).select("matrix_id", F.lit(True).alias("ok"))
    return rows.join(enough, "matrix_id", "left").groupBy("a", "b", "combo").agg(F.count_distinct(F.when(F.col("ok"), F.col("rank"))).alias("n_ranks"))


def contact_frequency(contacts: DataFrame, models: DataFrame) -> DataFrame:
    """AGG-15: per pair and cell the share of models that have the contact, overall and by 2-mers and N-mers (0 where a side is empty).

    models: one row per model (matrix_id, a, b, n_chains).
    """
    totals = models.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("n_chains") == 2).alias("n2"), F.count_if(F.col("n_chains") > 2).alias("nn"))
    cells = contacts.groupBy("a", "b", "i", "j").agg(F.count("*").alias("k"), F.count_if(F.col("n_chains") == 2).alias("k2"), F.count_if(F.col("n_chains") > 2).alias("kn"))

    def share(k: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(F.lit(0.0))

    return cells.join(totals, ["a", "b"]).select("a", "b", "i", "j", share("k", "n").alias("freq"), share("k2", "n2").alias("freq2"), share("kn", "nn").alias("freqn"))


def contact_class(freq2: Column, freqn: Column, tested2: Column, tested_n: Column) -> Column:
    """MAT-15: 0 none, 1 static, 2 positive, 3 negative, 4 no N-mers, 5 no 2-mers."""
    in2, in_n = F.coalesce(freq2, F.lit(0.0)) > 0, F.coalesce(freqn, F.lit(0.0)) > 0
    return F.when(~in2 & ~in_n, 0).when(in2 & ~tested_n, 4).when(in_n & ~tested2, 5).when(in2 & in_n, 1).when(in_n, 2).otherwise(3)


def residue_groups(contacts: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """MAT-16: per protein and residue: A one surface, B several surfaces of one partner, C several partners.

    A surface is a pair and (where modes gives one per matrix_id) a cluster.
    """
    cells = contacts if modes is None else contacts.join(modes, "matrix_id", "left")
    mode = F.lit(0) if modes is None else F.coalesce("mode", F.lit(0))
    ends = cells.select(F.inline(F.array(
        F.struct(F.col("a").alias("protein"), F.col("i").alias("residue"), F.col("b").alias("partner"), mode.alias("mode")),
        F.struct(F.col("b").alias("protein"), F.col("j").alias("residue"), F.col("a").alias("partner"), mode.alias("mode")),
    )))
    n = ends.groupBy("protein", "residue").agg(F.count_distinct("partner").alias("n_partners"), F.count_distinct("partner", "mode").alias("n_surfaces"))
    return n.select("protein", "residue", "n_partners", "n_surfaces", F.when(F.col("n_partners") > 1, "C").when(F.col("n_surfaces") > 1, "B").otherwise("A").alias("interaction_group"))


def matrix_quality(cells: DataFrame, cut: Cutoffs = DEFAULT) -> DataFrame:
    """MAT-4: density · max(0, 1 - mean PAE / 30) · mean pLDDT / 100 over the contact cells; 0 without contacts. Only of records with pae and pLDDT."""
    cells = cells.where("pae IS NOT NULL AND plddt IS NOT NULL")
    on = told_contact(cells, cut)
    agg = cells.groupBy("matrix_id").agg(F.count("*").alias("n"), F.count_if(on).alias("k"), F.avg(F.when(on, F.col("pae"))).alias("pae"), F.avg(F.when(on, F.col("plddt"))).alias("plddt"))
    quality = F.col("k") / F.col("n") * F.greatest(F.lit(0.0), 1 - F.col("pae") / 30) * F.col("plddt") / 100
    return agg.select("matrix_id", F.col("k").alias("n_contacts"), F.coalesce(quality, F.lit(0.0)).alias("quality"))


def pair_measures(contacts: DataFrame, pairs: DataFrame, shape: DataFrame) -> DataFrame:
    """MAT-3: jaccard, cosine, hamming and Pearson distances of listed pairs of records of one protein pair.

    pairs: (matrix_1, matrix_2); shape: (matrix_id, n_cells). All follow from the sizes and the common
    cells. Records without contacts: jaccard and cosine distance 1 to others, 0 to each other; correlation 1.
    """
    size = contacts.groupBy("matrix_id").agg(F.count("*").alias("k"))
    sized = shape.join(size, "matrix_id", "left").select("matrix_id", "n_cells", F.coalesce("k", F.lit(0)).alias("k"))
    one, two = (sized.select(F.col("matrix_id").alias(f"matrix_{s}"), F.col("k").alias(f"k{s}"), F.col("n_cells").alias(f"cells{s}")) for s in (1, 2))
    first = pairs.join(contacts.select(F.col("matrix_id").alias("matrix_1"), "i", "j"), "matrix_1")
    common = first.join(contacts.select(F.col("matrix_id").alias("matrix_2"), "i", "j"), ["matrix_2", "i", "j"]).groupBy("matrix_1", "matrix_2").agg(F.count("*").alias("c"))
    m = pairs.join(one, "matrix_1").join(two, "matrix_2").join(common, ["matrix_1", "matrix_2"], "left").fillna(0, ["c"])
    c, k1, k2, n = F.col("c").cast("double"), F.col("k1").cast("double"), F.col("k2").cast("double"), F.col("cells1").cast("double")
    union = k1 + k2 - c
    both_empty = (k1 == 0) & (k2 == 0)
    jaccard = F.when(both_empty, 0.0).otherwise(1 - c / union)
    cosine = F.when(both_empty, 0.0).when((k1 == 0) | (k2 == 0), 1.0).otherwise(1 - c / F.sqrt(k1 * k2))
    spread = F.sqrt((n * k1 - k1 * k1) * (n * k2 - k2 * k2))
    r = F.when(spread > 0, (n * c - k1 * k2) / spread).otherwise(F.lit(0.0))
    return m.select("matrix_1", "matrix_2", "k1", "k2", F.col("c").alias("common"), jaccard.alias("jaccard"), cosine.alias("cosine"), ((k1 + k2 - 2 * c) / n).alias("hamming"), (1 - F.abs(r)).alias("correlation"))


def closeness(contacts: DataFrame, pairs: DataFrame, how: str = "mean") -> DataFrame:
    """MAT-3/MAT-5: symmetric mean (or median) of the Manhattan distance from each contact to the nearest of the other record.

    Infinite where one record has no contacts. The join is by listed pair, never all records.
    """
    near = []
    for s, t in ((1, 2), (2, 1)):
        mine = pairs.join(contacts.select(F.col("matrix_id").alias(f"matrix_{s}"), F.col("i").alias("i1"), F.col("j").alias("j1")), f"matrix_{s}")
        both = mine.join(contacts.select(F.col("matrix_id").alias(f"matrix_{t}"), F.col("i").alias("i2"), F.col("j").alias("j2")), f"matrix_{t}", "left")
        d = (F.abs(F.col("i1") - F.col("i2")) + F.abs(F.col("j1") - F.col("j2"))).cast("double")
        least = both.groupBy("matrix_1", "matrix_2", "i1", "j1").agg(F.coalesce(F.min(d), F.lit(float("inf"))).alias("d"))
        value = F.avg("d") if how == "mean" else F.median("d")
        near.append(least.groupBy("matrix_1", "matrix_2").agg(value.alias(f"d{s}")))
    joined = pairs.join(near[0], ["matrix_1", "matrix_2"], "left").join(near[1], ["matrix_1", "matrix_2"], "left")
    far = F.lit(float("inf"))
    return joined.select("matrix_1", "matrix_2", F.col("d1").alias("one_sided"), ((F.coalesce("d1", far) + F.coalesce("d2", far)) / 2).alias("closeness"))


def chain_interactions(contacts: DataFrame, rows: DataFrame, least: int = 5) -> DataFrame:
    """AGG-8: per protein, combination, rank and chain, how many chains of each partner it touches.

    rows: one row per chain pair (matrix_id, p1, p2, c1, c2, combo, rank); a model is a combination and a rank. Long form; pivot() gives the wide one.
    """
    ok = contacts.groupBy("matrix_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("matrix_id")
    touching = rows.join(ok, "matrix_id", "left_semi")
    ends = touching.select("combo", "rank", F.inline(F.array(*(F.struct(F.col(f"p{s}").alias("protein"), F.col(f"c{s}").alias("chain"), F.col(f"p{t}").alias("partner")) for s, t in ((1, 2), (2, 1))))))
    return ends.groupBy("protein", "combo", "rank", "chain", "partner").agg(F.count("*").alias("n_contacts_with"))


def max_valency(interactions: DataFrame) -> DataFrame:
    """AGG-9: the most chains of the partner that one chain touches, per unordered pair."""
    return interactions.groupBy(F.least("protein", "partner").alias("a"), F.greatest("protein", "partner").alias("b")).agg(F.max("n_contacts_with").alias("max_valency"))


def multivalent_fraction(interactions: DataFrame) -> DataFrame:
    """AGG-10: share of chains that touch more than one chain of the partner.

    First over models with exactly three subunits of the two proteins (a pair of one protein counts its copies
    twice, so it has none); if none there, over all N-mers; 0 where there are no chains.
    """
    p, q = F.col("protein"), F.col("partner")
    three = copies(F.col("combo"), p) + copies(F.col("combo"), q) == 3
    many, big = F.col("n_contacts_with") > 1, F.size("combo") > 2
    rows = interactions.groupBy(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).agg(
        F.avg(F.when(three & big, many.cast("double"))).alias("f3"), F.avg(F.when(big, many.cast("double"))).alias("fn"), F.count_if(many).alias("n_multivalent"), F.count("*").alias("n_chains")
    )
    return rows.select("a", "b", "n_multivalent", "n_chains", F.coalesce("f3", F.lit(0.0)).alias("fraction_3"), F.greatest(F.coalesce("f3", F.lit(0.0)), F.coalesce("fn", F.lit(0.0))).alias("fraction"))
