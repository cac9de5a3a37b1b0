"""Combinations of subunits: generation, containment, convergence and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.operators.series import numbered


def combinations(items: DataFrame, k: int, most_copies: int | None = None) -> DataFrame:
    """SET-2: sorted combinations with replacement of size k: (members).

    The result has C(n + k - 1, k) rows by its nature; it is grown member by member from a range join, each
    step keeping only sorted ones. most_copies limits how often one item may stand in it.
    """
    base = items.select(F.col(items.columns[0]).alias("x")).where("x IS NOT NULL").distinct()
    grown = base.select(F.array("x").alias("members"))
    for _ in range(k - 1):
        grown = grown.join(base, F.col("x") >= F.element_at("members", -1)).select(F.concat("members", F.array("x")).alias("members"))
        if most_copies:
            grown = grown.where(F.size(F.filter("members", lambda q: q == F.element_at("members", -1))) <= most_copies)
    return grown


def _count(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda q: q == x))


def multiset_common(a: Column, b: Column) -> Column:
    """SET-6: size of the multiset intersection."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(_count(a, x), _count(b, x)))


def multiset_united(a: Column, b: Column) -> Column:
    """SET-6: size of the multiset union."""
    return F.size(a) + F.size(b) - multiset_common(a, b)


def consecutive(rows: DataFrame, column: str) -> DataFrame:
    """Each value with the next one in order, without one window over all rows.

    Rows are range-partitioned; within a partition the next is a window, and the first values of the partitions,
    as many as there are partitions, link the ends.
    """
    sorted_ = rows.select(column).repartitionByRange(column).withColumn("part", F.spark_partition_id())
    inside = sorted_.withColumn("next", F.lead(column).over(Window.partitionBy("part").orderBy(column)))
    firsts = sorted_.groupBy("part").agg(F.min(column).alias("next_first"))
    order = firsts.select("part", F.lead("next_first").over(Window.orderBy("part")).alias("after"))  # one row a partition
    return inside.join(F.broadcast(order), "part").select(column, F.coalesce("next", "after").alias("next")).where("next IS NOT NULL")


def parents(combos: DataFrame, column: str = "combo") -> DataFrame:
    """All combinations with one member less: (combo, parent, removed), each parent once."""
    spread = combos.select(column, F.posexplode(column).alias("ix", "removed"))
    less = spread.select(column, F.filter(column, lambda x, i: i != F.col("ix")).alias("parent"), "removed")
    return less.distinct()


def containment_edges(combos: DataFrame, most: int = 1, column: str = "combo") -> DataFrame:
    """JN-16: (parent, child, order_jump): child contains parent and has at most `most` members more.

    Parents are made by deletion and found by an equi join; a combination of n members has at most C(n, most) of them.
    """
    known = combos.select(F.col(column).alias("child")).distinct()
    level = known.select("child", F.col("child").alias("parent"))
    found = None
    names = known.select(F.col("child").alias("parent"))
    for k in range(1, most + 1):
        spread = level.where(F.size("parent") > 1).select("child", "parent", F.posexplode("parent").alias("ix", "removed"))
        level = spread.select("child", F.filter("parent", lambda x, i: i != F.col("ix")).alias("parent")).distinct()
        here = level.join(names, "parent", "left_semi").select("parent", "child", F.lit(k).alias("order_jump"))
        found = here if found is None else found.unionByName(here)
    return found


def unbridged(edges: DataFrame, states: DataFrame) -> DataFrame:
    """JN-17: edges of jump 1, and longer ones with no stable combination between parent and child."""
    stable = states.where("is_stable").select(F.col("combo").alias("mid"))
    long_ = edges.where("order_jump > 1")
    up = edges.select("parent", F.col("child").alias("mid"), F.col("order_jump").alias("j1")).join(stable, "mid", "left_semi")
    down = edges.select(F.col("parent").alias("mid"), "child", F.col("order_jump").alias("j2"))
    bridged = up.join(down, "mid").select("parent", "child", (F.col("j1") + F.col("j2")).alias("order_jump")).distinct()
    kept = long_.join(bridged, ["parent", "child", "order_jump"], "left_anti")
    return edges.where("order_jump = 1").unionByName(kept.select(*edges.columns))


def convergence(states: DataFrame, edges: DataFrame) -> DataFrame:
    """LAT-3: is_convergent per combination.

    Stable and every child unstable: true; any child stable: false; else, with an untested child, unknown.
    Unstable and untested ones, and those without children, are not convergent: false, null and null.
    """
    child = states.select(F.col("combo").alias("child"), F.col("is_stable").alias("child_stable"))
    kids = edges.where("order_jump = 1").join(child, "child").groupBy(F.col("parent").alias("combo"))
    agg = kids.agg(F.count_if(F.col("child_stable")).alias("n_stable"), F.count_if(~F.col("child_stable")).alias("n_unstable"), F.count_if(F.col("child_stable").isNull()).alias("n_untested"))
    x = states.join(agg, "combo", "left")
    value = (
        F.when(F.col("is_stable").isNull() | (F.col("is_stable") & F.col("n_stable").isNull()), F.lit(None).cast("boolean"))
        .when(~F.col("is_stable"), False).when(F.col("n_stable") > 0, False).when(F.col("n_untested") > 0, F.lit(None).cast("boolean")).otherwise(True)
    )
    return x.select("combo", "is_stable", F.coalesce("n_stable", F.lit(0)).alias("n_stable"), F.coalesce("n_unstable", F.lit(0)).alias("n_unstable"), F.coalesce("n_untested", F.lit(0)).alias("n_untested"), value.alias("is_convergent"))


def state_name(stable: Column) -> Column:
    return F.when(stable.isNull(), "Untested").when(stable, "Stable").otherwise("Unstable")


def transitions(edges: DataFrame, states: DataFrame) -> DataFrame:
    """LAT-4: category of each edge by the states of its ends, and the members added."""
    one, two = (states.select(F.col("combo").alias(n), state_name(F.col("is_stable")).alias(f"{n}_state")) for n in ("parent", "child"))
    x = edges.join(one, "parent").join(two, "child")
    # a child is sorted and contains its parent: the difference keeps, for each member, the surplus copies
    added = F.flatten(F.transform(F.array_distinct("child"), lambda p: F.array_repeat(p, F.size(F.filter("child", lambda q: q == p)) - F.size(F.filter("parent", lambda q: q == p)))))
    return x.select("parent", "child", "order_jump", F.concat("parent_state", F.lit("->"), "child_state").alias("category"), added.alias("variation"))


def connection_types(edges: DataFrame, states: DataFrame) -> DataFrame:
    """LAT-4: how the child of each edge comes from its parent, by the state of the members added: (…, connection).

    One member is monomer_addition; more are stable, unstable or untested additions of a k-mer that is a state, else complex_addition.
    """
    known = states.select(F.col("combo").alias("added"), state_name(F.col("is_stable")).alias("added_state"))
    x = edges.withColumn("added", F.array_sort("variation")).join(known, "added", "left")
    n = F.size("added")
    kind = F.when(n == 1, F.lit("monomer_addition")).when(F.col("added_state").isNotNull(), F.concat(F.lower("added_state"), F.lit("_"), n.cast("string"), F.lit("mer_addition"))).otherwise("complex_addition")
    return x.withColumn("connection", kind).drop("added", "added_state")


def partners(links: DataFrame) -> DataFrame:
    """(member, x): each protein with those it interacts with, from pairs (p1, p2) in any order."""
    return links.select(F.inline(F.array(F.struct(F.col("p1").alias("member"), F.col("p2").alias("x")), F.struct(F.col("p2").alias("member"), F.col("p1").alias("x"))))).distinct()


def grown(states: DataFrame, links: DataFrame, repeat_size: int = 5, allowed_repeats: DataFrame | None = None) -> DataFrame:
    """LAT-1: (parent, combo): each stable combination with one protein more that interacts with one of its members.

    So the graph of a combination's members stays connected, proteins without interactions are never added, and no combination
    meets all proteins. From repeat_size members on, a protein that is already there may be added only if it stands in
    allowed_repeats (multivalent or homo-oligomeric proteins).
    """
    stable = states.where("is_stable").select("combo", F.explode(F.array_distinct("combo")).alias("member"))
    made = stable.join(partners(links), "member").select("combo", "x").distinct()
    fresh = ~F.array_contains("combo", F.col("x")) | (F.size("combo") + 1 < repeat_size)
    if allowed_repeats is None:
        made = made.where(fresh)
    else:
        ok = allowed_repeats.select(F.col(allowed_repeats.columns[0]).alias("x"), F.lit(True).alias("ok")).distinct()
        made = made.join(ok, "x", "left").where(fresh | F.coalesce("ok", F.lit(False)))
    return made.select(F.col("combo").alias("parent"), F.array_sort(F.concat("combo", F.array("x"))).alias("combo"))


def candidates(states: DataFrame, links: DataFrame, repeat_size: int = 5, allowed_repeats: DataFrame | None = None) -> DataFrame:
    """LAT-1: untested combinations of a stable one and one protein that interacts with it: (combo, n_stable_parents)."""
    made = grown(states, links, repeat_size, allowed_repeats)
    return made.groupBy("combo").agg(F.count_distinct("parent").alias("n_stable_parents")).join(states.select("combo"), "combo", "left_anti")


def open_pairs(items: DataFrame, done: DataFrame) -> DataFrame:
    """LAT-7/JN-12: (item, n_partners, n_done, n_left): for each item the pairs with itself and the items after it, and how many of them are done.

    The untested pairs are all pairs less the done ones: both are given by short tables, and the pairs themselves, whose number grows with the
    square of the items, are never made. done: (p1, p2) in any order, repeated or not; pairs with other items don't count.
    """
    x = items.select(F.col(items.columns[0]).alias("item")).where("item IS NOT NULL").distinct()
    placed = numbered(x, [], ["item"])
    n = placed.agg(F.count("*")).first()[0]
    pair = done.select(F.least("p1", "p2").alias("item"), F.greatest("p1", "p2").alias("other")).where("item IS NOT NULL").distinct()
    inside = pair.join(x, "item", "left_semi").join(x.withColumnRenamed("item", "other"), "other", "left_semi")
    counts = inside.groupBy("item").agg(F.count("*").alias("n_done"))
    all_ = F.lit(n) - F.col("ord") + 1
    done_ = F.coalesce("n_done", F.lit(0))
    return placed.join(counts, "item", "left").select("item", all_.alias("n_partners"), done_.alias("n_done"), (all_ - done_).alias("n_left"))


def decomposable(counts: dict[str, int], kmers: list[tuple[str, ...]]) -> bool:
    """LAT-2: whether a multiset is a sum of the given k-mers, taking the first that fits each time."""
    left = dict(counts)
    while any(left.values()):
        for k in kmers:
            need = {x: k.count(x) for x in k}
            if all(left.get(x, 0) >= n for x, n in need.items()):
                for x, n in need.items():
                    left[x] -= n
                break
        else:
            return False
    return True


def homo_states(rows: DataFrame, n_ranks: int = 4, pae: float = 7.5, dimers: DataFrame | None = None) -> DataFrame:
    """GRF-7: (protein, n, tested, stable) for every size 2..largest + 1 of each protein's homo-oligomers; untested ones are null.

    rows: (combo, rank, min_pae) of combinations of one protein; dimers (protein, stable): what the 2-mers say about size 2, which goes first.
    """
    homo = rows.where((F.size(F.array_distinct("combo")) == 1) & (F.size("combo") > 1))
    have = homo.groupBy(F.col("combo")[0].alias("protein"), F.size("combo").alias("n")).agg((F.count_distinct(F.when(F.col("min_pae") <= pae, F.col("rank"))) >= n_ranks).alias("stable"))
    if dimers is not None:
        two = dimers.select("protein", F.lit(2).alias("n"), F.col("stable").alias("first"))
        have = have.join(two, ["protein", "n"], "full_outer").select("protein", "n", F.coalesce("first", "stable").alias("stable"))
    sizes = have.groupBy("protein").agg(F.max("n").alias("top")).select("protein", F.explode(F.sequence(F.lit(2), F.col("top") + 1)).alias("n"))
    return sizes.join(have, ["protein", "n"], "left").select("protein", "n", F.col("stable").isNotNull().alias("tested"), "stable")


def homo_breaks(states: DataFrame) -> DataFrame:
    """GRF-7: per protein the first size that is not stable although the one before is, and the first that is untested: (protein, first_break, first_untested); null where there is none."""
    w = Window.partitionBy("protein").orderBy("n")
    before = F.coalesce(F.lag("stable").over(w), F.lit(True))
    x = states.withColumn("_broken", ~F.coalesce("stable", F.lit(True)) & before)
    return x.groupBy("protein").agg(F.min(F.when(F.col("_broken"), F.col("n"))).alias("first_break"), F.min(F.when(~F.col("tested"), F.col("n"))).alias("first_untested"))


def suggestions(links: DataFrame, computed: DataFrame, states: DataFrame, homo: DataFrame | None = None, multivalent: DataFrame | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """LAT-6: what to model next beyond 2-mers: (combo, reason). Untested 2-mers are told by open_pairs().

    The next homo-oligomer after a stable one; homo-oligomers missing below the largest one tested (homo: as from homo_states());
    untested neighbours of stable combinations (at most two copies of a protein beyond size 3); both 3-mers of two copies of one protein and one of the
    other for monovalent pairs of different proteins; for multivalent pairs (a, b) the largest stable combination of the two with one more of either.
    Minus what is computed and combinations that fall back. links: interacting pairs (p1, p2).
    """
    stable_homo = states.where((F.size(F.array_distinct("combo")) == 1) & F.col("is_stable"))
    parts = [stable_homo.select(F.array_repeat(F.col("combo")[0], F.size("combo") + 1).alias("combo"), F.lit("homo N+1").alias("reason"))]
    near = candidates(states, links).select("combo", F.lit("neighbour").alias("reason"))
    most = F.array_max(F.transform(F.array_distinct("combo"), lambda p: F.size(F.filter("combo", lambda q: q == p))))
    parts.append(near.where((F.size("combo") <= 3) | (most <= 2)))
    if homo is not None:
        top = homo.where("tested").groupBy("protein").agg(F.max("n").alias("top"))
        gaps = homo.where("NOT tested").join(top, "protein").where("n < top")
        parts.append(gaps.select(F.array_repeat("protein", F.col("n").cast("int")).alias("combo"), F.lit("missing homo").alias("reason")))
    pairs = links.select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).where("a <> b").distinct()
    single = pairs if multivalent is None else pairs.join(multivalent.select("a", "b"), ["a", "b"], "left_anti")
    parts.append(single.select(F.explode(F.array(F.array("a", "a", "b"), F.array("a", "b", "b"))).alias("combo"), F.lit("expanded 3-mer").alias("reason")))
    if multivalent is not None:
        own = states.where("is_stable").select("combo", F.col("combo")[0].alias("a"), F.element_at("combo", -1).alias("b")).where((F.size("combo") > 1) & F.forall("combo", lambda p: (p == F.col("a")) | (p == F.col("b"))))
        largest = own.join(multivalent.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.max(F.struct(F.size("combo").alias("n"), "combo")).alias("m"))
        child = F.explode(F.array(*(F.array_sort(F.concat("m.combo", F.array(x))) for x in ("a", "b"))))
        parts.append(largest.select(child.alias("combo"), F.lit("multivalent child").alias("reason")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    left = every.groupBy("combo").agg(F.min("reason").alias("reason")).join(computed.select("combo"), "combo", "left_anti")
    return left if fallback is None else left.join(fallback.select("combo"), "combo", "left_anti")
