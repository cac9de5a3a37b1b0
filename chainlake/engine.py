"""One call from inputs to named tables, and the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.config import DEFAULT, Cutoffs
from chainlake.functions.metrics import chain_index
from chainlake.operators import contacts, graph, lattice, ppi, statistics
from chainlake.sources import mmcif, text_files


@dataclass
class Tables:
    """Named results of a run."""

    named: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.named[name]

    def save(self, path: str, overwrite: bool = False) -> None:
        for name, df in self.named.items():
            text_files.write_tsv(df, f"{path}/{name}", overwrite)


class Engine:
    """Runs the whole analysis over logical relations; every table is lazy until used.

    pairs2: (p1, p2, rank, iptm, min_pae); pairs_n: (p1, p2, combo, pred_id, rank, c1, c2, min_pae, pdockq, cluster);
    proteins: (prot_id, …); cells (optional): contact cells as contacts.contact_cells takes them.
    """

    def __init__(self, spark: SparkSession, cut: Cutoffs = DEFAULT):
        self.spark, self.cut = spark, cut

    def run(self, proteins: DataFrame, pairs2: DataFrame, pairs_n: DataFrame, cells: DataFrame | None = None) -> Tables:
        cut = self.cut
        ok = pairs_n.where("combo IS NOT NULL AND size(combo) > 0")
        f2, fn = ppi.detect_2mers(pairs2, cut), ppi.detect_nmers(ok, cut)
        states = ok.groupBy("combo").agg((F.count_distinct(F.when(F.col("min_pae") <= cut.min_pae, F.col("rank"))) >= cut.n_models).alias("is_stable"))
        edges = lattice.containment_edges(states)
        t = Tables({"ppi_2mers": f2, "ppi_nmers": fn, "states": states, "convergence": lattice.convergence(states, edges), "lattice": lattice.transitions(edges, states), "edges": graph.edge_weights(f2, "iptm")})
        t.named["suggestions"] = lattice.suggestions(f2.select("p1", "p2").unionByName(fn.select("p1", "p2")), states, states, lattice.homo_states(ok, cut.n_models, cut.min_pae))
        t.named["open_pairs"] = lattice.open_pairs(proteins.select("prot_id"), pairs2.select("p1", "p2"))
        names = lambda x: x.select(F.explode(F.array("p1", "p2")).alias("p")).distinct()
        t.named["vertices"] = graph.vertex_status(proteins.select("prot_id"), names(pairs2), names(pairs_n), names(f2), names(fn))
        t.named["homo_states"] = lattice.homo_states(ok, cut.n_models, cut.min_pae)
        t.named["homo_breaks"] = lattice.homo_breaks(t["homo_states"])
        models = ok.where("pred_id IS NOT NULL").groupBy(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b"), "pred_id").agg(F.bool_or(F.coalesce(F.col("min_pae") <= cut.min_pae, F.lit(False))).alias("hit"), F.max("combo").alias("combo"))
        t.named["partner_phi"] = statistics.partner_phi(models)
        t.named["partner_correlation"] = statistics.partner_correlation(ok.select(F.col("p1").alias("protein"), F.col("min_pae").alias("value"), "combo"))
        t.named["stability"] = self._stability(ok)
        found = None if cells is None else contacts.contact_cells(cells, cut)
        t.named["edge_dynamics"] = graph.classify_edges(self._edge_features(pairs2, pairs_n, found), graph.default_rules(self.spark), cut.contacts)
        if cells is not None:
            t.named["contacts"] = found
            t.named["residue_groups"] = contacts.residue_groups(found)
        return t


    def _stability(self, rows: DataFrame) -> DataFrame:
        """Dynamic stability of each combination: from which PAE on its models' chains are one graph."""
        x = rows.where("pred_id IS NOT NULL AND rank IS NOT NULL")
        keys = ["combo", "pred_id", "rank"]
        links = x.where("c1 IS NOT NULL AND c2 IS NOT NULL").select(*keys, chain_index(F.col("c1")).alias("a"), chain_index(F.col("c2")).alias("b"), F.col("min_pae").alias("pae"))
        ranks = graph.connecting_pae(links, x.select(*keys, F.size("combo").alias("n")).distinct(), keys).select("combo", F.struct("pred_id", "rank").alias("rank"), "pae")
        return graph.dynamic_stability(ranks, ["combo"], [(12.96, 5), (10.53, 4), (7.21, 3)])

    def _edge_features(self, pairs2: DataFrame, pairs_n: DataFrame, found: DataFrame | None) -> DataFrame:
        """What the classification rules ask of every tested pair."""
        pair = F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")
        hit, no = F.col("min_pae") <= self.cut.min_pae, F.lit(False)
        two = pairs2.groupBy(*pair).agg((F.count_if(hit) >= self.cut.n_models).alias("h2"))
        ok = F.coalesce(F.contains("cluster", F.lit("✔")), no).cast("double")
        many = pairs_n.groupBy(*pair).agg((F.count_distinct(F.when(hit, F.col("rank"))) >= self.cut.n_models).alias("hn"), F.avg(ok).alias("variation"))
        x = two.join(many, ["a", "b"], "full_outer")
        if found is None:
            x = x.withColumn("n_contacts", F.lit(0).cast("bigint"))
        else:
            x = x.join(found.where("n_chains > 2").select("a", "b", "i", "j").distinct().groupBy("a", "b").agg(F.count("*").alias("n_contacts")), ["a", "b"], "left")
        return x.select(
            "a", "b", F.col("h2").isNotNull().alias("tested2"), F.col("hn").isNotNull().alias("tested_n"), F.coalesce("h2", no).alias("in2"), F.coalesce("hn", no).alias("in_n"), F.coalesce("variation", F.lit(0.0)).alias("variation"), F.coalesce("n_contacts", F.lit(0)).alias("n_contacts")
        )


def main(argv: list[str] | None = None) -> int:
    """chainlake run: the analysis over parquet tables; combinations: all of size N of a FASTA file; af3: ranks of result archives; check: expected predictions against a folder; split: a JSON list in parts; domains: residues of a domain table."""
    parser = argparse.ArgumentParser(prog="chainlake", description=main.__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("tables", help="folder of the parquet tables")
    run.add_argument("--out_path", required=True)
    run.add_argument("--N_value", type=int, default=DEFAULT.n_models)
    run.add_argument("--pae", type=float, default=DEFAULT.min_pae)
    run.add_argument("--overwrite", action="store_true")
    combos = sub.add_parser("combinations")
    combos.add_argument("fasta_file")
    combos.add_argument("-N", type=int, default=2)
    combos.add_argument("--max_protein_repetition", type=int)
    combos.add_argument("--use_names", action="store_true")
    combos.add_argument("--format", choices=("json", "fasta", "txt"), default="txt")
    combos.add_argument("--out_path", required=True)
    for name, what in (("af3", "folder of result archives (zip)"), ("check", "folder of predictions"), ("split", "JSON file of one list"), ("domains", "domain TSV (Protein_ID, Domain, Start, End)")):
        other = sub.add_parser(name)
        other.add_argument("path", help=what)
        other.add_argument("--out_path", required=True)
        other.add_argument("--overwrite", action="store_true")
        if name == "check":
            other.add_argument("--expected", required=True, help="text file of expected names, one a line")
        if name == "split":
            other.add_argument("--chunk", type=int, default=30)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("chainlake").getOrCreate()
    if args.command == "run":
        from chainlake.plans import views
        from chainlake.plans.catalog import table

        engine = Engine(spark, DEFAULT.with_(n_models=args.N_value, min_pae=args.pae))
        engine.run(table(spark, args.tables, "proteins"), views.pairwise2(spark, args.tables), views.pairwise_n(spark, args.tables), views.cells(spark, args.tables)).save(args.out_path, args.overwrite)
        return 0
    if args.command == "af3":
        text_files.write_tsv(mmcif.read_af3(spark, args.path).select("prediction", "model", "rank", "ptm", "iptm", "plddt"), args.out_path, args.overwrite)
        return 0
    if args.command == "check":
        expected = spark.read.text(args.expected).select(F.trim("value").alias("name")).where("name <> ''")
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.path).select("path")
        files = listed.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"))
        text_files.write_tsv(text_files.check_predictions(expected, files), args.out_path, args.overwrite)
        return 0
    if args.command == "split":
        parts = text_files.split_json(spark.read.option("wholetext", "true").text(args.path), "value", args.chunk)
        parts.select("part", F.col("json").alias("value")).write.mode("overwrite" if args.overwrite else "errorifexists").partitionBy("part").text(args.out_path)
        return 0
    if args.command == "domains":
        text_files.write_tsv(text_files.expand_domains(text_files.read_domains(spark, args.path)), args.out_path, args.overwrite)
        return 0
    proteins = text_files.read_fasta(spark, args.fasta_file, args.use_names)
    found = lattice.combinations(proteins.select("prot_id"), args.N, args.max_protein_repetition).withColumnRenamed("members", "combo")
    out = {"json": lambda: text_files.job_json(found, proteins).select(F.col("job").alias("value")), "fasta": lambda: text_files.job_fasta(found, proteins), "txt": lambda: found.select(F.array_join("combo", ",").alias("value"))}
    out[args.format]().write.mode("overwrite").text(args.out_path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
