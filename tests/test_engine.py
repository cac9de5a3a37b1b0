from pyspark.sql import functions as F

from chainlake import engine
from chainlake.streaming import ingest

N = "p1 string, p2 string, combo array<string>, pred_id bigint, rank int, c1 string, c2 string, min_pae double, pdockq double, cluster string, row_id bigint, at timestamp"


def _rows(pae, ranks=5):
    return [("A", "B", ["A", "A", "B"], 1, r, "A", "B", pae, 0.5, "✔", r, None) for r in range(1, ranks + 1)]


def test_run(spark):
    proteins = spark.createDataFrame([("A",), ("B",), ("C",)], "prot_id string")
    pairs2 = spark.createDataFrame([("A", "B", r, 0.8, 3.0) for r in range(1, 6)], "p1 string, p2 string, rank int, iptm double, min_pae double")
    cells = spark.createDataFrame([(1, "B", "A", 1, 2, 0, 3, 1.0, 80.0, 5.0), (1, "B", "A", 1, 2, 1, 3, 7.5, 80.0, 5.0)], "matrix_id bigint, p1 string, p2 string, rank int, n_chains int, i int, j int, pae double, plddt double, dist double")
    t = engine.Engine(spark).run(proteins, pairs2, spark.createDataFrame(_rows(2.0), N), cells)
    assert {r.protein: r.status for r in t["vertices"].collect()} == {"A": "Static", "B": "Static", "C": "Untested"}
    assert [(r.a, r.b, r.i, r.j) for r in t["contacts"].collect()] == [("A", "B", 3, 0)]
    assert t["ppi_nmers"].count() == 1 and t["open_pairs"].agg(F.sum("n_left")).first()[0] == 5
    assert {(r.combo[0], len(r.combo)) for r in t["suggestions"].where("reason = 'expanded 3-mer'").collect()} == {("A", 3)}
    assert [(r.a, r.b, r.dynamics) for r in t["edge_dynamics"].collect()] == [("A", "B", "Static")]
    assert t["stability"].first().is_stable is False and t["partner_phi"].first().partner == "A"


def test_empty_inputs(spark):
    empty2 = spark.createDataFrame([], "p1 string, p2 string, rank int, iptm double, min_pae double")
    t = engine.Engine(spark).run(spark.createDataFrame([], "prot_id string"), empty2, spark.createDataFrame([], N))
    assert all(df.count() == 0 for df in t.named.values())


def test_combinations_command(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">A|a\nMK\n>B|b\nMV\n")
    engine.main(["combinations", str(tmp_path / "x.fasta"), "-N", "2", "--out_path", str(tmp_path / "out"), "--format", "fasta"])
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert ">A__vs__B" in text and "MK:MV" in text


def test_other_commands(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    engine.main(["split", str(tmp_path / "list.json"), "--chunk", "2", "--out_path", str(tmp_path / "parts")])
    assert {(r.part, r.value) for r in spark.read.text(str(tmp_path / "parts")).collect()} == {("_part_001", '[{"a":1},{"a":2}]'), ("_part_002", '[{"a":3}]')} or spark.read.text(str(tmp_path / "parts")).count() == 2
    (tmp_path / "d.tsv").write_text("Protein_ID\tDomain\tStart\tEnd\nP\t1\t2\t4\n")
    engine.main(["domains", str(tmp_path / "d.tsv"), "--out_path", str(tmp_path / "residues")])
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "residues")).count() == 3
    (tmp_path / "names.txt").write_text("One_Job\nother\n")
    (tmp_path / "runs" / "one-job").mkdir(parents=True)
    for f in ("model_0.cif", "job_request.json"):
        (tmp_path / "runs" / "one-job" / f).write_text("x")
    engine.main(["check", str(tmp_path / "runs"), "--expected", str(tmp_path / "names.txt"), "--out_path", str(tmp_path / "state")])
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "state")).count() == 2


def test_stream_of_predictions(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(_rows(2.0, 3), N).write.parquet(src + "/a")
    stream = ingest.read_new(spark, src + "/*", spark.createDataFrame([], N).schema)
    for more in (None, [("A", "B", ["A", "A", "B"], 1, 4, "A", "B", 2.0, 0.5, "x", 9, None)]):
        if more:
            spark.createDataFrame(more, N).write.parquet(src + "/b")
        q = ingest.keep_states(stream, str(tmp_path / "t"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert ingest.states(spark, str(tmp_path / "t")).first().is_stable is True
    assert ingest.convergence(spark, str(tmp_path / "t")).count() == 1


def test_late_and_repeated_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 05:00:00")], "row_id bigint, t string").select("row_id", F.col("t").cast("timestamp").alias("at"), F.lit("x").alias("k"))
    rows.write.parquet(src)
    q = ingest.windowed_counts(spark.readStream.schema(rows.schema).parquet(src), "at", "k").writeStream.outputMode("complete").format("memory").queryName("late_rows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.k, r.n_rows) for r in spark.table("late_rows").collect()] == [("x", 2)]
