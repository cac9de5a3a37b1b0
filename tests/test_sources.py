import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chainlake.sources import mmcif, pdb
from chainlake.sources import text_files as tf

CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
ATOM 1 N . GLY A 1 1.0 2.0 3.0 1.00 80.0
ATOM 2 CA . GLY A 1 1.5 2.5 3.5 1.00 90.0
ATOM 3 "C5'" . ALA B 1 4.0 5.0 6.0 1.00 50.0
#
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">A1|Alpha\nMKV\nLLA\n\n>B2|Beta\r\nMM\n>C3|\nM>K\n")
    got = {r.prot_id: (r.prot_name, r.seq, r.len) for r in tf.read_fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert got == {"A1": ("Alpha", "MKVLLA", 6), "B2": ("Beta", "MM", 2), "C3": ("", "M>K", 3)}
    assert tf.read_fasta(spark, str(tmp_path / "x.fasta"), use_names=True).where("prot_id = 'Alpha'").count() == 1


def test_discovery_and_scores(spark, tmp_path):
    folder = tmp_path / "A__vs__B"
    folder.mkdir()
    name = "A__vs__B_{}_rank_001_alphafold2_multimer_v3_model_4_seed_000"
    for kind in ("unrelaxed", "relaxed"):
        (folder / f"{name.format(kind)}.pdb").write_text("ATOM\n")
    (folder / f"{name.format('scores')}.json").write_text(json.dumps({"plddt": [1.0], "pae": [[0.5]], "ptm": 0.4, "iptm": 0.3}))
    (tmp_path / "empty").mkdir()
    files = pdb.discover(spark, str(tmp_path))
    assert sorted((r.relaxation, r.name_rank, r.model) for r in files.collect()) == [("relaxed", 1, 4), ("unrelaxed", 1, 4)]
    matched = tf.match_structures(tf.read_scores(spark, str(tmp_path)), files).collect()
    assert len(matched) == 1 and "_relaxed_" in matched[0].path and matched[0].pae == [[0.5]]


def test_af3_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "job.zip", "w") as z:
        for k, iptm in ((0, 0.2), (1, 0.9)):
            z.writestr(f"job/fold_full_data_{k}.json", json.dumps({"atom_plddts": [80, 90, 50], "pae": [[1.0]]}))
            z.writestr(f"job/fold_summary_confidences_{k}.json", json.dumps({"ptm": 0.5, "iptm": iptm}))
            z.writestr(f"job/fold_model_{k}.cif", CIF)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    rows = mmcif.read_af3(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.model, r.rank) for r in rows] == [(1, 1), (0, 2)]
    assert rows[0].plddt == [85.0, 50.0]


def test_cif_to_pdb(spark, tmp_path):
    (tmp_path / "m.cif").write_text(CIF)
    rows = mmcif.read_cif_atoms(spark, str(tmp_path))
    assert sorted(r.atom_name for r in rows.collect()) == ["C5'", "CA", "N"]
    again = rows.select(pdb.atom_line().alias("l")).select(F.struct(*pdb.atom_fields(F.col("l"))).alias("f")).select("f.*").orderBy("atom_no").collect()
    assert [(r.x, r.chain, r.bfactor) for r in again] == [(1.0, "A", 80.0), (1.5, "A", 90.0), (4.0, "B", 50.0)]


def test_name_sequences(spark):
    p = spark.createDataFrame([("P1", "MKV"), ("P2", "AAAMMM")], "prot_id string, seq string")
    c = spark.createDataFrame([("MKV",), ("AMM",), ("WWW",)], "sequence string")
    assert {r.sequence: r.prot_id for r in mmcif.name_sequences(c, p).collect()} == {"MKV": "P1", "AMM": "P2", "WWW": "unknown"}


def test_resolution_must_cover_all(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"A": 0.5}')
    a, b = (spark.createDataFrame([(x,)], "prot_id string") for x in "AB")
    assert tf.read_resolution(spark, str(tmp_path / "r.json"), a).collect()[0].resolution == 0.5
    with pytest.raises(ValueError, match="B"):
        tf.read_resolution(spark, str(tmp_path / "r.json"), b)


def test_models_of_a_trajectory(spark):
    text = "TITLE one\nATOM 1\nENDMDL\nTITLE two\nATOM 2\nENDMDL\n"
    rows = pdb.split_models(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string"), "t", ["k"]).orderBy("model").collect()
    assert [(r.k, r.model, r.title) for r in rows] == [(1, 0, "one"), (1, 1, "two")]


def test_prediction_check(spark):
    e = spark.createDataFrame([("A_b",), ("C",), ("D",)], "name string")
    f = spark.createDataFrame([("ab", "model_0.cif"), ("ab", "job_request.json"), ("c", "model_0.cif"), ("z", "x")], "folder string, file string")
    assert {r.name: r.state for r in tf.check_predictions(e, f).collect()} == {"A_b": "found", "C": "incomplete", "D": "missing", "z": "unexpected"}


def test_overwrite_guard(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b"], 1)], "x array<string>, y int")
    tf.write_tsv(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tf.write_tsv(df, str(tmp_path / "t"))
    tf.write_tsv(df, str(tmp_path / "t"), overwrite=True)


def test_json_chunks(spark):
    df = spark.createDataFrame([(json.dumps([{"n": k} for k in range(65)]),)], "j string")
    rows = tf.split_json(df, "j").orderBy("part").collect()
    assert [(r.part, len(json.loads(r.json))) for r in rows] == [("_part_001", 30), ("_part_002", 30), ("_part_003", 5)]
