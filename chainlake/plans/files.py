"""Queries of the file sources and sinks: each writes what it needs to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainlake.functions import metrics as m
from chainlake.plans import catalog
from chainlake.plans import views as v
from chainlake.plans.catalog import query, table
from chainlake.plans.relations import passing_n
from chainlake.plans.structures import _STATES, _states, lat_6
from chainlake.sources import mmcif
from chainlake.sources import text_files as tf
from chainlake.storage import Scratch


@query("src_1_fasta", "SELECT prot_id, coalesce(prot_name, '') AS prot_name, seq, len FROM proteins")
def src_1(spark, d):
    """Round trip of the protein table through FASTA."""
    scratch = Scratch(spark, "fasta")
    tf.write_fasta(table(spark, d, "proteins"), scratch.path("proteins"))
    return tf.read_fasta(spark, scratch.path("proteins")).select("prot_id", F.coalesce("prot_name", F.lit("")).alias("prot_name"), "seq", "len")


@query("src_6_json_fields", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events WHERE props IS NOT NULL")
def src_6(spark, d):
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "src_7_relaxed_first",
    r"""WITH f AS (SELECT file_id, pred_id, rank, CASE WHEN contains(pdb_file, '_unrelaxed_') THEN 1 ELSE 0 END AS o FROM all_pdb_data WHERE rank IS NOT NULL) SELECT pred_id, rank, arg_min(file_id, (o, file_id)) AS file_id FROM f GROUP BY 1, 2""",
)
def src_7(spark, d):
    f = table(spark, d, "all_pdb_data").where("rank IS NOT NULL").withColumn("o", F.when(F.contains("pdb_file", F.lit("_unrelaxed_")), 1).otherwise(0))
    return f.groupBy("pred_id", "rank").agg(F.min_by("file_id", F.struct("o", "file_id")).alias("file_id"))


@query("src_11_domain_residues", "SELECT prot_id AS protein, domain, residue FROM (SELECT prot_id, 1 AS domain, unnest(range(1, len // 2 + 1))::INT AS residue FROM proteins UNION ALL SELECT prot_id, 2, unnest(range(len // 2 + 1, len + 1))::INT FROM proteins)")
def src_11(spark, d):
    """Two halves of each protein through a domain TSV and back, one row a residue."""
    scratch = Scratch(spark, "domains")
    half = F.expr("CAST(len DIV 2 AS INT)")
    p = table(spark, d, "proteins")
    rows = p.select(F.col("prot_id").alias("Protein_ID"), F.lit(1).alias("Domain"), F.lit(1).alias("Start"), half.alias("End")).unionByName(
        p.select(F.col("prot_id").alias("Protein_ID"), F.lit(2).alias("Domain"), (half + 1).alias("Start"), F.col("len").alias("End"))
    )
    tf.write_tsv(rows, scratch.path("domains"), overwrite=True)
    return tf.expand_domains(tf.read_domains(spark, scratch.path("domains"))).select(F.col("Protein_ID").alias("protein"), F.col("Domain").alias("domain"), "residue")


@query("src_13_rules", "SELECT * FROM (VALUES ('No 2-mers Data', false), ('No N-mers Data', true), ('Strong Negative', true), ('Static', true), ('Weak Negative', true), ('Negative', true), ('Strong Positive', true), ('Positive', true), ('Weak Positive', true), ('Indirect', true)) t(dynamics, tested2)")
def src_13(spark, d):
    """The rule table through TSV and back."""
    from chainlake.operators.graph import default_rules

    scratch = Scratch(spark, "rules")
    tf.write_tsv(default_rules(spark), scratch.path("rules"), overwrite=True)
    return tf.read_rules(spark, scratch.path("rules")).select("dynamics", "tested2")


@query("src_15_prediction_check", "WITH f AS (SELECT pred_id, bool_or(content IS NOT NULL AND content <> '') AS ok FROM all_pdb_data GROUP BY 1), e AS (SELECT DISTINCT pred_id FROM pairwise_2mers_df WHERE pred_id IS NOT NULL) SELECT coalesce(e.pred_id, f.pred_id)::VARCHAR AS name, CASE WHEN f.pred_id IS NULL THEN 'missing' WHEN e.pred_id IS NULL THEN 'unexpected' WHEN ok THEN 'found' ELSE 'incomplete' END AS state FROM e FULL JOIN f ON e.pred_id = f.pred_id WHERE coalesce(e.pred_id, f.pred_id) IS NOT NULL")
def src_15(spark, d):
    expected = table(spark, d, "pairwise_2mers_df").where("pred_id IS NOT NULL").select(F.col("pred_id").cast("string").alias("name")).distinct()
    full = F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.lit("model_0.cif")).otherwise(F.lit("empty"))
    files = table(spark, d, "all_pdb_data").where("pred_id IS NOT NULL").select(F.col("pred_id").cast("string").alias("folder"), full.alias("file"))
    return tf.check_predictions(expected, files, required=("model_0.cif",))


@query("snk_1_pairwise_tsv", "SELECT row_id, rank, min_pae FROM pairwise_2mers_df")
def snk_1(spark, d):
    scratch = Scratch(spark, "tsv")
    tf.write_tsv(table(spark, d, "pairwise_2mers_df").select("row_id", "rank", "min_pae", "sorted_tuple_pair"), scratch.path("pairs"), overwrite=True)
    rows = spark.read.option("sep", "\t").option("header", "true").schema("row_id bigint, rank int, min_pae double, sorted_tuple_pair string").csv(scratch.path("pairs"))
    return rows.select("row_id", "rank", "min_pae")


@query(
    "snk_3_job_json",
    "WITH s AS (" + catalog._SQL["lat_6_suggestions"] + "), e AS (SELECT combo, unnest(string_split(combo, '|')) AS p FROM s) SELECT replace(combo, '|', '__vs__') AS name, count(DISTINCT p) AS n_proteins, count(*) AS n_chains FROM e JOIN proteins ON prot_id = p GROUP BY combo",
)
def snk_3(spark, d):
    """A job of each suggestion as JSON, read back."""
    combos = lat_6(spark, d).select(F.split("combo", "\\|").alias("combo"))
    jobs = tf.job_json(combos, table(spark, d, "proteins")).select("name", F.from_json("job", "sequences array<struct<proteinChain: struct<sequence: string, count: bigint>>>").alias("j"))
    return jobs.select("name", F.size("j.sequences").cast("bigint").alias("n_proteins"), F.aggregate("j.sequences", F.lit(0).cast("bigint"), lambda n, x: n + x["proteinChain"]["count"]).alias("n_chains"))


@query(
    "snk_3_job_fasta",
    "WITH " + _STATES + """, e AS (SELECT combo, unnest(combo) AS p, generate_subscripts(combo, 1) AS i FROM states WHERE is_stable) SELECT '>' || array_to_string(combo, '__vs__') || chr(10) || string_agg(seq, ':' ORDER BY i) AS value FROM e JOIN proteins ON prot_id = p GROUP BY combo""",
)
def snk_3b(spark, d):
    return tf.job_fasta(_states(spark, d).where("is_stable").select("combo"), table(spark, d, "proteins"))


@query("snk_6_residue_json", "SELECT c.file_id, count(*) AS n_chains FROM (SELECT file_id, unnest(chains) AS c FROM all_pdb_data) c GROUP BY 1")
def snk_6(spark, d):
    """A JSON object of chain to length per file, read back as a map."""
    rows = table(spark, d, "all_pdb_data").select("file_id", F.inline("chains"))
    js = tf.residue_json(rows, "file_id", "chain_id", "length")
    return js.select("file_id", F.size(F.from_json("json", "map<string,int>")).cast("bigint").alias("n_chains"))


@query("snk_5_pdb_round_trip", "SELECT count(*) AS n_atoms FROM (SELECT unnest(string_split_regex(content, '\\r?\\n|\\r')) AS r FROM all_pdb_data) WHERE starts_with(r, 'ATOM ')")
def snk_5(spark, d):
    """ATOM lines written anew from their fields and parsed again."""
    from chainlake.plans.views import atoms
    from chainlake.sources.pdb import atom_fields, atom_line

    again = atoms(spark, d).select("x", "y", "z", "res_no", atom_line().alias("l")).select("x", "y", "z", "res_no", F.struct(*atom_fields(F.col("l"))).alias("f"))
    return again.where("x = f.x AND y = f.y AND z = f.z AND res_no = f.res_no").agg(F.count("*").alias("n_atoms"))


@query("rep_1_passing_index", None)
def rep_1(spark, d):
    """The report index of the files that the passing combinations would have."""
    names = passing_n(spark, d).select(F.concat(F.lit("report/"), "p1", F.lit("__vs__"), "p2", F.lit("-contact_clusters.html")).alias("path")).distinct()
    return tf.report_index(names)


@query(
    "src_8_af3_ranks",
    f"""WITH {v.PW2}, r AS (SELECT pred_id, rank, arg_min(iptm, row_id) AS iptm, arg_min(ptm, row_id) AS ptm FROM pw2 WHERE pred_id IS NOT NULL AND rank IS NOT NULL AND iptm IS NOT NULL AND ptm IS NOT NULL GROUP BY 1, 2)
    SELECT 'p' || pred_id AS prediction, (rank - 1)::INT AS model, row_number() OVER (PARTITION BY pred_id ORDER BY iptm DESC, rank)::INT AS rank, iptm, ptm, 75.0::DOUBLE AS plddt, 2 AS n_residues FROM r""",
)
def src_8(spark, d):
    """Models of each prediction as AF3 archives (zip), read back and ranked by ipTM; atom confidences become means per residue."""
    scratch = Scratch(spark, "af3")
    x = v.pairwise2(spark, d).where("pred_id IS NOT NULL AND rank IS NOT NULL AND iptm IS NOT NULL AND ptm IS NOT NULL")
    best = x.groupBy("pred_id", "rank").agg(F.min_by("iptm", "row_id").alias("iptm"), F.min_by("ptm", "row_id").alias("ptm"))
    models = best.groupBy("pred_id").agg(F.collect_list(F.struct((F.col("rank") - 1).alias("model"), "iptm", "ptm")).alias("models"))
    folder = scratch.path("zips")
    tf.make_folder(spark, folder)

    def pack(batches):
        import io
        import json
        import zipfile

        import pandas as pd
        from pyarrow import fs as pfs

        system, root = pfs.FileSystem.from_uri(folder)
        head = "data_m\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n"
        for b in batches:
            for pred, rows in zip(b["pred_id"], b["models"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for m in rows:
                        z.writestr(f"p{pred}_full_data_{m['model']}.json", json.dumps({"atom_plddts": [70.0, 80.0, 75.0], "pae": [[0.5, 1.0], [1.0, 0.5]]}))
                        z.writestr(f"p{pred}_summary_confidences_{m['model']}.json", json.dumps({"ptm": m["ptm"], "iptm": m["iptm"]}))
                        z.writestr(f"p{pred}_model_{m['model']}.cif", head + "ATOM 1 A 1\nATOM 2 A 1\nATOM 3 B 1\n#\n")
                with system.open_output_stream(f"{root}/p{pred}.zip") as out:
                    out.write(held.getvalue())
            yield pd.DataFrame({"pred_id": b["pred_id"]})

    models.mapInPandas(pack, "pred_id bigint").write.format("noop").mode("overwrite").save()
    got = mmcif.read_af3(spark, folder)
    return got.select("prediction", "model", "rank", "iptm", "ptm", F.col("plddt")[0].alias("plddt"), F.size("plddt").alias("n_residues"))


_LETTERS = "CASE res_name " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in m.AMINO_ACIDS.items()) + " END"


@query(
    "src_9_named_sequences",
    f"""WITH {v.ATOMS}, r AS (SELECT file_id, chain, res_no, ins, min({_LETTERS}) AS l FROM atom WHERE {_LETTERS} IS NOT NULL AND res_no IS NOT NULL GROUP BY 1, 2, 3, 4), q AS (SELECT file_id, chain, string_agg(l, '' ORDER BY res_no, ins) AS sequence FROM r GROUP BY 1, 2),
    o AS (SELECT DISTINCT sequence FROM q WHERE sequence NOT IN (SELECT seq FROM proteins WHERE seq IS NOT NULL) AND length(sequence) >= 3), c AS (SELECT sequence, arg_min(prot_id, (abs(length(seq) - length(sequence)), prot_id)) AS part FROM o JOIN proteins ON length(seq) >= 3 AND (contains(seq, sequence) OR contains(sequence, seq)) GROUP BY 1)
    SELECT file_id, chain, coalesce(p.prot_id, c.part, 'unknown') AS prot_id FROM q LEFT JOIN proteins p ON p.seq = q.sequence LEFT JOIN c ON c.sequence = q.sequence""",
)
def src_9(spark, d):
    """The protein of each chain of the delivered structures, by its sequence."""
    from chainlake.sources.pdb import chain_sequences

    chains = chain_sequences(v.atoms(spark, d), ["file_id"])
    return mmcif.name_sequences(chains.select("file_id", "chain", "sequence"), table(spark, d, "proteins").select("prot_id", "seq")).select("file_id", "chain", "prot_id")


@query("src_10_cif_round_trip", f"WITH {v.ATOMS} SELECT file_id, count(*) AS n_atoms, round(sum(x) + sum(y) + sum(z), 3) AS total FROM atom GROUP BY 1")
def src_10(spark, d):
    """Atoms as mmCIF texts, parsed, written as PDB lines and parsed again."""
    from chainlake.sources.pdb import atom_fields, atom_line

    cif = mmcif.cif_text(v.atoms(spark, d), "file_id")
    lines = mmcif.parse_cif(cif).select(F.col("path").cast("bigint").alias("file_id"), F.struct(*atom_fields(atom_line())).alias("f"))
    return lines.groupBy("file_id").agg(F.count("*").alias("n_atoms"), F.round(F.sum("f.x") + F.sum("f.y") + F.sum("f.z"), 3).alias("total"))


@query("src_12_resolution", "SELECT prot_id, round(len / 1000, 3) AS resolution FROM proteins WHERE len IS NOT NULL")
def src_12(spark, d):
    """A graph resolution for every protein through a JSON object and back."""
    scratch = Scratch(spark, "resolution")
    p = table(spark, d, "proteins").where("len IS NOT NULL").select("prot_id", F.round(F.col("len") / 1000, 3).alias("r"))
    pairs = p.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("prot_id", "r")))).alias("value"))  # one object of one number a protein
    pairs.coalesce(1).write.text(scratch.path("preset"))
    return tf.read_resolution(spark, scratch.path("preset"), p)


_TABLES = ("agg_19_residue_variation", "win_5_fallback_ranges", "srt_2_trajectory_order", "win_1_rolling_bias", "agg_14_pae_stability", "cls_1_edge_dynamics")


@query("snk_2_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM ({catalog._SQL[n]})" for n in _TABLES))
def snk_2(spark, d):
    """Residue statistics, fallback ranges, trajectories, partner bias, stability and edges as TSV tables, read back."""
    scratch = Scratch(spark, "tables")
    out = None
    for n in _TABLES:
        tf.write_tsv(catalog._QUERIES[n](spark, d), scratch.path(n), overwrite=True)
        rows = spark.read.option("sep", "\t").option("header", "true").csv(scratch.path(n)).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snk_4_json_parts", "WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) SELECT format('_part_{:03d}', (pos // 30 + 1)::INT) AS part, count(*) AS n_items FROM s GROUP BY 1")
def snk_4(spark, d):
    """A JSON list of objects in files of thirty."""
    s = table(spark, d, "supplier").select(F.to_json(F.struct("s_suppkey", "s_name")).alias("j"), "s_suppkey")
    text = s.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "j"))), lambda x: x["j"]), ","), F.lit("]")).alias("t"))
    parts = tf.split_json(text, "t", 30)
    return parts.select("part", F.size(F.from_json("json", "array<string>")).cast("bigint").alias("n_items"))
