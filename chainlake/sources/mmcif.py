"""mmCIF files and AF3 result folders or archives."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TOKENS = re.compile(r"'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|\S+")


def cif_atoms(text: str) -> list[dict]:
    """Rows of the _atom_site loop as dictionaries of its items."""
    rows, names, inside = [], [], False
    for line in text.splitlines():
        if line.startswith("loop_"):
            names, inside = [], False
        elif line.startswith("_atom_site."):
            names.append(line.split()[0][len("_atom_site.") :])
            inside = True
        elif inside and names:
            if not line.strip() or line[0] in "#_" or line.startswith("data_"):
                inside = False
                continue
            values = [t[1:-1] if t[0] in "'\"" and t[-1] == t[0] else t for t in _TOKENS.findall(line)]
            if len(values) == len(names):
                rows.append(dict(zip(names, values, strict=True)))
    return rows


_ATOMS = "path string, record string, atom_no int, atom_name string, alt string, res_name string, chain string, res_no int, ins string, x double, y double, z double, occ double, bfactor double"


def parse_cif(files: DataFrame) -> DataFrame:
    """SRC-9/SRC-10: the atoms of mmCIF texts (path, content as text or bytes), in the schema of PDB atoms; texts that aren't mmCIF have none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blank = lambda v: "" if v in (None, ".", "?") else v
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "replace")
                for a in cif_atoms(text):
                    seq = blank(a.get("auth_seq_id")) or blank(a.get("label_seq_id"))
                    out.append((
                        path, a.get("group_PDB"), int(a["id"]), a.get("label_atom_id"), blank(a.get("label_alt_id")), a.get("label_comp_id"), blank(a.get("auth_asym_id")) or a.get("label_asym_id"), int(seq or 0),
                        blank(a.get("pdbx_PDB_ins_code")), float(a["Cartn_x"]), float(a["Cartn_y"]), float(a["Cartn_z"]), float(a.get("occupancy", 1)), float(a.get("B_iso_or_equiv", 0)),
                    ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ATOMS.split(", ")])

    return files.mapInPandas(parse, _ATOMS)


def read_cif_atoms(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-9/SRC-10: parse_cif() over all mmCIF files below a folder."""
    return parse_cif(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cif").load(folder).select("path", "content"))


_ITEMS = ("group_PDB", "id", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv")


def cif_text(atoms: DataFrame, key: str) -> DataFrame:
    """SRC-10: (path, content): the atoms of each key as an mmCIF text, in order of their lines."""
    filled = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", ".").otherwise(F.trim(c))
    number = lambda c, d: F.coalesce(F.format_string(f"%.{d}f", F.col(c)), F.lit("0"))
    quoted = F.when(F.contains("atom_name", F.lit("'")), F.concat(F.lit('"'), "atom_name", F.lit('"'))).otherwise(F.col("atom_name"))
    row = F.concat_ws(" ", F.lit("ATOM"), "atom_no", quoted, filled(F.col("alt")), "res_name", filled(F.col("chain")), "res_no", filled(F.col("ins")), number("x", 3), number("y", 3), number("z", 3), number("occ", 2), number("bfactor", 2))
    rows = atoms.groupBy(F.col(key).cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("line", row.alias("r")))).alias("rows"))
    head = "data_model\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in _ITEMS)
    return rows.select("path", F.concat(F.lit(head), F.array_join(F.transform("rows", lambda x: x["r"]), "\n"), F.lit("\n#\n")).alias("content"))


def name_sequences(chains: DataFrame, proteins: DataFrame, anchor: int = 3) -> DataFrame:
    """SRC-9: the protein of each chain sequence: equal, else one within the other (nearest in length, then by ID), else 'unknown'.

    Containment is only tried for the sequences without an equal one. A sequence can lie in another only if that one holds its
    first `anchor` letters, so candidates come from an equi join on these; shorter sequences are known only by an equal one.
    """
    p = proteins.select("prot_id", F.col("seq").alias("known")).where("known IS NOT NULL")
    exact = chains.join(p, chains["sequence"] == p["known"], "left").drop("known")
    open_ = exact.where(F.col("prot_id").isNull() & (F.length("sequence") >= anchor)).select("sequence").distinct()
    long = p.where(F.length("known") >= anchor)
    runs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (anchor - 1)), lambda i: F.substr(F.col(c), i, F.lit(anchor))))).alias("g")
    inside = open_.select("sequence", F.substring("sequence", 1, anchor).alias("g")).join(long.select("prot_id", "known", runs("known")), "g").where(F.contains("known", "sequence"))
    around = open_.select("sequence", runs("sequence")).join(long.select("prot_id", "known", F.substring("known", 1, anchor).alias("g")), "g").where(F.contains("sequence", "known"))
    part = inside.unionByName(around).groupBy("sequence").agg(F.min_by("prot_id", F.struct(F.abs(F.length("known") - F.length("sequence")), "prot_id")).alias("part_id"))
    return exact.join(part, "sequence", "left").withColumn("prot_id", F.coalesce("prot_id", "part_id", F.lit("unknown"))).drop("part_id")


_RESULTS = "path string, prediction string, model int, ptm double, iptm double, plddt array<double>, pae array<array<double>>"


def read_af3(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-8: AF3 results (zip files below a folder), one row per model, ranked by ipTM: (prediction, model, rank, ptm, iptm, plddt, pae).

    Atom confidences become means per residue by the structure's residue numbers; without a structure they stay per atom. Archives
    that cannot be read have no rows. Ties of ipTM keep the order of model numbers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except zipfile.BadZipFile:
                    continue
                names = archive.namelist()
                for name in names:
                    m = re.search(r"([^/]*)_full_data_(\d+)\.json$", name)
                    if not m:
                        continue
                    full = json.loads(archive.read(name))
                    other = lambda p, k=m[2]: next((n for n in names if re.search(p.format(k), n)), None)
                    summary, model = other(r"_summary_confidences_{}\.json$"), other(r"_model_{}\.cif$")
                    scores = json.loads(archive.read(summary)) if summary else {}
                    plddt = full.get("atom_plddts") or []
                    if model:
                        atoms = cif_atoms(archive.read(model).decode("utf-8", "replace"))
                        if len(atoms) == len(plddt):
                            keys = [(a.get("label_asym_id"), a.get("label_seq_id")) for a in atoms]
                            plddt = pd.Series(plddt).groupby(pd.Index(keys, tupleize_cols=False), sort=False).mean().tolist()
                    out.append((path, m[1], int(m[2]), scores.get("ptm"), scores.get("iptm"), plddt, full.get("pae")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULTS.split(", ")])

    rows = files.mapInPandas(parse, _RESULTS)
    rank = F.row_number().over(Window.partitionBy("path", "prediction").orderBy(F.col("iptm").desc_nulls_last(), "model"))
    return rows.withColumn("rank", rank)
