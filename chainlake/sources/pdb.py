"""PDB text: the fixed-width atom schema, chain sequences, splitting and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions.metrics import one_letter

_LINES = "\\r?\\n|\\r"

#: Name, first column, width and type of each field of an ATOM line.
ATOM_FIELDS = (
    ("record", 1, 6, "string"), ("atom_no", 7, 5, "int"), ("atom_name", 13, 4, "string"), ("alt", 17, 1, "string"), ("res_name", 18, 3, "string"), ("chain", 22, 1, "raw"), ("res_no", 23, 4, "int"),
    ("ins", 27, 1, "string"), ("x", 31, 8, "double"), ("y", 39, 8, "double"), ("z", 47, 8, "double"), ("occ", 55, 6, "double"), ("bfactor", 61, 6, "double"),
)


def atom_fields(line: Column) -> list[Column]:
    """SRC-4: the fields of an ATOM line; a field that isn't a number of its type is null."""
    out = []
    for name, start, width, kind in ATOM_FIELDS:
        part = F.substring(line, start, width)
        out.append((part if kind == "raw" else F.trim(part) if kind == "string" else F.trim(part).try_cast(kind)).alias(name))
    return out


def parse_atoms(texts: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row per ATOM line of every text, with its line number. Null and empty texts have none."""
    lines = texts.where(F.col(column).isNotNull()).select(*keys, F.posexplode(F.split(column, _LINES)).alias("line", "text"))
    return lines.where(F.col("text").startswith("ATOM ")).select(*keys, "line", *atom_fields(F.col("text")))


def first_model(texts: DataFrame, column: str) -> DataFrame:
    """Texts cut after their first model."""
    return texts.withColumn(column, F.element_at(F.split(column, r"(?m)^ENDMDL"), 1))


def chain_sequences(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-3: (keys, chain, sequence, length): residues in order of number, one letter each, amino acids only."""
    residues = atoms.select(*keys, "chain", "res_no", "ins", one_letter(F.col("res_name")).alias("aa")).where("aa IS NOT NULL AND res_no IS NOT NULL").distinct()
    one = residues.groupBy(*keys, "chain", "res_no", "ins").agg(F.min("aa").alias("aa"))
    ordered = F.array_sort(F.collect_list(F.struct("res_no", "ins", "aa")))  # a chain has a bounded number of residues
    sequence = F.array_join(F.transform(ordered, lambda r: r["aa"]), "")
    return one.groupBy(*keys, "chain").agg(sequence.alias("sequence")).withColumn("length", F.length("sequence"))


def side_chain_points(atoms: DataFrame) -> DataFrame:
    """SRC-5: CB atoms, and CA of glycine."""
    return atoms.where((F.col("atom_name") == "CB") | ((F.col("atom_name") == "CA") & (F.col("res_name") == "GLY")))


def split_models(texts: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """SRC-16: one row per model of a trajectory text: (keys, model, title, body). A text without ENDMDL is one model."""
    parts = texts.select(*keys, F.posexplode(F.split(column, r"(?m)^ENDMDL[^\n]*\n?")).alias("model", "body")).where(F.col("body").rlike(r"(?m)^(ATOM|HETATM)"))
    title = F.trim(F.regexp_extract("body", r"(?m)^TITLE\s+([^\n\r]*)", 1))
    return parts.select(*keys, "model", F.when(title != "", title).alias("title"), "body")


def atom_line() -> Column:
    """SNK-5: the ATOM line of a row in the atom schema."""
    name = F.when(F.length("atom_name") >= 4, F.col("atom_name")).otherwise(F.rpad(F.concat(F.lit(" "), F.col("atom_name")), 4, " "))
    return F.format_string(
        "ATOM  %5d %s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
        "atom_no", name, F.rpad(F.coalesce("alt", F.lit("")), 1, " "), "res_name", "chain", "res_no", F.rpad(F.coalesce("ins", F.lit("")), 1, " "),
        F.col("x"), F.col("y"), F.col("z"), F.coalesce("occ", F.lit(1.0)), F.coalesce("bfactor", F.lit(0.0)), F.substring("atom_name", 1, 1),
    )


def write_pdb(atoms: DataFrame, path: str, keys: list[str]) -> None:
    """SNK-5: atom rows as PDB text, one folder per key; lines in order of keys, chain and number."""
    lines = atoms.withColumn("value", atom_line()).repartition(*keys).sortWithinPartitions(*keys, "chain", "res_no", "atom_no")
    lines.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def prediction_name(path: Column) -> list[Column]:
    """SRC-2: parts of a prediction's file name: combination, relaxed or not, rank, model, seed."""
    base = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    pattern = r"^(.*)_(unrelaxed|relaxed)_rank_(\d{3})_(.*)_model_(\d+)_seed_(\d+)\.pdb\s*$"

    def part(k: int) -> Column:
        return F.when(base.rlike(pattern), F.regexp_extract(base, pattern, k))

    return [part(1).alias("combination"), part(2).alias("relaxation"), part(3).cast("int").alias("name_rank"), part(5).cast("int").alias("model"), part(6).cast("bigint").alias("seed")]


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-2: the PDB files below a folder, with the folder that names the prediction. Folders without one don't appear."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdb").load(folder).select("path")
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("prediction"), *prediction_name(F.col("path")))
