"""FASTA, score JSON, TSV tables and other text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_fasta(spark: SparkSession, path: str, use_names: bool = False) -> DataFrame:
    """SRC-1: (prot_id, prot_name, seq, len). Headers are >ID|Name; sequence lines are joined; use_names swaps ID and name.

    Records are split by the reader at the line breaks before '>', so no file is read as a whole. A header without both
    fields has a null name, and such records are kept for the caller to reject.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.col("value"), r"^>|\r", "")
    parts = raw.select(F.split(record, "\n", 2).alias("p")).where(F.length(F.trim(F.col("p")[0])) > 0)
    head = F.split(F.col("p")[0], "\\|")
    seq = F.regexp_replace(F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")), r"\s+", "")
    out = parts.select(F.trim(head[0]).alias("prot_id"), F.trim(F.try_element_at(head, F.lit(2))).alias("prot_name"), F.upper(seq).alias("seq"))
    if use_names:
        out = out.select(F.col("prot_name").alias("prot_id"), F.col("prot_id").alias("prot_name"), "seq")
    return out.withColumn("len", F.length("seq"))


def write_fasta(proteins: DataFrame, path: str) -> None:
    """SNK-3: FASTA records; null names become empty."""
    proteins.select(F.concat(F.lit(">"), "prot_id", F.lit("|"), F.coalesce("prot_name", F.lit("")), F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


SCORES = T.StructType(
    [
        T.StructField("plddt", T.ArrayType(T.DoubleType())),
        T.StructField("pae", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("ptm", T.DoubleType()),
        T.StructField("iptm", T.DoubleType()),
        T.StructField("max_pae", T.DoubleType()),
    ]
)


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-6: (prediction, rank, plddt, pae, ptm, iptm) of the score files below a folder, by an explicit schema."""
    rows = spark.read.schema(SCORES).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*rank_*.json").json(folder)
    path = F.col("_metadata.file_path")
    named = rows.select(F.element_at(F.split(path, "/"), -2).alias("prediction"), F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"_rank_(\d{3})_", 1).try_cast("int").alias("rank"), *SCORES.names)
    return named.where("rank IS NOT NULL")


def match_structures(scores: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-7: the structure of each (prediction, rank): a relaxed one before an unrelaxed one, then by path.

    files: (prediction, name_rank, relaxation, path).
    """
    order = Window.partitionBy("prediction", "name_rank").orderBy(F.when(F.col("relaxation") == "relaxed", 0).otherwise(1), "path")
    first = files.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("prediction", F.col("name_rank").alias("rank"), "path")
    return scores.join(first, ["prediction", "rank"], "left")


def matching_ratio(a: str, b: str) -> float:
    """SRC-7: Ratcliff-Obershelp ratio of two names, for exact parity where names have to be compared."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def most_similar(name: str, names: list[str]) -> str | None:
    """SRC-7: the first of the most similar names."""
    return max(names, key=lambda x: matching_ratio(name, x), default=None)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: manual domains: Protein_ID, Domain, Start, End."""
    return spark.read.option("sep", "\t").option("header", "true").schema("Protein_ID string, Domain int, Start int, End int").csv(path)


def expand_domains(domains: DataFrame) -> DataFrame:
    """SRC-11: one row per residue of each domain; a domain that ends before it starts has none."""
    return domains.where("Start <= End").select("Protein_ID", "Domain", F.explode(F.sequence("Start", "End")).alias("residue"))


def domain_spans(domains: DataFrame, least_plddt: float = 40.0) -> DataFrame:
    """SRC-17: domains to draw, with the chain's length (largest end of all domains, before the confident ones are picked)."""
    length = domains.groupBy("Protein_ID").agg(F.max("End").alias("backbone"))
    return domains.where(F.col("Mean_pLDDT") >= least_plddt).join(length, "Protein_ID")


def read_resolution(spark: SparkSession, path: str, proteins: DataFrame) -> DataFrame:
    """SRC-12: (prot_id, resolution) from a JSON object; raises if a protein has none."""
    text = spark.read.option("wholetext", "true").text(path)
    preset = text.select(F.explode(F.from_json("value", "map<string,double>")).alias("prot_id", "resolution"))
    missing = [r[0] for r in proteins.select("prot_id").join(preset, "prot_id", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"no resolution for {', '.join(missing)}")
    return preset


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: a classification rule table in the columns of the default one; empty fields are null."""
    from chainlake.operators.graph import _RULE_SCHEMA

    return spark.read.option("sep", "\t").option("header", "true").schema(_RULE_SCHEMA).csv(path)


def read_cutoffs(spark: SparkSession, path: str, use_case: int) -> list[tuple[float, int]]:
    """SRC-13: the (PAE cutoff, ranks) pairs of a use case, most ranks first."""
    rows = spark.read.option("sep", "\t").option("header", "true").schema("use_case int, `5` double, `4` double, `3` double, `2` double, `1` double").csv(path)
    row = rows.where(F.col("use_case") == use_case).first()
    return [(row[str(n)], n) for n in (5, 4, 3, 2, 1) if row and row[str(n)] is not None]


def annotated(domains: DataFrame, hits: DataFrame) -> DataFrame:
    """SRC-14/JN-9: domains with the annotations of a fetched table that overlap them; 'No InterPro data' where none does.

    hits: (Protein_ID, name, hit_start, hit_end). full is true where the annotation lies within the domain.
    """
    on = (domains["Protein_ID"] == hits["Protein_ID"]) & (hits["hit_end"] >= domains["Start"]) & (hits["hit_start"] <= domains["End"])
    x = domains.join(hits, on, "left")
    full = (F.col("hit_start") >= F.col("Start")) & (F.col("hit_end") <= F.col("End"))
    return x.select(domains["Protein_ID"], "Domain", "Start", "End", F.coalesce("name", F.lit("No InterPro data")).alias("InterPro"), F.coalesce(full, F.lit(False)).alias("full"))


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder in whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def write_tsv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """SNK-1/SNK-2: a table as TSV; arrays become |-joined text. Fails if the path exists, unless overwrite."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite" if overwrite else "errorifexists").option("sep", "\t").option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)  # blanks are part of a value


def job_json(combos: DataFrame, proteins: DataFrame, seed: int = 1) -> DataFrame:
    """SNK-3: one job description per combination (combo): proteins with their counts, as JSON text."""
    each = combos.select("combo", F.explode("combo").alias("prot_id")).groupBy("combo", "prot_id").agg(F.count("*").alias("count"))
    known = each.join(proteins.select("prot_id", "seq"), "prot_id")
    one = F.struct("prot_id", F.struct(F.col("seq").alias("sequence"), "count").alias("proteinChain"))
    jobs = known.groupBy("combo").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["proteinChain"].alias("proteinChain"))).alias("sequences"))
    name = F.array_join("combo", "__vs__")
    body = F.to_json(F.struct(name.alias("name"), F.array(F.lit(str(seed))).alias("modelSeeds"), "sequences", F.lit("alphafoldserver").alias("dialect"), F.lit(1).alias("version")))
    return jobs.select("combo", name.alias("name"), body.alias("job"))


def job_fasta(combos: DataFrame, proteins: DataFrame) -> DataFrame:
    """SNK-3: combinations as FASTA records whose chains are joined by colons."""
    spread = combos.select("combo", F.posexplode("combo").alias("ix", "prot_id")).join(proteins.select("prot_id", "seq"), "prot_id")
    chains = spread.groupBy("combo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "seq"))), lambda x: x["seq"]), ":").alias("seq"))
    return chains.select(F.concat(F.lit(">"), F.array_join("combo", "__vs__"), F.lit("\n"), "seq").alias("value"))


def split_json(text: DataFrame, column: str, chunk: int = 30) -> DataFrame:
    """SNK-4: the elements of JSON lists in chunks: (part, json), parts numbered from 001."""
    items = text.select(F.posexplode(F.from_json(column, "array<string>")).alias("pos", "item"))
    rows = items.groupBy(F.floor(F.col("pos") / chunk).alias("p")).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("i"))
    return rows.select(F.format_string("_part_%03d", F.col("p") + 1).alias("part"), F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: x["item"]), ","), F.lit("]")).alias("json"))


def residue_json(rows: DataFrame, key: str, residue: str, value: str) -> DataFrame:
    """SNK-6: per key a JSON object of residue to value."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(residue, value))), lambda x: F.struct(x[residue].cast("string"), x[value]))
    return rows.groupBy(key).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def _ends(suffix: str):
    return lambda x: x.endswith(suffix)


def check_predictions(expected: DataFrame, files: DataFrame, required: tuple[str, ...] = ("model_0.cif", "job_request.json")) -> DataFrame:
    """SRC-15: (name, state): found, incomplete, missing or unexpected; names agree without case, underscores and hyphens.

    expected: (name); files: (folder, file).
    """
    key = lambda c: F.regexp_replace(F.lower(c), r"[_\-]", "")
    have = files.groupBy(key(F.col("folder")).alias("key")).agg(F.min("folder").alias("folder"), F.collect_set("file").alias("f"))
    whole = F.lit(True)
    for suffix in required:
        whole = whole & F.exists("f", _ends(suffix))
    both = expected.select(key(F.col("name")).alias("key"), "name").dropDuplicates(["key"]).join(have.withColumn("whole", whole), "key", "full_outer")
    state = F.when(F.col("folder").isNull(), "missing").when(F.col("name").isNull(), "unexpected").when(F.col("whole"), "found").otherwise("incomplete")
    return both.select(F.coalesce("name", "folder").alias("name"), state.alias("state"))


def report_index(paths: DataFrame, column: str = "path") -> DataFrame:
    """REP-1: the kind and subject of each report file, by its name."""
    base = F.element_at(F.split(column, "/"), -1)
    kinds: tuple[tuple[str, str], ...] = (
        ("contact clusters", r"^(.+?)__vs__(.+?)-contact_clusters\.html$"), ("plddt clusters", r"^(.+?)-plddt_clusters\.html$"), ("trajectory", r"^(.+?)-(?:domain|monomer)_traj.*\.(?:html|pdb)$"),
        ("domains", r"^(.+?)-domains.*\.(?:html|svg|tsv)$"), ("fallback", r"^(.+?)-fallback.*\.png$"), ("suggestions", r"^suggested_(.+)\.(?:json|fasta|csv|txt)$"), ("stability", r"^(.+?)-stability.*\.png$"),
    )
    kind: Column = F.lit(None).cast("string")
    subject: Column = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        kind = F.when(base.rlike(pattern), name).otherwise(kind)
        subject = F.when(base.rlike(pattern), F.regexp_extract(base, pattern, 1)).otherwise(subject)
    return paths.select(F.col(column), kind.alias("kind"), subject.alias("subject"))
