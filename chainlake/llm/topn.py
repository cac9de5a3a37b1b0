"""Problem 4: the N best items of every group, reading only the row groups that can hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlake.functions.ids import pair_high, pair_low, protein_id
from chainlake.storage import Scratch

_STATS = "file string, row_group int, n_rows bigint, one_group boolean, {groups}, least double, most double"


def open_uri(uri: str):
    """File system and path of a URI as Hadoop writes it; s3a and s3n are S3."""
    import pyarrow.fs as pfs

    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri[len(scheme) :]
    return pfs.FileSystem.from_uri(uri)


def write_clustered(rows: DataFrame, groups: list[str], score: str, ties: list[str], scratch: Scratch, name: str, block_bytes: int = 1 << 20) -> list[str]:
    """Writes rows clustered by group, best scores first, and returns the files.

    The range partitioning includes the score, so a group that holds a third of all rows lies in many
    files, each with its own stretch of scores. Bounds come from a sample; they only move file ends.
    """
    order = [*(F.col(g) for g in groups), F.col(score).desc(), *(F.col(t).asc_nulls_last() for t in ties)]
    laid = rows.repartitionByRange(*(F.col(g) for g in groups), F.col(score).desc()).sortWithinPartitions(*order)
    laid.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(block_bytes)).parquet(scratch.path(name))
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.path(name))
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [s.getPath().toString() for s in listed if s.getPath().getName().endswith(".parquet")]


def row_group_statistics(files: list[str], groups: list[str], score: str, rows: DataFrame) -> DataFrame:
    """One row per row group, from the files' footers: rows, whether it holds one group only (and which), least and most score."""
    spark = rows.sparkSession
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for uri in batch["file"]:
                fs, path = open_uri(uri)
                meta = pq.read_metadata(path, filesystem=fs)
                at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
                for k in range(meta.num_row_groups):
                    group = meta.row_group(k)
                    stats = {c: group.column(at[c]).statistics for c in [*groups, score]}
                    known = all(s is not None and s.has_min_max for s in stats.values())
                    one = known and all(stats[g].min == stats[g].max and not stats[g].null_count for g in groups)
                    out.append((uri, k, group.num_rows, one, *((stats[g].min if one else None) for g in groups), stats[score].min if known else None, stats[score].max if known else None))
            yield pd.DataFrame(out, columns=["file", "row_group", "n_rows", "one_group", *groups, "least", "most"])

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 1000)))
    return listed.mapInPandas(footers, _STATS.format(groups=", ".join(f"{g} {types[g]}" for g in groups)))


def top_n(rows: DataFrame, groups: list[str], score: str, ties: list[str], n: int, scratch: Scratch | None = None, block_bytes: int = 1 << 20) -> DataFrame:
    """The first n rows of every group by score descending, then ties ascending (nulls last).

    Rows are written once, clustered by group. A row group of one group is skipped when its best score is
    strictly below that group's current n-th score: first by statistics alone (another row group of at
    least n rows, all of them better), then within a file, whose row groups are read best first. A row group
    of several groups never lies below every one's n-th score: rows are in order of group and score, so it holds the best rows of each
    group that begins in it, and is read. Of each file at most n rows of a group go on to the final ranking.

    Groups with fewer rows come whole. Rows with a null group, and with a null or NaN score, have no rank
    and are left out. Repeated rows are ranked one by one. Only the named columns are returned, so others may clash.
    """
    scratch = scratch or Scratch(rows.sparkSession, "topn")
    columns = [*groups, score, *ties]
    rows = rows.select(*groups, F.col(score).cast("double").alias(score), *ties)
    rows = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).dropna(subset=groups)
    files = write_clustered(rows, groups, score, ties, scratch, "clustered", block_bytes)
    stats = row_group_statistics(files, groups, score, rows)
    single = Window.partitionBy("one_group", *groups)
    enough = F.max(F.when(F.col("one_group") & (F.col("n_rows") >= n), F.col("least"))).over(single)
    wanted = stats.withColumn("floor", F.when(F.col("one_group"), enough)).where("floor IS NULL OR most IS NULL OR most >= floor")
    schema = rows.select(*columns).schema

    def read(key: tuple, plan: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.parquet as pq

        fs, path = open_uri(key[0])
        best: list[pd.DataFrame] = []
        current: dict[tuple, list[float]] = {}
        with fs.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            for g in plan.sort_values("most", ascending=False, na_position="first").itertuples():
                if g.one_group:
                    seen = current.get(tuple(getattr(g, c) for c in groups), [])
                    if len(seen) >= n and g.most < seen[n - 1]:
                        continue
                part = file.read_row_group(int(g.row_group), columns=columns).to_pandas()
                part = part.groupby(groups, sort=False).head(n)  # sorted when written
                best.append(part)
                for k, scores in part.groupby(groups, sort=False)[score]:
                    current[k] = sorted(current.get(k, []) + scores.tolist(), reverse=True)[:n]
        found = pd.concat(best)
        found = found.sort_values([*groups, score, *ties], ascending=[True] * len(groups) + [False] + [True] * len(ties), na_position="last")
        return found.groupby(groups, sort=False).head(n)[columns]

    candidates = wanted.groupBy("file").applyInPandas(read, schema)
    order = [F.col(score).desc(), *(F.col(t).asc_nulls_last() for t in ties)]
    return candidates.withColumn("position", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("position") <= n)


def best_models(pairwise: DataFrame, n: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """The n best models of every unordered pair, by iptm descending, rank and row_id ascending.

    Rows without two IDs or a score do not count; of those with the same prediction and rank only the
    smallest row_id does.
    """
    scratch = scratch or Scratch(pairwise.sparkSession, "best")
    p, q = protein_id("protein1"), protein_id("protein2")
    rows = pairwise.where("iptm IS NOT NULL AND NOT isnan(iptm)").select(pair_low(p, q).alias("protein_a"), pair_high(p, q).alias("protein_b"), "row_id", "pred_id", "rank", "iptm")
    rows = rows.where("protein_a IS NOT NULL")
    once = rows.groupBy("pred_id", "rank").agg(F.min(F.struct("row_id", "protein_a", "protein_b", "iptm")).alias("x")).select("rank", "x.*")
    return top_n(once, ["protein_a", "protein_b"], "iptm", ["rank", "row_id"], n, scratch)
