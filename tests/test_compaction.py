import itertools

import pytest
from pyspark.sql import functions as F

from chainlake.operators import compaction as c

SCHEMA = "file_id bigint, pdb_file string, pred_id bigint, rank int, landed_at timestamp, content string"


def _atoms(n, chain="A"):
    return "".join(f"ATOM  {k:5d}  CA  GLY {chain}{k:4d}    {k:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{50:6.2f}\n" for k in range(1, n + 1))


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2)])
def test_hilbert_visits_neighbours(spark, n, bits):
    points = [list(p) for p in itertools.product(range(1 << bits), repeat=n)]
    rows = spark.createDataFrame([(p,) for p in points], "p array<int>").select("p", c.hilbert_code(F.col("p"), n, bits).alias("c")).orderBy("c").collect()
    assert [r.c for r in rows] == list(range(len(points)))
    assert all(sum(abs(a - b) for a, b in zip(x.p, y.p, strict=True)) == 1 for x, y in itertools.pairwise(rows))


def test_paths(spark):
    cases = {
        " file:///a//b/../c.pdb\t": "/a/c.pdb", "\\a\\.\\c.pdb": "/a/c.pdb", "../x/../y": "../y", "/../z": "/z", "FILE:/q": "/q", "file://localhost/q": "/q", None: None,
        "a/b/../../../c": "../c", "": "", "/": "/", "/a/b/": "/a/b",
    }
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", c.canonical_path(F.col("p")).alias("c")).collect()
    assert {r.p: r.c for r in got} == cases


def test_every_atom_once(spark):
    rows = [
        (1, "/a/x.pdb", 1, 1, None, _atoms(3)),
        (2, "\\a\\.\\x.pdb", 1, 1, None, _atoms(3)),  # delivered again
        (3, "/a/y.pdb", 1, None, None, _atoms(3)),  # equal text, another file
        (4, "/a/none.pdb", 2, 1, None, None),
        (5, "/a/empty.pdb", 2, 2, None, ""),
        (6, "/a/header.pdb", 2, 3, None, "HEADER only\nHETATM    1\n"),
        (7, None, 3, 1, None, _atoms(2)),
        (8, None, 3, 1, None, _atoms(2)),  # no path: files of their own
        (9, "/big.pdb", None, 4, None, "MODEL 1\n" + _atoms(5000, "B") + "TER\r\nEND\n"),
        (11, "/late.pdb", 4, 1, None, None),
        (12, "/x/../late.pdb", 4, 1, None, _atoms(4)),  # the first delivery had no text
    ]
    out = c.compact(spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit("clash")), target_bytes=100_000)
    counts = {r.file_id: r["count"] for r in out.groupBy("file_id").count().collect()}
    assert counts == {1: 3, 3: 3, 7: 2, 8: 2, 9: 5000, 11: 4}
    assert out.distinct().count() == out.count()


def test_one_file_fills_several(spark):
    big = spark.createDataFrame([(1, "/big.pdb", 1, 1, None, _atoms(9000))], SCHEMA)
    out = c.compact(big, target_bytes=120_000)
    sizes = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 2 * min(sizes)


def test_empty_table(spark):
    assert c.compact(spark.createDataFrame([], SCHEMA)).count() == 0
