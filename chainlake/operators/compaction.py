"""Problem 5: far too many small files, consolidated along a Hilbert curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.operators.series import running_total
from chainlake.storage import Scratch


def canonical_path(path: Column) -> Column:
    """One writing per location: surrounding whitespace, a file: scheme and the kind and number of separators dropped, relative steps resolved.

    A leading separator stays (an absolute path), steps above the root of an absolute path are dropped,
    those of a relative path stay. Null for null.
    """
    plain = F.regexp_replace(path, r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$", "")
    plain = F.regexp_replace(F.translate(plain, "\\", "/"), r"^(?i:file):(//(?i:localhost)?(?=/))?", "")
    absolute = plain.startswith("/")
    steps = F.filter(F.split(plain, "/+"), lambda s: (s != "") & (s != "."))
    nothing = F.array().cast("array<string>")
    up = F.lit("..")

    def step(done: Column, s: Column) -> Column:
        n = F.size(done)
        pops = (n > 0) & (F.coalesce(F.element_at(done, F.when(n > 0, n)), up) != up)
        return F.when(s != up, F.concat(done, F.array(s))).when(pops, F.slice(done, F.lit(1), n - 1)).when(absolute, done).otherwise(F.concat(done, F.array(s)))

    # most paths have no relative step: only the others pay for the fold
    folded = F.when(F.array_contains(steps, ".."), F.aggregate(steps, nothing, step)).otherwise(steps)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def hilbert_code(coordinates: Column, n: int, bits: int) -> Column:
    """Position on the Hilbert curve of an array of n integer coordinates below 2^bits, as a bigint.

    The published transposed-coordinates method: undo excess rotations from the highest bit down, Gray
    code, then interleave. The folds run in the JVM, with one small lambda a step.
    """
    if n * bits > 62:
        raise ValueError("the code does not fit a bigint")
    point = F.transform(coordinates, lambda v: v.cast("bigint"))
    steps = F.array(*(F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def turn(x: Column, s: Column) -> Column:
        head, here, low = F.element_at(x, 1), F.element_at(x, s["i"] + 1), s["q"] - 1
        inverted = here.bitwiseAND(s["q"]) != 0
        swap = head.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when(k == 0, F.when(inverted, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(swap))).when((k == s["i"]) & ~inverted, v.bitwiseXOR(swap)).otherwise(v),
        )

    turned = F.aggregate(steps, point, turn)
    empty = F.array().cast("array<bigint>")
    gray = F.aggregate(turned, empty, lambda done, v: F.concat(done, F.array(v.bitwiseXOR(F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(F.lit(0))))))
    # bit by bit from the top: once the last coordinate has a bit, the lower bits of all are inverted
    state = F.struct(gray.alias("x"), F.lit(0).cast("bigint").alias("t"))
    masks = F.array(*(F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)))
    flipped = F.aggregate(
        masks,
        state,
        lambda a, q: F.struct(a["x"].alias("x"), F.when(F.element_at(a["x"], -1).bitwiseAND(q) != 0, a["t"].bitwiseXOR(q - 1)).otherwise(a["t"]).alias("t")),
        lambda a: F.transform(a["x"], lambda v: v.bitwiseXOR(a["t"])),
    )
    order = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    both = F.struct(flipped.alias("x"), F.lit(0).cast("bigint").alias("code"))
    bit = lambda a, s: F.call_function("shiftright", F.element_at(a["x"], s["i"] + 1), s["b"]).bitwiseAND(F.lit(1))
    return F.aggregate(order, both, lambda a, s: F.struct(a["x"].alias("x"), (a["code"] * 2 + bit(a, s)).alias("code")), lambda a: a["code"])


def _scaled(value: Column, least: float | None, most: float | None, bits: int) -> Column:
    """Coordinate below 2^bits; nulls are 0."""
    if least is None or most is None or most <= least:
        return F.lit(0).cast("bigint")
    share = (value.cast("double") - F.lit(float(least))) / F.lit(float(most - least))
    return F.coalesce(F.floor(share * F.lit((1 << bits) - 1)), F.lit(0)).cast("bigint")


_MARKS = ("n_atoms", "n_bytes", "low", "high", "xor")
ROW_BYTES = 16  #: what a record weighs besides its text


def _source_marks(content: Column) -> Column:
    """Number, bytes and digest (sums of both halves and exclusive or of the hashes of line number and text) of the ATOM lines of one text."""
    hashed = F.filter(
        F.transform(F.split(content, "\r?\n|\r"), lambda x, i: F.when(x.startswith("ATOM "), F.struct(F.xxhash64(i, x).alias("h"), (F.octet_length(x) + ROW_BYTES).cast("bigint").alias("w")))),
        lambda x: x.isNotNull(),
    )
    zero = F.lit(0).cast("bigint")
    start = F.struct(*(zero.alias(n) for n in _MARKS))

    def add(a: Column, x: Column) -> Column:
        h = x["h"]
        return F.struct((a["n_atoms"] + 1).alias("n_atoms"), (a["n_bytes"] + x["w"]).alias("n_bytes"), (a["low"] + h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), (a["high"] + F.shiftright(h, 32)).alias("high"), a["xor"].bitwiseXOR(h).alias("xor"))

    return F.aggregate(hashed, start, add)


def distinct_files(deliveries: DataFrame) -> DataFrame:
    """One row per file: smallest file_id of its deliveries, and the text of the first delivery that has one, with its marks.

    Deliveries are of one file when their canonical paths agree; a delivery without a path is a file of its own. The marks
    (number, bytes and digest of the ATOM lines) are taken from the source rows, before anything is moved.
    """
    path = canonical_path(F.col("pdb_file"))
    location = F.when(F.coalesce(path, F.lit("")).isin("", "/"), F.concat(F.lit("?"), F.col("file_id").cast("string"))).otherwise(path)
    kept = F.when(F.col("content").isNotNull(), F.struct("file_id", "pred_id", "rank", "landed_at", "content", _source_marks(F.col("content")).alias("marks")))
    one = deliveries.where("file_id IS NOT NULL").select(location.alias("path"), "file_id", kept.alias("kept"))
    grouped = one.groupBy("path").agg(F.min("file_id").alias("file_id"), F.min_by("kept", F.col("kept.file_id")).alias("kept"))
    return grouped.select("path", "file_id", "kept.pred_id", "kept.rank", "kept.landed_at", "kept.content", *(F.coalesce(F.col(f"kept.marks.{n}"), F.lit(0).cast("bigint")).alias(n) for n in _MARKS))


def atom_records(files: DataFrame) -> DataFrame:
    """One row per ATOM line of each file, with its line number, the file's code, and the record's place: the file's start and its share of the file's bytes by line number."""
    lines = files.where("content IS NOT NULL").select("file_id", "code", "start", "n_bytes", F.split("content", "\r?\n|\r").alias("lines"))
    lines = lines.select("file_id", "code", "start", "n_bytes", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line", "record"))
    lines = lines.select("file_id", "code", "line", "record", (F.col("start") + F.col("n_bytes") * F.col("line") / F.col("n_lines")).alias("place"))
    return lines.where(F.col("record").startswith("ATOM "))


def file_marks(records: DataFrame) -> DataFrame:
    """The marks of each file of a written table: (file_id, n_atoms, n_bytes, low, high, xor)."""
    h = F.xxhash64("line", "record")
    return records.groupBy("file_id").agg(
        F.count("*").alias("n_atoms"), F.sum(F.octet_length("record") + ROW_BYTES).alias("n_bytes"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright(h, 32)).alias("high"), F.bit_xor(h).alias("xor")
    )


def compact(deliveries: DataFrame, target_bytes: int = 128 << 20, scratch: Scratch | None = None) -> DataFrame:
    """Consolidates tiny PDB files: every ATOM line of every file exactly once, in few files of about target_bytes.

    Files get a Hilbert code of prediction, rank and time of arrival, with as many bits an axis as make some 64 cells an output
    file (at most 7, two million cells), so the exact histogram of bytes by code has a bounded size. Within a cell files follow each other by number; the
    running total of bytes gives every file its place, and a file that is longer than what is left of an output file goes on in
    the next, so a cell, or a single file, that holds a third of all bytes fills several output files. Texts are cut twice:
    where they are read, for the marks, and where the records are written. Every file's number, bytes and
    digest, taken from the source, must be those of the written table, else an error is raised.

    Returns the written table (file_id, code, line, record). Repeated deliveries, other writings of a path
    and null texts add nothing; an empty input gives an empty table.
    """
    spark = deliveries.sparkSession
    scratch = scratch or Scratch(spark, "compaction")
    files = scratch.save(distinct_files(deliveries), "files")
    axes = [F.col("pred_id"), F.col("rank"), F.unix_micros(F.col("landed_at").cast("timestamp"))]
    r = files.agg(F.sum("n_bytes"), *(f(c.cast("double")) for c in axes for f in (F.min, F.max))).first()
    total = r[0] or 0
    parts = max(1, math.ceil(total / target_bytes))
    bits = min(7, max(1, math.ceil(math.log2(64 * parts) / 3)))
    coordinates = F.array(*(_scaled(c, r[1 + 2 * k], r[2 + 2 * k], bits) for k, c in enumerate(axes)))
    coded = scratch.save(files.where("n_atoms > 0").select("file_id", "n_atoms", "n_bytes", hilbert_code(coordinates, 3, bits).alias("code")), "codes")
    histogram = {row["code"]: row["bytes"] for row in coded.groupBy("code").agg(F.sum("n_bytes").alias("bytes")).collect()}  # at most 2^(3 * bits) rows
    starts, at = [], 0
    for code in sorted(histogram):
        starts.append((code, at))
        at += histogram[code]
    places = spark.createDataFrame(starts, "code bigint, cell bigint")
    # where each file starts in its cell: running totals by blocks of numbered files, so a hot cell does not meet in one task
    upto = running_total(coded, ["code"], ["file_id"], ["n_bytes"], scratch)
    placed = upto.join(F.broadcast(places), "code").select("file_id", "code", (F.col("cell") + F.col("upto_n_bytes") - F.col("n_bytes")).alias("start"), "n_bytes", "n_atoms")
    records = atom_records(files.select("file_id", "content").join(placed, "file_id"))
    spot = F.least(F.floor(F.col("place") / F.lit(max(1.0, total / parts))), F.lit(parts - 1)).cast("int")
    out = records.select("file_id", "code", "line", "record", spot.alias("part"))
    out = scratch.save(out.repartitionById(parts, F.col("part")).sortWithinPartitions("code", "file_id", "line").drop("part"), "compacted")
    same = F.col("s.n_atoms") == F.col("d.n_atoms")
    for n in _MARKS[1:]:
        same = same & (F.col(f"s.{n}") == F.col(f"d.{n}"))
    pairs = files.where("n_atoms > 0").select("file_id", *_MARKS).alias("s").join(file_marks(out).alias("d"), F.col("s.file_id") == F.col("d.file_id"), "full_outer")
    wrong = pairs.where(~F.coalesce(same, F.lit(False))).count()
    if wrong:
        raise RuntimeError(f"{wrong} files differ from their source")
    return out
