"""Scores, intervals and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: pDockQ thresholds, highest first, and the PPV of each.
PPV_STEPS = (
    (0.67333079, 0.98128027),
    (0.65666073, 0.96322524),
    (0.63254566, 0.95333044),
    (0.62604391, 0.9400192),
    (0.60150931, 0.93172991),
    (0.58313803, 0.92420274),
    (0.5647381, 0.91629946),
    (0.54122438, 0.90952562),
    (0.52314392, 0.90043139),
    (0.49659878, 0.8919553),
    (0.4774676, 0.88570037),
    (0.44661346, 0.87822061),
    (0.42628389, 0.87116417),
    (0.39990988, 0.86040801),
    (0.38479715, 0.85453785),
    (0.3649393, 0.84294946),
    (0.34526004, 0.83367787),
    (0.3262589, 0.82238224),
    (0.31475668, 0.81190228),
    (0.29750023, 0.80223507),
    (0.26673725, 0.78549007),
    (0.24561247, 0.77766077),
    (0.21882689, 0.75941223),
    (0.19651314, 0.74006263),
    (0.17606258, 0.73044282),
    (0.15398168, 0.71391784),
    (0.13927677, 0.70615739),
    (0.12024131, 0.68635536),
    (0.09996019, 0.66728511),
    (0.06968505, 0.63555449),
    (0.02946438, 0.55890174),
)

#: Three-letter to one-letter codes of the amino acids.
AMINO_ACIDS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def one_letter(residue: Column) -> Column:
    """PRJ: three-letter residue name to its letter; null for anything else."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in AMINO_ACIDS.items() for x in pair)), residue)


def chain_index(chain: Column) -> Column:
    """PRJ-2: position of a chain letter, A = 0, over the whole alphabet."""
    return F.ascii(F.upper(chain)) - F.lit(65)


def pdockq(mean_plddt: Column, n_contacts: Column) -> Column:
    """PRJ-6: logistic in mean interface pLDDT times log10 of the contacts; 0 without contacts."""
    x = mean_plddt * F.log10(n_contacts.cast("double"))
    return F.when(n_contacts > 0, F.lit(0.724) / (1 + F.exp(F.lit(-0.052) * (x - F.lit(152.611)))) + F.lit(0.018)).otherwise(F.lit(0.0))


def ppv(score: Column) -> Column:
    """PRJ-7: PPV of the lowest threshold that is still at least the score, else that of the highest."""
    steps = F.when(score.isNull(), F.lit(None).cast("double"))
    for threshold, value in reversed(PPV_STEPS):
        steps = steps.when(F.lit(threshold) >= score, F.lit(value))
    return steps.otherwise(F.lit(PPV_STEPS[0][1]))


def sigmoid(x: Column, low: float, high: float, middle: float, slope: float) -> Column:
    """PRJ-8: logistic rescale between low and high."""
    return F.lit(low) + F.lit(high - low) / (1 + F.exp(F.lit(-slope) * (x - F.lit(middle))))


def edge_weight(min_pae: Column, n_models: Column, least: float = 0.5) -> Column:
    """PRJ-8: edge weight that falls with the PAE and rises with the models, not below `least`; `least` where unknown."""
    weight = (F.lit(1.0) - min_pae / 30.0) * F.least(n_models / 5.0, F.lit(1.0)) * 5.0
    return F.coalesce(F.greatest(F.round(weight, 4), F.lit(least)), F.lit(least))


def parse_interval(text: Column) -> Column:
    """PRJ-9: struct (low, high, low_in, high_in) of an interval such as [0.5;1.0); null if it isn't one."""
    pattern = r"^\s*([\[(])\s*(-?[0-9.]+|-?inf)\s*;\s*(-?[0-9.]+|-?inf)\s*([\])])\s*$"

    def part(k: int) -> Column:
        return F.regexp_extract(text, pattern, k)

    def number(k: int) -> Column:
        return F.when(part(k).endswith("inf"), F.when(part(k).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(part(k).try_cast("double"))

    return F.when(text.rlike(pattern), F.struct(number(2).alias("low"), number(3).alias("high"), (part(1) == "[").alias("low_in"), (part(4) == "]").alias("high_in")))


def in_interval(x: Column, interval: Column) -> Column:
    """PRJ-9: whether x lies in a parsed interval."""
    above = (x > interval["low"]) | (interval["low_in"] & (x == interval["low"]))
    below = (x < interval["high"]) | (interval["high_in"] & (x == interval["high"]))
    return above & below


def combination_label(proteins: Column) -> Column:
    """PRJ-10: '2 x (A), B' in the order of first appearance."""
    def one(p: Column) -> Column:
        n = F.size(F.filter(proteins, lambda q: q == p))
        return F.when(n > 1, F.concat(n.cast("string"), F.lit(" x ("), p, F.lit(")"))).otherwise(p)

    return F.array_join(F.transform(F.array_distinct(proteins), one), ", ")


def copies(proteins: Column, protein: Column) -> Column:
    """PRJ-13: how often a protein stands in a combination."""
    return F.size(F.filter(proteins, lambda q: q == protein))


def extra_proteins(proteins: Column, a: Column, b: Column) -> Column:
    """PRJ-12: the other members, then 'X as k-mer' for a pair member of more than one (two, if a = b) copies."""
    others = F.filter(proteins, lambda q: (q != a) & (q != b))

    def again(p: Column, least: int) -> Column:
        n = copies(proteins, p)
        return F.when(n > least, F.array(F.concat(p, F.lit(" as "), n.cast("string"), F.lit("-mer")))).otherwise(F.array().cast("array<string>"))

    return F.concat(others, F.when(a == b, again(a, 2)).otherwise(F.concat(again(a, 1), again(b, 1))))


def state_label(n: Column, stable: Column, tested: Column) -> Column:
    """PRJ-11: one homo-oligomer state: the number if stable, with f if it fell back, with ? if untested."""
    return F.when(~tested, F.concat(n.cast("string"), F.lit("?"))).when(stable, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit("f")))


def plddt_band(plddt: Column) -> Column:
    """PRJ-17: confidence band of a pLDDT."""
    return F.when(plddt.isNull(), F.lit(None)).when(plddt > 90, "very high").when(plddt > 70, "high").when(plddt > 50, "low").otherwise("very low")


def blend(low: tuple[int, int, int], high: tuple[int, int, int], share: Column) -> Column:
    """PRJ-17: hex colour between two colours, share clipped to 0..1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.concat(F.lit("#"), *(F.lpad(F.hex(F.round(F.lit(float(a)) + s * F.lit(float(b - a))).cast("bigint")), 2, "0") for a, b in zip(low, high, strict=True)))


def distance3(a: list[Column], b: list[Column]) -> Column:
    """PRJ-19: Euclidean distance of two points."""
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))


def segments_end(start: Column, following: Column, length: Column) -> Column:
    """PRJ-18: a segment ends before the next one begins, the last one at the end."""
    return F.coalesce(following - 1, length)


def is_protein_sequence(seq: Column) -> Column:
    """PRJ-18: only letters of amino acids, at least one."""
    return F.coalesce(F.upper(seq).rlike("^[ACDEFGHIKLMNPQRSTVWYBXZUOJ]+$"), F.lit(False))
