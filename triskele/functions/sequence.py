"""Column functions on nucleotide strings. All are built-in expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Images of A, T, G, C, N under each pairing rule, in forward and reverse reading.
PARALLEL_FORWARD = ["TGGTN", "TGCTN", "TGTTN", "TGGCN", "TGCCN", "TGTCN"]
PARALLEL_REVERSE = ["GTTGN", "GTTCN", "GTTTN", "GTCGN", "GTCCN", "GTCTN"]
ANTIPARALLEL_FORWARD = ["GTTGN", "GTTCN", "GTTAN", "GTCGN", "GTCCN", "GTCAN", "GATGN", "GATCN", "GATAN", "GACGN", "GACCN", "GACAN", "GCTGN", "GCTCN", "GCTAN", "GCCGN", "GCCCN", "GCCAN"]
ANTIPARALLEL_REVERSE = ["TGGTN", "TGCTN", "TGATN", "TGGCN", "TGCCN", "TGACN", "AGGTN", "AGCTN", "AGATN", "AGGCN", "AGCCN", "AGACN", "CGGTN", "CGCTN", "CGATN", "CGGCN", "CGCCN", "CGACN"]


def only_bases(seq: Column, bases: str = "ACGT") -> Column:
    """Upper-cased, without anything but ``bases``."""
    return F.regexp_replace(F.upper(seq), f"[^{bases}]+", "")


def complement(seq: Column) -> Column:
    """Complement; characters other than A, C, G, T and N are dropped."""
    return F.translate(F.regexp_replace(seq, "[^ACGTN]", ""), "ACGT", "TGCA")


def source_transform(seq: Column, kind: str) -> Column:
    """``original``, ``complement``, ``reverse`` or ``reverse_complement``."""
    return {
        "original": lambda: seq, "complement": lambda: complement(seq), "reverse": lambda: F.reverse(seq), "reverse_complement": lambda: F.reverse(complement(seq)),
    }[kind]()


def reverse_complement_rna(seq: Column) -> Column:
    """Reverse complement for scoring: U pairs as T, anything unknown becomes N, case is ignored."""
    known = F.regexp_replace(F.translate(seq, "acgtu", "ACGTU"), "[^ACGTU]", "N")
    return F.reverse(F.translate(known, "ACGTU", "TGCAA"))


def apply_map(seq: Column, image: Column | str) -> Column:
    """Substitute A, T, G, C by the letters of ``image`` (order A, T, G, C, N); others become N."""
    known = F.regexp_replace(seq, "[^ATGC]", "N")
    image = F.lit(image) if isinstance(image, str) else image
    return F.call_function("translate", known, F.lit("ATGCN"), image)


def is_homopolymer(seq: Column) -> Column:
    """All of one of A, C, G, T, U, N, whatever the case (also the empty string)."""
    return seq.rlike("(?i)^(A*|C*|G*|T*|U*|N*)$")


def base_code(base: Column) -> Column:
    """A, C, G, T to 0, 1, 2, 3 ignoring case; 4 for anything else."""
    at = F.instr(F.lit("ACGT"), F.upper(base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4)


def strand_label(reverse: Column, parallel: Column) -> Column:
    return (
        F.when((reverse == 0) & (parallel == 1), "ParaPlus").when((reverse == 1) & (parallel == 1), "ParaMinus")
        .when((reverse == 1) & (parallel == -1), "AntiMinus").when((reverse == 0) & (parallel == -1), "AntiPlus")
    )


def strip_gaps(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def clean_name(name: Column) -> Column:
    """Base name without folders and a FASTA suffix, with anything unusual as underscore."""
    base = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"\.(fa|fasta)$", "")
    return F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_")


# Numbers of the nucleotide letters, ambiguous ones included.
IUPAC = {"A": 1, "B": 15, "C": 2, "D": 12, "G": 3, "H": 13, "K": 11, "M": 8, "N": 16, "P": 6, "Q": 7, "R": 6, "S": 10, "T": 4, "U": 5, "V": 14, "W": 9, "X": 17, "Y": 7}


def iupac_code(base: Column) -> Column:
    """Number of a nucleotide letter, whatever its case; 0 for anything else."""
    table = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, v)])
    return F.coalesce(table[F.upper(base)], F.lit(0))


def profile_index(base: Column) -> Column:
    """Row of a query profile: A, C, G, T, U by number, everything else as N."""
    code = iupac_code(base)
    return F.when(code.between(1, 5), code).otherwise(16)
