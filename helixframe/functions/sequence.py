"""Column functions on DNA strings.  All stay inside Spark's expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
UNKNOWN = 4


def as_dna(text: Column) -> Column:
    """The letters A, C, G, T of a text, in upper case; other characters go."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ACGTacgt]", ""))


def symbol(c: Column) -> Column:
    """0 to 3 for A, C, G, T (upper case), 4 for anything else."""
    at = F.instr(F.lit(BASES), c)
    return F.when((at > 0) & (F.length(c) == 1), at - 1).otherwise(UNKNOWN)


def base(s: Column) -> Column:
    """The letter of a symbol number, N beyond 3."""
    return F.substring(F.lit(BASES + "N"), s.cast("int") + 1, F.lit(1))


def symbols(seq: Column) -> Column:
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), symbol)


def bases(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, base), "")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def infix(seq: Column, begin: Column, end: Column) -> Column:
    """Symbols [begin, end), counted from 0."""
    return F.substring(seq, begin + 1, end - begin)


def prefix(seq: Column, n: Column | int) -> Column:
    return F.left(seq, n if isinstance(n, Column) else F.lit(n))


def suffix(seq: Column, begin: Column) -> Column:
    return F.substring(seq, begin + 1, F.greatest(F.length(seq) - begin, F.lit(0)))


def count_of(seq: Column, letter: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))).cast("long")


def strands(seq: Column, which: tuple[str, ...] = ("forward", "reverse", "forward_complement", "reverse_complement")) -> Column:
    """An array of (strand, seq), one entry for each strand asked for."""
    made = {"forward": seq, "reverse": F.reverse(seq), "forward_complement": complement(seq), "reverse_complement": reverse_complement(seq)}
    return F.array(*(F.struct(F.lit(k).alias("strand"), made[k].alias("seq")) for k in which))


def qgram_code(gram: Column, q: int, bits: int = 2) -> Column:
    """The number of a q-gram, first symbol in the lowest bits; a missing or unknown symbol counts as A.

    Fits a long while ``q * bits`` is 62 at most.
    """
    if q * bits > 62:
        raise ValueError("q * bits must be 62 at most")
    out = F.lit(0).cast("long")
    for j in range(q):
        at = F.instr(F.lit(BASES), F.substring(gram, j + 1, 1))
        value = F.when((at > 0) & (F.length(gram) > j), at - 1).otherwise(0).cast("long")
        out = out + value * F.lit(1 << (j * bits))
    return out


def code_gram(code: Column, q: int, bits: int = 2) -> Column:
    """The q-gram of a number."""
    return F.concat(*(base(F.shiftright(code, j * bits).bitwiseAND((1 << bits) - 1)) for j in range(q)))


def snap(diagonal: Column, interval: int) -> Column:
    """The nearest multiple of ``interval``; an exact half rounds down."""
    return (F.ceil(diagonal / float(interval) - 0.5) * interval).cast("long")


# The table that this rule gives must equal the one that Solexa qualities are commonly read by, so
# its offset of ten, its bend below twenty and its last value are not free.
def solexa_step(q: int) -> int:
    """The Phred value of a Solexa quality number of the same table position: the log-odds scale's
    first fifteen steps bend, later ones are offset by ten."""
    return min(245, max(0, q - 10)) if q >= 20 else round(10 * math.log10(1 + 10 ** ((q - 10) / 10)))


def phred(quality: Column, encoding: str = "phred33") -> Column:
    """Phred values of a quality string's characters."""
    codes = F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), F.ascii)
    if encoding == "phred":
        return codes
    if encoding == "phred33":
        return F.transform(codes, lambda q: q - 33)
    if encoding == "phred64":
        return F.transform(codes, lambda q: q - 64)
    if encoding == "solexa":
        table = F.array(*(F.lit(solexa_step(q)) for q in range(256)))
        return F.transform(codes, lambda q: F.element_at(table, q + 1))
    raise ValueError(f"unknown quality encoding {encoding}")


def rounded_cost(q: Column) -> Column:
    """A Phred value's cost in four steps: 0, 10, 20, 30 from 0, 5, 15, 25 on."""
    return F.when(q < 5, 0).when(q < 15, 10).when(q < 25, 20).otherwise(30)


def mismatch_cost(q: Column, least: int, most: int) -> Column:
    """A cost that grows with the quality, up to quality 40."""
    return F.lit(least) + ((F.least(q, F.lit(40)) / 40.0) * (most - least)).cast("int")


def seed_interval(length: Column, k: float = 1.0, m: float = 1.15, kind: str = "sqrt") -> Column:
    """Distance between seeds by read length."""
    f = {"linear": length, "log": F.log(length), "sqrt": F.sqrt(length)}[kind]
    return F.greatest(F.lit(1), (F.lit(k) + F.lit(m) * f).cast("int"))


def gap_room(length: Column, min_score: Column, match: int, gap_open: int, gap_ext: int) -> Column:
    """Gaps that a perfect alignment of ``length`` can afford before its score falls below ``min_score``.

    ``gap_open`` is taken once, ``gap_ext`` for each gap; both are negative or zero.
    """
    best = length * match
    after_open = best + gap_open
    steps = F.floor((after_open - min_score) / float(-gap_ext)) + 1  # steps until the score is below
    steps = F.least(length, F.when(after_open < min_score, 0).otherwise(steps))
    return F.when(best < min_score, 0).otherwise(F.greatest(steps - 1, F.lit(0))).cast("long")


def divide_up(x: Column, y: Column | int) -> Column:
    """The quotient of whole numbers, rounded up."""
    return F.ceil(x / (y if isinstance(y, Column) else F.lit(y))).cast("long")


def round_up(x: Column, y: int) -> Column:
    """The next multiple of ``y``."""
    return divide_up(x, y) * y


def round_down(x: Column, y: int) -> Column:
    return (F.floor(x / y) * y).cast("long")


def log2_whole(x: Column) -> Column:
    """The whole part of the binary logarithm of a positive whole number."""
    return (F.length(F.bin(x)) - 1).cast("long")


# Multiplier and increment of the 32-bit linear congruential generator.
LCG = (1664525, 1013904223)


def lcg_next(x: Column) -> Column:
    """The number after ``x`` in a 32-bit linear congruential sequence; halves keep the product within 64 bits."""
    a, c = LCG
    return ((x * a).bitwiseAND(0xFFFFFFFF) + c).bitwiseAND(0xFFFFFFFF)


def popcount(x: Column) -> Column:
    return F.bit_count(x).cast("long")


def band_of(max_dist: Column) -> Column:
    """``band_length`` as a column."""
    return (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(max_dist * 2 + 1)).cast("int")) - 1).cast("long")


def band_length(max_dist: int) -> int:
    """The power of two, less one, that covers ``2 * max_dist + 1``."""
    n = 1
    while n - 1 < 2 * max_dist + 1:
        n *= 2
    return n - 1
