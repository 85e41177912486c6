"""Comparison of two sets of alignments of the same reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("ed", "mapq", "mms", "ins", "dels", "score")


def zip_sides(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The reads of both sides, columns as ``l_*`` and ``r_*``."""
    side = lambda df, t: df.select(*on, *(F.col(c).alias(f"{t}_{c}") for c in df.columns if c not in on))
    return side(left, "l").join(side(right, "r"), on)


def is_mapped(t: str) -> Column:
    return (F.col(f"{t}_pos") != 0) & (F.col(f"{t}_flag").bitwiseAND(4) == 0)


def is_reverse(t: str) -> Column:
    return F.col(f"{t}_flag").bitwiseAND(16) != 0


def is_unique(t: str) -> Column:
    return is_mapped(t) & F.col(f"{t}_sec_score").isNull()


def is_ambiguous(t: str) -> Column:
    return is_mapped(t) & (F.coalesce(F.col(f"{t}_sec_score") == F.col(f"{t}_score"), F.lit(False)))


def is_distant() -> Column:
    """Places further apart than the read is long."""
    return F.abs(F.col("l_pos") - F.col("r_pos")) > F.col("l_read_len")


def is_discordant() -> Column:
    return is_reverse("l") != is_reverse("r")


def is_elsewhere() -> Column:
    return F.col("l_ref_id") != F.col("r_ref_id")


# ---------------------------------------------------------------- derived sums, and pairs


def mapped_read_bases(t: str) -> Column:
    """Symbols of the read that the alignment uses."""
    return F.col(f"{t}_subs") + F.col(f"{t}_ins")


def mapped_ref_bases(t: str) -> Column:
    """Symbols of the reference that the alignment spans."""
    return F.col(f"{t}_subs") + F.col(f"{t}_dels")


def trimmed(t: str) -> Column:
    """Symbols of the read that the alignment leaves out."""
    return F.col(f"{t}_read_len") - mapped_read_bases(t)


#: Columns of a pair that are sums of its mates'.
SUMS = ("read_len", "score", "sec_score", "ed", "subs", "ins", "dels", "mms", "gapo", "gape")


def pair_columns(both: DataFrame, t: str) -> DataFrame:
    """Adds what a pair of side ``t`` has, from its mates' columns ``<t>1_*`` and ``<t>2_*``: the sums, the first
    mate's quality, and the tests ``mapped, paired, unpaired, unique, ambiguous``.

    A pair is mapped if both mates are, and paired if both also have the flag of a proper pair; a paired one
    is unique if both mates are, and ambiguous if both have a second alignment and the sums of the best and
    the second scores are equal.
    """
    a, b = f"{t}1", f"{t}2"
    proper = lambda m: F.col(f"{m}_flag").bitwiseAND(2) != 0
    second = F.col(f"{a}_sec_score").isNotNull() & F.col(f"{b}_sec_score").isNotNull()
    mapped, both_proper = is_mapped(a) & is_mapped(b), proper(a) & proper(b)
    sums = {f"{t}_{c}": F.col(f"{a}_{c}") + F.col(f"{b}_{c}") for c in SUMS if f"{a}_{c}" in both.columns}
    equal = F.coalesce(F.col(f"{a}_score") + F.col(f"{b}_score") == F.col(f"{a}_sec_score") + F.col(f"{b}_sec_score"), F.lit(False))
    tests = {"mapped": mapped, "paired": mapped & both_proper, "unpaired": mapped & ~both_proper, "unique": mapped & both_proper & is_unique(a) & is_unique(b), "ambiguous": mapped & both_proper & second & equal}
    return both.withColumns(sums | {f"{t}_mapq": F.col(f"{a}_mapq")} | {f"{t}_is_{k}": v for k, v in tests.items()})


def single_columns(both: DataFrame, t: str) -> DataFrame:
    """Adds the tests of a single read's side: ``mapped, unique, ambiguous``."""
    return both.withColumns({f"{t}_is_mapped": is_mapped(t), f"{t}_is_unique": is_unique(t), f"{t}_is_ambiguous": is_ambiguous(t)})


def log_bin(x: Column) -> Column:
    """0 for 0 and less, else 1 + floor(log2(x))."""
    return F.when(x <= 0, 0).otherwise(F.length(F.conv(x.cast("long").cast("string"), 10, 2))).cast("long")


def linear_bin(x: Column, width: int, bins: int) -> Column:
    return F.least(F.greatest(F.floor(x / width), F.lit(0)), F.lit(bins - 1)).cast("long")


def contingency(both: DataFrame, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``test, l, r, both, l_only, r_only`` for pairs of tests of the left and the right side; one pass."""
    entry = lambda k, a, b: F.struct(F.lit(k).alias("test"), a.alias("a"), b.alias("b"))
    rows = both.select(F.explode(F.array(*(entry(k, a, b) for k, (a, b) in tests.items()))).alias("x")).select("x.*")
    c = lambda t: F.sum(F.when(t, 1).otherwise(0))
    a, b = F.col("a"), F.col("b")
    return rows.groupBy("test").agg(c(a).alias("l"), c(b).alias("r"), c(a & b).alias("both"), c(a & ~b).alias("l_only"), c(b & ~a).alias("r_only"))


def histogram(rows: DataFrame, *bins: Column) -> DataFrame:
    """Counts by one or more bin columns."""
    return rows.groupBy(*bins).agg(F.count("*").alias("n"))


def summary(both: DataFrame, stat: str) -> DataFrame:
    """Differences of a statistic by the better side and log bin, with totals (grouping sets)."""
    d = F.col(f"l_{stat}") - F.col(f"r_{stat}")
    rows = both.select(F.when(d > 0, "l").when(d < 0, "r").otherwise("equal").alias("side"), log_bin(F.abs(d)).alias("bin"))
    return rows.rollup("side", "bin").agg(F.count("*").alias("n"))


def discordant_reads(both: DataFrame, key: str, kinds: tuple[str, ...], stats: tuple[str, ...], delta: int) -> DataFrame:
    """Reads that are distant, discordant or on another reference, and whose statistics differ by ``delta``
    (at least, or at most if it is negative or zero)."""
    tests = {"distant": is_distant(), "discordant": is_discordant(), "elsewhere": is_elsewhere()}
    kind = F.lit(False)
    for k in kinds:
        kind = kind | tests[k]
    moved = F.lit(False)
    for s in stats:
        d = F.col(f"l_{s}") - F.col(f"r_{s}")
        moved = moved | (d >= delta if delta > 0 else d <= delta)
    return both.where(kind & moved).select(key)


# ---------------------------------------------------------------- whole reports


def _moved(l: str, r: str) -> tuple[Column, Column]:
    """Whether two alignments lie on different references, and whether they are distant (which the former are too)."""
    elsewhere = F.col(f"{l}_ref_id") != F.col(f"{r}_ref_id")
    apart = F.abs(F.col(f"{l}_pos") - F.col(f"{r}_pos")) > F.col(f"{l}_read_len")
    return elsewhere, elsewhere | apart


def analyse(both: DataFrame, paired: bool = False) -> DataFrame:
    """``section, item, side, bin, n``: the whole comparison of two sets of alignments of single reads (columns
    ``l_*, r_*``) or of pairs (``l1_*, l2_*, r1_*, r2_*``), in one pass over the reads.

    Reads whose lengths differ between the sides are counted as mismatched and left out.  ``tests`` counts
    reads by the tests of each side (``l``, ``r``, ``both``); ``only`` has those of one side alone by the log
    bin of their quality.  Of reads that are mapped (paired) on both sides, ``moved`` counts those on
    another reference, distant and discordant by the right side's quality, and ``all``, ``distant`` and
    ``discordant`` count, for each statistic, which side has the larger value and by how much (log bin).
    """
    tests = ("mapped", "paired", "unique", "ambiguous") if paired else ("mapped", "unique", "ambiguous")
    shape = pair_columns if paired else single_columns
    rows = shape(shape(both, "l"), "r")
    mates = (("l1", "r1"), ("l2", "r2")) if paired else (("l", "r"),)
    fits = F.lit(True)
    elsewhere = distant = discordant = F.lit(False)
    for l, r in mates:
        fits = fits & (F.col(f"{l}_read_len") == F.col(f"{r}_read_len"))
        e, d = _moved(l, r)
        elsewhere, distant, discordant = elsewhere | e, distant | d, discordant | (is_reverse(l) != is_reverse(r))
    usable = F.col("l_is_paired") & F.col("r_is_paired") if paired else F.col("l_is_mapped") & F.col("r_is_mapped")
    none, zero = F.lit("-"), F.lit(0).cast("long")

    def mark(when: Column, section: str, item: str, side: Column, bin_: Column) -> Column:
        return F.when(when, F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), side.alias("side"), bin_.cast("long").alias("bin")))

    marks = [mark(~fits, "mismatched", "reads", none, zero)]
    for t in tests:
        l, r = F.col(f"l_is_{t}"), F.col(f"r_is_{t}")
        marks += [mark(fits & l, "tests", t, F.lit("l"), zero), mark(fits & r, "tests", t, F.lit("r"), zero), mark(fits & l & r, "tests", t, F.lit("both"), zero)]
        marks += [mark(fits & l & ~r, "only", t, F.lit("l"), log_bin(F.col("l_mapq"))), mark(fits & r & ~l, "only", t, F.lit("r"), log_bin(F.col("r_mapq")))]
    for item, test in (("elsewhere", elsewhere), ("distant", distant), ("discordant", discordant)):
        marks.append(mark(fits & usable & test, "moved", item, none, log_bin(F.col("r_mapq"))))
    value = {"ed": lambda t: F.col(f"{t}_ed"), "mapq": lambda t: F.col(f"{t}_mapq"), "length": mapped_read_bases, "trimmed": trimmed}
    value |= {c: (lambda t, c=c: F.col(f"{t}_{c}")) for c in ("subs", "mms", "ins", "dels")}
    value["pos"] = lambda t: F.col(f"{t}1_pos" if paired else f"{t}_pos")
    for section, test in (("all", F.lit(True)), ("distant", distant), ("discordant", discordant)):
        for item, of in value.items():
            gap = of("l") - of("r")
            side = F.when(gap > 0, "l").when(gap < 0, "r").otherwise("equal")
            marks.append(mark(fits & usable & test, section, item, side, log_bin(F.abs(gap))))
    each = rows.select(F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("x"))
    return each.groupBy("x.section", "x.item", "x.side", "x.bin").agg(F.count("*").alias("n"))
