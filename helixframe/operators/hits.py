"""Seed hits and their alignments: selection, best and second best, mapping quality, mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def select_hits(ranges: DataFrame, key: str, max_hits: int, size: str = "n", place: str = "begin") -> DataFrame:
    """At most ``max_hits`` hit ranges of each read, the rarest first, then the earliest seed."""
    order = W.partitionBy(key).orderBy(F.col(size), F.col(place))
    return ranges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_hits)


def select_random(ranges: DataFrame, key: str, k: int, weight: Column, draw: Column) -> DataFrame:
    """``k`` ranges of each read drawn by weight; ``draw`` is a column in (0, 1]."""
    order = W.partitionBy(key).orderBy(-F.log(draw) / weight)
    return ranges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def needs_reseed(ranges: DataFrame, reads: DataFrame, key: str, size: str = "n", rep_seeds: int = 1000) -> DataFrame:
    """Reads without a range, or whose ranges hold ``rep_seeds`` hits or more on average."""
    per = ranges.groupBy(key).agg(F.avg(size).alias("__a"))
    return reads.join(per, key, "left").where(F.col("__a").isNull() | (F.col("__a") >= rep_seeds)).drop("__a")


def prune(active: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return active.join(done, key, "left_anti")


def distinct_from(a_pos: Column, a_strand: Column, b_pos: Column, b_strand: Column, dist: Column) -> Column:
    """Whether two alignments are not the same one: another strand, or further apart than ``dist``."""
    return (a_strand != b_strand) | (F.abs(a_pos - b_pos) > dist)


def best_two(scored: DataFrame, key: str, dist: Column | int, score: str = "score", pos: str = "pos", strand: str = "strand", demote: bool = True) -> DataFrame:
    """``key``, the best and the second best alignment of each read.

    The best is the highest score, then the smallest place and strand.  The second is the best of those
    distinct from it (another strand, or more than ``dist`` away); without ``demote`` an alignment that
    the best replaced may not become second, which only equal scores show.
    """
    far = dist if isinstance(dist, Column) else F.lit(dist)
    rows = scored.select(F.col(key), F.col(score).alias("score"), F.col(pos).alias("pos"), F.col(strand).alias("strand"), far.alias("__dist"))
    top = rows.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("n"), "pos", "strand")).alias("b"))
    top = top.select(key, (-F.col("b.n")).alias("best_score"), F.col("b.pos").alias("best_pos"), F.col("b.strand").alias("best_strand"))
    rest = rows.join(top, key).where(distinct_from(F.col("best_pos"), F.col("best_strand"), F.col("pos"), F.col("strand"), F.col("__dist")))
    if not demote:
        rest = rest.where(F.col("score") < F.col("best_score"))
    second = rest.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("n"), "pos", "strand")).alias("s"))
    return top.join(second, key, "left").select(key, "best_score", "best_pos", "best_strand", (-F.col("s.n")).alias("second_score"), F.col("s.pos").alias("second_pos"), F.col("s.strand").alias("second_strand"))


# Mapping quality by how far the best score lies above the least one (part of the range),
# for a read with one alignment, end to end and local.
ONE_END_TO_END = ((0.8, 42), (0.7, 40), (0.6, 24), (0.5, 23), (0.4, 8), (0.3, 3), (None, 0))
ONE_LOCAL = ((0.8, 44), (0.7, 42), (0.6, 41), (0.5, 36), (0.4, 28), (0.3, 24), (None, 22))
# With a second alignment, by the difference of the two scores (part of the range); each
# entry has the quality of a perfect best score, then qualities by the best score's place, falling.
TWO_END_TO_END = (
    (0.9, 39, ((None, 33),)),
    (0.8, 38, ((None, 27),)),
    (0.7, 37, ((None, 26),)),
    (0.6, 36, ((None, 22),)),
    (0.5, 35, ((0.84, 25), (0.68, 16), (None, 5))),
    (0.4, 34, ((0.84, 21), (0.68, 14), (None, 4))),
    (0.3, 32, ((0.88, 18), (0.67, 15), (None, 3))),
    (0.2, 31, ((0.88, 17), (0.67, 11), (None, 0))),
    (0.1, 30, ((0.88, 12), (0.67, 7), (None, 0))),
    (0.0, None, ((0.67, 6), (None, 2))),
    (None, None, ((0.67, 1), (None, 0))),
)
TWO_LOCAL = (
    (0.9, None, ((None, 40),)),
    (0.8, None, ((None, 39),)),
    (0.7, None, ((None, 38),)),
    (0.6, None, ((None, 37),)),
    (0.5, 35, ((0.5, 25), (None, 20))),
    (0.4, 34, ((0.5, 21), (None, 19))),
    (0.3, 33, ((0.5, 18), (None, 16))),
    (0.2, 32, ((0.5, 17), (None, 12))),
    (0.1, 31, ((0.5, 14), (None, 9))),
    (0.0, None, ((0.5, 11), (None, 2))),
    (None, None, ((0.5, 1), (None, 0))),
)


def mapq_sql(best: str, second: str, least: str, perfect: str, local: bool = False) -> str:
    """The mapping quality as a SQL expression (Spark and DuckDB) of four numbers; ``second`` may be null."""
    span, over = f"({perfect} - {least})", f"({best} - {least})"
    diff = f"abs(abs({best}) - abs({second}))"

    def steps(table) -> str:
        return "CASE " + " ".join(f"WHEN {over} >= {span} * {t} THEN {v}" if t is not None else f"ELSE {v}" for t, v in table) + " END"

    two = ""
    for t, full, table in TWO_LOCAL if local else TWO_END_TO_END:
        inner = steps(table) if len(table) > 1 else str(table[0][1])
        if full is not None:
            inner = f"CASE WHEN {over} = {span} THEN {full} ELSE {inner} END"
        test = f"WHEN {diff} >= {span} * {t} THEN" if t else f"WHEN {diff} > 0 THEN" if t == 0.0 else "ELSE"
        two += f" {test} {inner}"
    one = steps(ONE_LOCAL if local else ONE_END_TO_END)
    return f"CASE WHEN {best} < {least} THEN 0 WHEN {second} IS NULL THEN {one} ELSE (CASE{two} END) END"


def mapq(best: str, second: str, least: str, perfect: str, local: bool = False) -> Column:
    return F.expr(mapq_sql(best, second, least, perfect, local))


def filter_mapq(alignments: DataFrame, threshold: int, mapq_col: str = "mapq") -> DataFrame:
    """Adds ``mapped``: alignments below the threshold count as unmapped and get quality 0."""
    low = F.col(mapq_col) < threshold
    return alignments.withColumn("mapped", ~low).withColumn(mapq_col, F.when(low, 0).otherwise(F.col(mapq_col)))


def opposite_mate(policy: str, anchor_first: Column, anchor_forward: Column) -> tuple[Column, Column]:
    """Where the other mate is expected: (to the left, on the forward strand), by pair policy."""
    if policy == "FF":
        return anchor_first != anchor_forward, anchor_forward
    if policy == "RR":
        return anchor_first == anchor_forward, anchor_forward
    if policy == "FR":
        return ~anchor_forward, ~anchor_forward
    if policy == "RF":
        return anchor_forward, ~anchor_forward
    raise ValueError(f"unknown policy {policy}")


def mate_window(pos: Column, length: Column, left: Column, min_fragment: int, max_fragment: int) -> tuple[Column, Column]:
    """The half-open window of the other mate's places, by the bounds of the fragment's length."""
    begin = F.when(left, F.greatest(pos + length - max_fragment, F.lit(0))).otherwise(pos)
    end = F.when(left, pos + length).otherwise(pos + max_fragment)
    return begin, F.greatest(end, begin)


def pair_up(anchors: DataFrame, mates: DataFrame, key: str, max_fragment: int, policy: str = "FR") -> DataFrame:
    """Pairs of anchor and opposite hits inside the window: an interval join on the read, the reference
    and cells of ``max_fragment``.  Columns ``a_*`` and ``o_*`` (pos, strand, score, length, ref_id)."""
    left, forward = opposite_mate(policy, F.lit(True), F.col("a_strand") == "+")
    names = ("ref_id", "pos", "strand", "score", "length")
    a = anchors.select(key, *(F.col(c).alias(f"a_{c}") for c in names))
    begin, end = mate_window(F.col("a_pos"), F.col("a_length"), left, 0, max_fragment)
    a = a.withColumn("__b", begin).withColumn("__e", end).withColumn("__fw", forward)
    a = a.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__b") / max_fragment), F.floor(F.col("__e") / max_fragment))))
    o = mates.select(F.col(key).alias("__k"), *(F.col(c).alias(f"o_{c}") for c in names)).withColumn("__c", F.floor(F.col("o_pos") / max_fragment))
    near = (F.col(key) == F.col("__k")) & (F.col("a_ref_id") == F.col("o_ref_id")) & (F.col("__cell") == F.col("__c"))
    both = a.join(o, near).where((F.col("o_pos") >= F.col("__b")) & (F.col("o_pos") + F.col("o_length") <= F.col("__e")) & ((F.col("o_strand") == "+") == F.col("__fw")))
    return both.drop("__b", "__e", "__fw", "__cell", "__k", "__c").withColumn("score", F.col("a_score") + F.col("o_score"))


def to_reference(hits: DataFrame, references: DataFrame, pos: str = "pos", length: str = "length") -> DataFrame:
    """``ref_id`` and 1-based ``ref_pos`` of places in the concatenated references; ``bridges`` marks those
    that reach over a reference's end.

    References and hits are put into one order and each hit takes the last reference that begins before
    it, inside ranges of the order; there is no join of all with all.
    """
    from .primitives import last_marks

    marks = references.select(F.col("offset").cast("long").alias("__x"), F.struct("ref_id", "offset", F.col("length").alias("len")).alias("__ref"))
    asked = hits.select(F.col(pos).cast("long").alias("__x"), F.struct(*hits.columns).alias("__hit"))
    out = last_marks(marks, asked, "__x", "__ref").withColumnRenamed("__mark", "__at")
    return out.select("__hit.*", F.col("__at.ref_id").alias("ref_id"), (F.col("__x") - F.col("__at.offset") + 1).alias("ref_pos"), (F.col(f"__hit.{length}") + F.col("__x") > F.col("__at.offset") + F.col("__at.len")).alias("bridges"))


# ---------------------------------------------------------------- SAM fields

FLAGS = {"paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "read_1": 64, "read_2": 128, "secondary": 256, "failed": 512, "duplicate": 1024}


def sam_flags(**bits: Column) -> Column:
    """The flag number of boolean columns named as in ``FLAGS``."""
    out = F.lit(0)
    for name, test in bits.items():
        out = out.bitwiseOR(F.when(test, FLAGS[name]).otherwise(0))
    return out


def template_length(a_pos: Column, a_end: Column, b_pos: Column, b_end: Column, same_ref: Column) -> Column:
    """The signed length of a pair's template as seen from mate a; 0 across references."""
    size = F.greatest(a_end, b_end) - F.least(a_pos, b_pos)
    return F.when(~same_ref, 0).when(b_pos < a_pos, -size).otherwise(size)


def sam_line(*fields: Column) -> Column:
    return F.concat_ws("\t", *(f.cast("string") for f in fields))
