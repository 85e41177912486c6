"""Dataflow primitives on ordered rows: scans, runs, sortedness, compaction, filters, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut

#: Rows of an order in one range, about: a global scan has as many ranges as its table's size asks for.
ROWS_PER_RANGE = 1 << 20


def with_ranges(df: DataFrame, order: list[str], rows_per_range: int | None = None) -> DataFrame:
    """The rows with ``__range``: rows that come earlier in the order have smaller range numbers.

    The input is written once, and its number of rows gives the number of ranges.  Rows are placed by Spark's
    range partitioner, which samples all order columns, so that rows that share the first are divided by the
    others; placed rows are written, as their range is the partition they came to.  A table of one range stays as it is.
    """
    rows = cut(df)
    ranges = -(-rows.count() // (rows_per_range or ROWS_PER_RANGE))
    if ranges <= 1:
        return rows.withColumn("__range", F.lit(0))
    return cut(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))


def _scanned(ranged: DataFrame, order: list[str], value: Column, name: str, exclusive: bool = False) -> DataFrame:
    """The running sum over ranged rows, which keep their range."""
    ranged = ranged.withColumn("__value", value)
    sums = ranged.groupBy("__range").agg(F.sum("__value").alias("__s"))
    # one row per range
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inner = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    out = ranged.join(F.broadcast(before), "__range")
    return out.withColumn(name, F.col("__before") + F.coalesce(F.sum("__value").over(inner), F.lit(0))).drop("__value", "__before")


def scan(df: DataFrame, order: list[str], value: Column, name: str, exclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` over the whole table in the order of ``order`` (a total order).

    Two levels: sums per range of the order, and a window inside each range.  No task holds more than about
    ``ROWS_PER_RANGE`` rows.
    """
    return _scanned(with_ranges(df, order), order, value, name, exclusive).drop("__range")


def segmented_scans(df: DataFrame, segment: list[str], order: list[str], values: dict[str, Column], exclusive: bool = False) -> DataFrame:
    """Running sums within each segment, one column for each of ``values``.

    Segments are parts of one order that is divided into ranges, so a segment of any length is scanned by as
    many tasks as it asks for.  Only the first segment of a range can have begun before it; what it brings
    along is one row per range.
    """
    held = df.withColumns({f"__v_{n}": v for n, v in values.items()})
    ranged = with_ranges(held, [*segment, *order])
    inner = W.partitionBy("__range", *segment).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    out = ranged.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0)) for n in values})
    sums = ranged.groupBy("__range", *segment).agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values))
    earlier = W.partitionBy(*segment).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumns({f"__s_{n}": F.sum(f"__s_{n}").over(earlier) for n in values})
    brought = sums.where(F.coalesce(*(F.col(f"__s_{n}") for n in values)).isNotNull())
    brought = brought.select(F.col("__range").alias("__r"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(segment)), *(f"__s_{n}" for n in values))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(segment):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = out.join(F.broadcast(brought), same, "left").withColumns({n: F.col(n) + F.coalesce(f"__s_{n}", F.lit(0)) for n in values})
    return out.drop("__range", "__r", *(f"__k{i}" for i in range(len(segment))), *(f"__v_{n}" for n in values), *(f"__s_{n}" for n in values))


def segmented_scan(df: DataFrame, segment: list[str], order: list[str], value: Column, name: str, exclusive: bool = False) -> DataFrame:
    """``segmented_scans`` of one value."""
    return segmented_scans(df, segment, order, {name: value}, exclusive)


def _preceded(ranged: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``prev_<column>`` and ``is_first`` of ranged rows, which keep their range."""
    w = W.partitionBy("__range").orderBy(*order)
    took = F.struct(F.lit(1).alias("there"), *columns)
    lasts = ranged.groupBy("__range").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__l"))
    edges = lasts.withColumn("__edge", F.lag("__l").over(W.orderBy("__range"))).drop("__l")  # one row per range
    out = ranged.withColumn("__p", F.lag(took).over(w)).join(F.broadcast(edges), "__range")
    inside = F.col("__p").isNotNull()
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.when(inside, F.col(f"__p.{c}")).otherwise(F.col(f"__edge.{c}")))
    return out.withColumn("is_first", ~inside & F.col("__edge").isNull()).drop("__p", "__edge")


def previous(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``prev_<column>`` of the row before in the whole table's order, and ``is_first``."""
    return _preceded(with_ranges(df, order), order, columns).drop("__range")


def last_marks(marks: DataFrame, asked: DataFrame, x: str, mark: str) -> DataFrame:
    """The rows of ``asked`` with ``__mark``: the ``mark`` of the last row of ``marks`` whose ``x`` is not larger.

    Both are put into one order, each asked row carries the last mark before it forward, inside ranges and
    then over their edges; there is no join of all with all.
    """
    both = marks.select(x, F.lit(0).alias("__kind"), F.col(mark).alias("__m"), F.lit(None).cast(asked.drop(x).schema.simpleString()).alias("__asked"))
    both = both.unionByName(asked.select(x, F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema[mark].dataType).alias("__m"), F.struct(*asked.drop(x).columns).alias("__asked")))
    ranged = with_ranges(both, [x, "__kind"])
    inner = W.partitionBy("__range").orderBy(x, "__kind").rowsBetween(W.unboundedPreceding, 0)
    lasts = ranged.groupBy("__range").agg(F.max_by("__m", F.when(F.col("__kind") == 0, F.col(x))).alias("__l"))
    edges = lasts.withColumn("__edge", F.last("__l", ignorenulls=True).over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))).drop("__l")  # one row per range
    out = ranged.withColumn("__in", F.last("__m", ignorenulls=True).over(inner)).join(F.broadcast(edges), "__range").where("__kind = 1")
    return out.select(x, "__asked.*", F.coalesce("__in", "__edge").alias("__mark"))


def runs(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """The rows with ``run``, the number from 1 of the run of equal consecutive keys they are in."""
    seen = _preceded(with_ranges(df, order), order, [key])
    changed = F.when(F.col("is_first") | ~F.col(key).eqNullSafe(F.col(f"prev_{key}")), 1).otherwise(0)
    return _scanned(seen, order, changed, "run").drop("__range", f"prev_{key}", "is_first")


def runlength_encode(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """``run, key, n``: the runs of equal consecutive keys and their lengths."""
    return runs(df, order, key).groupBy("run").agg(F.any_value(key).alias(key), F.count("*").alias("n"))


def reduce_by_key(df: DataFrame, order: list[str], key: str, *aggregates: Column) -> DataFrame:
    """Aggregates of consecutive equal keys; on sorted input one row per key."""
    return runs(df, order, key).groupBy("run").agg(F.any_value(key).alias(key), *aggregates)


def is_sorted(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """One row, ``sorted``: whether the values never fall in the rows' order."""
    seen = previous(df, order, [value])
    return seen.agg(F.coalesce(F.bool_and(F.col("is_first") | (F.col(f"prev_{value}") <= F.col(value))), F.lit(True)).alias("sorted"))


def is_segment_sorted(df: DataFrame, segment: list[str], order: list[str], value: str) -> DataFrame:
    """``sorted`` for each segment."""
    w = W.partitionBy(*segment).orderBy(*order)
    seen = df.withColumn("__p", F.lag(value).over(w))
    return seen.groupBy(*segment).agg(F.bool_and(F.coalesce(F.col("__p") <= F.col(value), F.lit(True))).alias("sorted"))


def copy_flagged(df: DataFrame, flag: Column) -> DataFrame:
    return df.where(flag)


def any_of(df: DataFrame, test: Column) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("any"))


def all_of(df: DataFrame, test: Column) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(test), F.lit(True)).alias("all"))


def bounds(values: DataFrame, queries: DataFrame, value: str, query: str) -> DataFrame:
    """``query, lower, upper``: how many values are smaller than the query, and how many not larger.

    Values and queries are put into one order and scanned once; there is no join of all with all.
    """
    v = values.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("q"))
    q = queries.select(F.col(query).alias("x")).distinct().select("x", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("q"))
    both = v.unionByName(q).groupBy("x").agg(F.sum("n").alias("n"), F.max("q").alias("q"))
    out = scan(both, ["x"], F.col("n"), "upper")
    return out.where("q = 1").select(F.col("x").alias(query), (F.col("upper") - F.col("n")).alias("lower"), "upper")


def find_pivot(df: DataFrame, order: list[str], test: Column) -> DataFrame:
    """``pivot``: how many rows come, in the order, before the first one that passes a test which all rows after
    it pass too; null if none passes.  A count, no sort."""
    key = F.struct(*order)
    first = F.min(F.when(test, key)).alias("__first")
    return df.agg(F.count_if(~test).alias("n"), first).select(F.when(F.col("__first").isNotNull(), F.col("n")).alias("pivot"))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group (a bounded priority queue)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def uniform(key: Column, seed: int = 1) -> Column:
    """A number in (0, 1] that depends on the key and the seed alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def weighted_sample(df: DataFrame, weight: Column, key: Column, k: int, seed: int = 1) -> DataFrame:
    """``k`` rows drawn without replacement by weight: the smallest of -ln(u) / w.  Rows of no weight never."""
    return df.where(weight > 0).withColumn("draw", -F.log(uniform(key, seed)) / weight).orderBy("draw", key).limit(k)


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """One row, ``rows`` and ``sum``: a sum of the rows' hashes that does not depend on their order."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return df.agg(F.count("*").alias("rows"), F.bit_xor(F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")).alias("sum"))


# ---------------------------------------------------------------- Bloom filter

#: A filter's size is a power of two in these bounds.
FILTER_BITS = (1 << 10, 1 << 27)


def bloom_positions(key: Column, hashes: int, bits: int) -> Column:
    """Positions (h1 + i * h2) modulo the size."""
    h1, h2 = (F.xxhash64(*k).bitwiseAND((1 << 40) - 1) for k in ([key], [key, F.lit("second")]))
    return F.array(*((h1 + h2 * i).bitwiseAND(bits - 1) for i in range(hashes)))


def bloom_build(df: DataFrame, key: Column, bits: int, hashes: int = 3) -> DataFrame:
    """``word, mask``: the filter's set bits in words of 64, combined before the shuffle."""
    at = df.select(F.explode(bloom_positions(key, hashes, bits)).alias("p")).distinct()
    one = F.lit(1).cast("long")
    return at.select(F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", one, F.col("p").bitwiseAND(63).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def bloom_has(df: DataFrame, filter_words: DataFrame, key: Column, bits: int, hashes: int = 3) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter.

    The filter is one binary value of ``bits / 8`` bytes (16 MB at most), so it is a one-row broadcast that
    joins every row; a bit is tested by its byte.
    """
    if bits > FILTER_BITS[1]:
        raise ValueError("filter too large to send")
    full = filter_words.sparkSession.range(bits // 64).join(filter_words, F.col("id") == F.col("word"), "left")
    text = F.hex(F.coalesce("mask", F.lit(0).cast("long")))
    packed = full.groupBy(F.lit(1).alias("__one")).agg(F.array_sort(F.collect_list(F.struct("id", F.lpad(text, 16, "0").alias("w")))).alias("a")).select("__one", F.unhex(F.array_join(F.transform("a", lambda x: x["w"]), "")).alias("__filter"))

    def test(p: Column) -> Column:
        byte = F.shiftright(p, 6) * 8 + 7 - F.shiftright(p.bitwiseAND(63), 3)
        value = F.conv(F.hex(F.substring("__filter", byte.cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(value, p.bitwiseAND(7).cast("int")) == 1

    joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(packed), "__one")
    return joined.where(F.forall(bloom_positions(key, hashes, bits), test)).drop("__one", "__filter")


def semi(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Exact membership."""
    return df.join(other, on, "left_semi")


# ---------------------------------------------------------------- trees


def prefix_trie(strings: DataFrame, seq: str = "seq", depth: int | None = None) -> DataFrame:
    """Nodes of the trie of all strings: ``prefix, n`` (strings below), ``leaf`` (a string ends here), ``children``.

    With ``depth`` only the nodes to that depth.
    """
    s = strings.select(F.col(seq).alias("s"))
    most = F.length("s") if depth is None else F.least(F.length("s"), F.lit(depth))
    nodes = s.select(F.explode(F.sequence(F.lit(0), most)).alias("d"), "s").select(F.left("s", F.col("d")).alias("prefix"), (F.length("s") == F.col("d")).alias("end"))
    nodes = nodes.groupBy("prefix").agg(F.count("*").alias("n"), F.bool_or("end").alias("leaf"))
    kids = nodes.where("prefix <> ''").groupBy(F.expr("left(prefix, length(prefix) - 1)").alias("up")).agg(F.count("*").alias("children"))
    return nodes.join(kids, nodes.prefix == kids.up, "left").select("prefix", "n", "leaf", F.coalesce("children", F.lit(0)).alias("children"))


def suffix_trie(strings: DataFrame, seq: str = "seq", depth: int | None = None) -> DataFrame:
    """The trie of all suffixes, whole or to ``depth``.  Equal suffixes are counted before they are taken apart;
    the whole trie has a node for each different infix."""
    s = strings.select(F.col(seq).alias("s"))
    if depth is None:
        taken, whole = F.expr("substring(s, b + 1)"), F.lit(True)
    else:
        taken, whole = F.expr(f"substring(s, b + 1, {depth})"), F.length("s") - F.col("b") <= depth
    ends = s.select(F.explode(F.sequence(F.lit(0), F.length("s"))).alias("b"), "s").select(taken.alias("x"), whole.alias("whole"))
    grown = ends.groupBy("x", "whole").agg(F.count("*").alias("c"))
    nodes = grown.select(F.explode(F.sequence(F.lit(0), F.length("x"))).alias("d"), "x", "whole", "c").select(F.left("x", F.col("d")).alias("prefix"), ((F.length("x") == F.col("d")) & F.col("whole")).alias("end"), "c")
    return nodes.groupBy("prefix").agg(F.sum("c").alias("n"), F.bool_or("end").alias("leaf"))


def sum_tree_update(leaves: DataFrame, changes: DataFrame, order: str, weight: str, mode: str = "add") -> DataFrame:
    """The leaves with changed weights (``changes``: leaf and weight): added up, or set to the largest one given."""
    if mode not in ("add", "set"):
        raise ValueError("mode is add or set")
    new = changes.groupBy(F.col(order).alias("__k")).agg((F.sum(weight) if mode == "add" else F.max(weight)).alias("__w"))
    value = F.col(weight) + F.coalesce("__w", F.lit(0)) if mode == "add" else F.coalesce("__w", weight)
    return leaves.join(new, F.col(order) == F.col("__k"), "left").withColumn(weight, value).drop("__k", "__w")


def sum_tree_sample(leaves: DataFrame, order: str, weight: str, draws: DataFrame, draw: str) -> DataFrame:
    """For each ``draw`` in [0, 1) the leaf in which the running sum of weights reaches it."""
    total = leaves.agg(F.sum(weight)).first()[0] or 0
    run = scan(leaves, [order], F.col(weight), "upto").where(F.col(weight) > 0)
    marks = run.select((F.col("upto") - F.col(weight)).cast("double").alias("x"), F.col(order).alias("leaf"))
    asked = draws.select((F.col(draw) * float(total)).alias("x"), F.col(draw))
    return last_marks(marks, asked, "x", "leaf").select(draw, F.col("__mark").alias("leaf"))
