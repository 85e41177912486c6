"""Suffix arrays, Burrows-Wheeler transforms, and the tables of an FM-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .primitives import scan, segmented_scan, segmented_scans
from .storage import cut

#: Symbols of a suffix that are compared as text; beyond them ranks are doubled.
KEY = 32


def suffixes(strings: DataFrame, id_col: str = "string_id", seq_col: str = "seq", key: int = KEY) -> DataFrame:
    """``string_id, pos, head, prev``: every suffix, the empty one included, by its first ``key`` symbols;
    ``prev`` is the symbol before it, ``$`` for the whole string."""
    rows = strings.select(F.col(id_col), F.col(seq_col).alias("s"), F.explode(F.sequence(F.lit(0), F.length(seq_col))).alias("pos"))
    prev = F.when(F.col("pos") == 0, "$").otherwise(F.substring("s", F.col("pos"), F.lit(1)))
    return rows.select(id_col, "pos", F.substring("s", F.col("pos") + 1, F.lit(key)).alias("head"), prev.alias("prev"))


def _group_ranks(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``: the number of rows with smaller keys.  Equal keys share it."""
    counts = df.groupBy(*order).agg(F.count("*").alias("__n"))
    ranked = scan(counts, order, F.col("__n"), "__upto").select(*order, (F.col("__upto") - F.col("__n")).alias("rank"))
    return df.join(ranked, order)


def suffix_array(strings: DataFrame, id_col: str = "string_id", seq_col: str = "seq", key: int = KEY) -> DataFrame:
    """``string_id, pos, sa_rank, prev``: the suffixes of a set in order, the end of a string before any
    symbol, equal suffixes by string.

    Suffixes get the rank of their first ``key`` symbols; then ranks of pairs (the suffix, the suffix
    that many symbols on) double the compared length until no two suffixes of one rank are left that are
    long enough to differ.  Each round takes one join on (string, place), and only unsettled suffixes
    take part.  Rows carry ``key`` symbols, never whole suffixes.
    """
    rows = cut(_group_ranks(suffixes(strings, id_col, seq_col, key), ["head"]).select(id_col, "pos", "prev", "rank", (F.length("head") == key).alias("open")))
    span = key
    while True:
        tied = rows.where("open").groupBy("rank").agg(F.count("*").alias("__n")).where("__n > 1").select("rank")
        todo = rows.join(tied, "rank", "left_semi").where("open")
        if todo.isEmpty():
            break
        ahead = rows.select(F.col(id_col).alias("__id"), (F.col("pos") - span).alias("__pos"), F.col("rank").alias("__next"), F.col("open").alias("__on"))
        paired = todo.join(ahead, (F.col(id_col) == F.col("__id")) & (F.col("pos") == F.col("__pos")), "left")
        paired = paired.select(id_col, "pos", F.col("rank").alias("__r"), F.coalesce("__next", F.lit(-1)).alias("__next"), F.coalesce("__on", F.lit(False)).alias("__on"))
        # within a rank, the order of the second halves; the number of smaller ones refines the rank
        within = paired.groupBy("__r", "__next").agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(W.partitionBy("__r").orderBy("__next").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        finer = within.withColumn("__b", before)
        settled = paired.join(finer, ["__r", "__next"]).select(F.col(id_col).alias("__id"), F.col("pos").alias("__pos"), (F.col("__r") + F.col("__b")).alias("__new"), F.col("__on").alias("__still"))
        joined = rows.join(settled, (F.col(id_col) == F.col("__id")) & (F.col("pos") == F.col("__pos")), "left")
        rows = cut(joined.select(id_col, "pos", "prev", F.coalesce("__new", "rank").alias("rank"), F.when(F.col("__new").isNotNull(), F.col("__still")).otherwise(F.col("open")).alias("open")))
        span *= 2
    equal = F.row_number().over(W.partitionBy("rank").orderBy(id_col)) - 1
    return rows.select(id_col, "pos", (F.col("rank") + equal).cast("long").alias("sa_rank"), "prev")


# ---------------------------------------------------------------- sets whose packed symbols every task can hold

#: Symbols of a set, up to which they are sent to every task, four to a byte; suffixes of larger sets are ranked by doubling.
SENT = 1 << 29
#: Suffixes of a range, and places that a task deals out to the ranges.
SUFFIXES, PLACES = 300_000, 1_000_000
#: Steps of ``KEY`` symbols after which sorting gives up: longer repeats are for doubling.
STEPS = 4096


class _Packed:
    """Strings of A, C, G, T in the order of their ids, each from a byte of its own on.  Suffixes are numbered through;
    string k has those from ``first[k]`` on, the empty one last."""

    def __init__(self, packed: bytes, sizes: np.ndarray):
        self.packed, self.sizes = packed, sizes
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.byte = np.cumsum((sizes + 3) // 4) - (sizes + 3) // 4

    def __len__(self) -> int:
        return int((self.sizes + 1).sum())

    def place(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.first, number, "right") - 1
        return k, number - self.first[k]

    def keys(self, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next 32 symbols from symbol ``at`` of the packed ones on, A beyond the string's end, and how many of the
        ``left`` symbols they are: together they order suffixes as far as that."""
        held = np.frombuffer(self.packed, np.uint8)
        words = np.ndarray((len(held) - 8,), ">u8", self.packed, strides=(1,))
        byte, odd = at >> 2, ((at & 3) * 2).astype(np.uint64)
        key = (words[byte].astype(np.uint64) << odd) | (held[byte + 8].astype(np.uint64) >> (np.uint64(8) - odd))
        n = np.clip(left, 0, KEY)
        key = np.where(n == 0, np.uint64(0), key & ~np.uint64(0) << ((KEY - np.maximum(n, 1)) * 2).astype(np.uint64))
        return key, n.astype(np.int8)

    def head(self, number: np.ndarray) -> np.ndarray:
        k, pos = self.place(number)
        return self.keys(self.byte[k] * 4 + pos, self.sizes[k] - pos)[0]

    def sort(self, number: np.ndarray, steps: int) -> tuple[np.ndarray, bool]:
        """Suffixes in order, equal ones by their number, and whether ``steps`` sufficed."""
        number = np.sort(number)
        k, pos = self.place(number)
        at, left = self.byte[k] * 4 + pos, self.sizes[k] - pos
        out, todo, group = np.empty(len(number), np.int64), np.arange(len(number)), np.zeros(len(number), np.int64)
        # ``todo`` holds suffixes that are tied so far, ``group`` the row of ``out`` where their group begins
        for step in range(steps):
            key, n = self.keys(at[todo] + step * KEY * (left[todo] > step * KEY), left[todo] - step * KEY)
            order = np.lexsort((n, key, group) if step else (n, key))
            todo, group, key, n = todo[order], group[order], key[order], n[order]
            new = np.ones(len(todo), bool)
            new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
            begin = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            base = np.flatnonzero(np.diff(group, prepend=-1))  # where the old groups begin among ``todo``
            row = group + np.arange(len(todo)) - np.repeat(base, np.diff(base, append=len(todo)))
            size = np.diff(begin, append=len(todo))[which]
            done = (size == 1) | (n < KEY)
            out[row[done]] = number[todo[done]]  # sorts are stable, so equal suffixes stay in the order of their numbers
            group = row[begin][which]
            todo, group = todo[~done], group[~done]
            if not len(todo):
                return out, True
        out[group + np.arange(len(todo)) - np.repeat(b := np.flatnonzero(np.diff(group, prepend=-1)), np.diff(b, append=len(todo)))] = number[todo]
        return out, False


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``packed``: two bits a symbol; null where a string has symbols other than A, C, G, T."""
    code = np.full(256, 4, np.uint8)
    code[[65, 67, 71, 84]] = range(4)
    for batch in batches:
        out = []
        for s in batch.column("__seq").to_pylist():
            c = code[np.frombuffer(s.encode(), np.uint8)]
            c = np.concatenate([c, np.zeros(-len(c) % 4, np.uint8)]).reshape(-1, 4)
            out.append(None if (c == 4).any() else ((c[:, 0] << 6) | (c[:, 1] << 4) | (c[:, 2] << 2) | c[:, 3]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(map(len, batch.column("__seq").to_pylist()), pa.int64()), pa.array(out, pa.binary())], ["__id", "__n", "packed"])


def sorted_suffixes(strings: DataFrame, id_col: str = "string_id", seq_col: str = "seq", prev: bool = True) -> DataFrame | None:
    """``suffix_array`` of a set of at most ``SENT`` symbols, A, C, G, T alone, with no join: each task holds the packed
    set, deals places out to ranges of the order (by their first 32 symbols, with bounds from a sample), or sorts the
    suffixes of a range.  None for other sets and for repeats beyond ``STEPS`` steps."""
    spark, sc = strings.sparkSession, strings.sparkSession.sparkContext
    kind = strings.schema[id_col].dataType
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return None
    rows = strings.where(F.col(seq_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(seq_col).alias("__seq"))
    packed = cut(rows.mapInArrow(_pack, T.StructType([T.StructField("__id", kind), T.StructField("__n", T.LongType()), T.StructField("packed", T.BinaryType())])))
    total, other = packed.agg(F.sum("__n"), F.max(F.col("packed").isNull().cast("int"))).first()
    if not total or other or total > SENT:
        return None
    held = packed.orderBy("__id").toArrow().combine_chunks()
    ids = held.column("__id").combine_chunks()
    whole = _Packed(b"".join(held.column("packed").to_pylist()) + bytes(16), held.column("__n").to_numpy().astype(np.int64))
    count, sent, names = len(whole), sc.broadcast(whole), sc.broadcast(ids)
    sample = np.sort(whole.head(np.random.default_rng(0).integers(0, count, min(count, 100_000))))
    ranges = -(-count // SUFFIXES)
    bounds = sample[(np.arange(1, ranges) * len(sample)) // ranges]
    slices, steps = -(-count // PLACES), STEPS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                number = np.arange(k * PLACES, min((k + 1) * PLACES, count))
                to = np.searchsorted(bounds, sent.value.head(number), "right")
                order = np.argsort(to, kind="stable")
                number, to = number[order].astype(np.uint32), to[order]
                b = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                yield pa.RecordBatch.from_arrays([pa.array(to[b[:-1]], pa.int32()), pa.array([number[x:y].tobytes() for x, y in zip(b[:-1], b[1:])], pa.binary())], ["part", "numbers"])

    def sort(table: pa.Table) -> pa.Table:
        number = np.frombuffer(b"".join(table.column("numbers").to_pylist()), np.uint32).astype(np.int64)
        out, whole_ = sent.value.sort(number, steps)
        return pa.table({"part": table.column("part")[:1], "n": pa.array([len(out)], pa.int64()), "whole": pa.array([whole_]), "numbers": pa.array([out.astype(np.uint32).tobytes()], pa.binary())})

    dealt = spark.range(0, slices, 1, min(slices, max(sc.defaultParallelism * 4, 1))).mapInArrow(deal, "part int, numbers binary")
    done = cut(dealt.groupBy("part").applyInArrow(sort, "part int, n long, whole boolean, numbers binary"))
    parts = sorted(done.select("part", "n", "whole").collect())
    if not all(r["whole"] for r in parts):
        return None
    before, at = {}, 0
    for r in parts:
        before[r["part"]], at = at, at + r["n"]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        symbol = np.array(list("ACGT"), dtype=object)
        for batch in batches:
            for part, numbers in zip(batch.column("part").to_pylist(), batch.column("numbers").to_pylist()):
                all_ = np.frombuffer(numbers, np.uint32).astype(np.int64)
                for b in range(0, len(all_), 100_000):
                    number = all_[b : b + 100_000]
                    k, pos = p.place(number)
                    columns = [names.value.take(pa.array(k)), pa.array(pos, pa.int32()), pa.array(before[part] + b + np.arange(len(number)), pa.int64())]
                    if prev:
                        one = np.maximum(p.byte[k] * 4 + pos - 1, 0)
                        code = np.frombuffer(p.packed, np.uint8)[one >> 2] >> (6 - 2 * (one & 3)).astype(np.uint8) & 3
                        columns.append(pa.array(np.where(pos == 0, "$", symbol[code]), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "pos", "sa_rank", "prev"][: len(columns)])

    fields = [T.StructField(id_col, kind), T.StructField("pos", T.IntegerType()), T.StructField("sa_rank", T.LongType()), T.StructField("prev", T.StringType())]
    return done.mapInArrow(tell, T.StructType(fields if prev else fields[:3]))


def string_suffix_array(strings: DataFrame, id_col: str = "string_id", seq_col: str = "seq") -> DataFrame:
    """The suffix array of each string by itself: ``sa_rank`` counts from 0, the empty suffix, per string."""
    sa = suffix_array(strings, id_col, seq_col)
    return segmented_scan(sa, [id_col], ["sa_rank"], F.lit(1), "__n", exclusive=True).drop("sa_rank").withColumnRenamed("__n", "sa_rank").select(*sa.columns)


def bwt(sa: DataFrame, id_col: str = "string_id") -> DataFrame:
    """``string_id, bwt, primary``: each string's transform without ``$``, and the row ``$`` was in."""
    rows = sa.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("sa_rank", "prev"))).alias("r"))
    text = F.array_join(F.transform(F.filter("r", lambda x: x["prev"] != "$"), lambda x: x["prev"]), "")
    return rows.select(id_col, text.alias("bwt"), F.element_at(F.filter("r", lambda x: x["prev"] == "$"), 1)["sa_rank"].alias("primary"))


def set_bwt(sa: DataFrame, id_col: str = "string_id") -> DataFrame:
    """``sa_rank, symbol, string_id``: the set's transform by row; ``$`` rows name their string."""
    return sa.select("sa_rank", F.col("prev").alias("symbol"), F.col(id_col))


def occurrences(sa: DataFrame, every: int, keys: list[str], row: str = "sa_rank") -> DataFrame:
    """``keys, block, a, c, g, t``: how often each symbol occurs before row ``block * every``."""
    per = sa.groupBy(*keys, F.floor(F.col(row) / every).alias("block")).agg(*(F.sum(F.when(F.col("prev") == x, 1).otherwise(0)).alias(f"n_{x}") for x in "ACGT"))
    return segmented_scans(per, keys, ["block"], {x: F.col(f"n_{x.upper()}") for x in "acgt"}, exclusive=True).select(*keys, "block", *"acgt")


def rank_all(sa: DataFrame, keys: list[str], row: str = "sa_rank") -> DataFrame:
    """``rank_a .. rank_t``: occurrences of each symbol in rows up to and including this one."""
    return segmented_scans(sa, keys, [row], {f"rank_{x.lower()}": F.when(F.col("prev") == x, 1).otherwise(0) for x in "ACGT"})


def lf(sa: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``lf``: the row of the suffix one symbol longer; null at the whole string.

    A row's symbol stands, among rows of that symbol, in the order of the rows it leads to.
    """
    longer = sa.select(*(F.col(k).alias(f"__{k}") for k in keys), (F.col("pos") + 1).alias("__pos"), F.col("sa_rank").alias("lf"))
    test = F.col("pos") == F.col("__pos")
    for k in keys:
        test = test & (F.col(k) == F.col(f"__{k}"))
    return sa.join(longer, test, "left").drop("__pos", *(f"__{k}" for k in keys))


def sample_by_value(sa: DataFrame, every: int) -> DataFrame:
    """The sampled suffix array of the places that are multiples of ``every``."""
    return sa.where(F.col("pos") % every == 0)


def sample_by_row(sa: DataFrame, every: int) -> DataFrame:
    """The sampled suffix array of every ``every``-th row."""
    return sa.where(F.col("sa_rank") % every == 0)


def rank_range(sa: DataFrame, ranges: DataFrame, keys: list[str], begin: str = "begin", end: str = "end") -> DataFrame:
    """``ranges`` (``keys`` and half-open row ranges) with ``begin_a .. begin_t`` and ``end_a .. end_t``: how often
    each symbol occurs in the rows before the range's begin and before its end.

    Occurrences are joined at the two rows that a range names; row 0 has none before it.
    """
    before = rank_all(sa, keys).select(*(F.col(k).alias(f"__{k}") for k in keys), (F.col("sa_rank") + 1).alias("__row"), *(F.col(f"rank_{x}") for x in "acgt"))
    out = ranges
    for side, col in (("begin", begin), ("end", end)):
        test = F.col(col) == F.col("__row")
        for k in keys:
            test = test & (F.col(k) == F.col(f"__{k}"))
        out = out.join(before, test, "left").withColumns({f"{side}_{x}": F.coalesce(f"rank_{x}", F.lit(0)) for x in "acgt"}).drop("__row", *(f"__{k}" for k in keys), *(f"rank_{x}" for x in "acgt"))
    return out


def walk_to_sample(sa: DataFrame, every: int, keys: list[str]) -> DataFrame:
    """``keys, sa_rank, at, steps``: the sampled row that is reached from each row by steps that each lengthen the
    suffix by a symbol, and their number; a row is sampled if its place is a multiple of ``every``.

    The number of steps is the place's rest, so the walk is one join on string and place.
    """
    sample = sample_by_value(sa, every).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("pos").alias("__pos"), F.col("sa_rank").alias("at"))
    steps = F.pmod(F.col("pos"), F.lit(every))
    test = F.col("pos") - steps == F.col("__pos")
    for k in keys:
        test = test & (F.col(k) == F.col(f"__{k}"))
    return sa.join(sample, test).select(*keys, "sa_rank", "at", steps.cast("long").alias("steps"))


def look_up(walks: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sa_rank, pos``: the places of walked rows, from the sample's places and the steps."""
    s = sample.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("sa_rank").alias("__row"), F.col("pos").alias("__pos"))
    test = F.col("at") == F.col("__row")
    for k in keys:
        test = test & (F.col(k) == F.col(f"__{k}"))
    return walks.join(s, test).select(*keys, "sa_rank", (F.col("__pos") + F.col("steps")).alias("pos"))
