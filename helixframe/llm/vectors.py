"""Embedding near-dedup through a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import connected, cut, read_table
from .simhash import spanning

THRESHOLD = 0.93
#: Reference points: one per so many different vectors, within these bounds.
VECTORS_PER_PIVOT = 256
PIVOTS = (64, 4096)
#: Nearest reference points that describe a vector, with one more for each doubling of the reference
#: points beyond the fewest, so that recall stays level; and how many two vectors must share.
NEAREST = 8
SHARED = 2
#: Reference points are less alike than this, so that a dense group holds one of them and not many at about the
#: same distance, whose order would tell little; so many candidates are looked at for each.
SEPARATE = 0.85
CANDIDATES = 2
#: Members of an inverted list that are compared at once; longer lists are divided into cells.
CELL = 1024
#: Members beyond which a list is described anew by reference points of its own, and members described at once.
LONG = 32 * CELL
DESCRIBED = 4096
#: Divided lists that are broadcast to the vectors; beyond that they are joined by a shuffle.
BROADCAST_LISTS = 50_000


def nearest_of(pivots: int) -> int:
    """How many of ``pivots`` reference points describe a vector."""
    return NEAREST + max(0, round(float(np.log2(max(pivots, 1) / PIVOTS[0]))))


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of the ``nearest`` reference points of each vector by cosine, the nearest first."""
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    like = v @ pivots.T
    k = min(nearest, len(pivots))
    top = np.argpartition(-like, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(like, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int32)


def separated(points: np.ndarray, most: int) -> np.ndarray:
    """The first points, at most ``most``, of which each is less like all before it than ``SEPARATE``."""
    kept = np.empty((min(most, len(points)), points.shape[1]))
    n = 0
    for at in range(0, len(points), 256):
        part = points[at : at + 256]
        free = (part @ kept[:n].T < SEPARATE).all(axis=1) if n else np.ones(len(part), dtype=bool)
        like = part @ part.T
        for k in np.flatnonzero(free):
            if n == len(kept):
                return kept
            if free[k]:
                kept[n] = part[k]
                n += 1
                free &= like[k] < SEPARATE
    return kept[:n]


def links_in_cell(perms: np.ndarray, units: np.ndarray, pivot: int, left: np.ndarray, right: np.ndarray, threshold: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) of ``left`` x ``right`` that share ``shared`` pivots or more, of which ``pivot`` is
    the smallest number, and whose cosine reaches the threshold."""
    names, codes = np.unique(perms, return_inverse=True)
    marks = np.zeros((len(perms), len(names)), dtype=np.float32)
    np.put_along_axis(marks, codes.reshape(perms.shape), 1.0, axis=1)
    out_i, out_j = [], []
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        both = marks[part] @ marks[right].T >= shared - 0.5
        both &= part[:, None] != right[None, :]
        i, j = np.nonzero(both & (units[part] @ units[right].T >= threshold))
        i, j = part[i], right[j]
        if len(i):
            same = perms[i][:, :, None] == perms[j][:, None, :]
            first = np.where(same.any(axis=2), perms[i], np.iinfo(np.int32).max).min(axis=1)
            ok = first == pivot
            out_i.append(i[ok])
            out_j.append(j[ok])
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(out_i) if out_i else none), (np.concatenate(out_j) if out_j else none)


def _common(perms: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many reference points the pairs share, and the smallest number of them."""
    same = (perms[i][:, :, None] == perms[j][:, None, :]).any(axis=2)
    return same.sum(axis=1), np.where(same, perms[i], np.iinfo(np.int32).max).min(axis=1)


def _units(vectors) -> np.ndarray:
    """Rows of length one, scaled first so that squares can neither overflow nor vanish."""
    out = np.array(list(vectors), dtype=np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _sublists(members: DataFrame, lists: DataFrame, few: bool, shared: int) -> DataFrame:
    """``label, size, pivot, node, perm2``: the members of long lists, described by their list's own reference points.

    ``members`` has ``label, size, pivot, node, v``; ``lists`` the lists and their sizes ``n``.  A list has one
    reference point for ``VECTORS_PER_PIVOT`` members, those with the smallest hashes, so sublists do not
    grow with the table; members meet them in blocks of ``DESCRIBED``, and no list is gathered.
    """
    keys = ["label", "size", "pivot"]
    points = F.least(F.greatest(F.floor(F.col("n") / VECTORS_PER_PIVOT), F.lit(PIVOTS[0])), F.lit(PIVOTS[1]))
    held = members.join(F.broadcast(lists) if few else lists, keys).withColumn("blocks", F.ceil(F.col("n") / DESCRIBED).cast("int")).withColumn("points", points)
    draw = F.pmod(F.xxhash64("node", "pivot", F.lit("point")), F.lit(1 << 40))
    drawn = held.select(*keys, "node", "v", "blocks", "points", "n", draw.alias("draw")).where(F.col("draw") < 2 * CANDIDATES * F.col("points") / F.col("n") * float(1 << 40))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("draw", "node"))  # about twice the candidates of a list
    chosen = cut(drawn.withColumn("nth", nth).where(F.col("nth") <= CANDIDATES * F.col("points")).select(*keys, "blocks", "points", "nth", "v"))
    # columns of its own: both sides of the cogroup come from the same members
    chosen = chosen.toDF(*chosen.columns).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def describe_block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"label": [], "size": [], "pivot": [], "node": [], "perm2": []})
        right = right.sort_values("nth")
        pivots = separated(_units(right["v"]), int(right["points"].iloc[0]))
        perm = describe(_units(left["v"]), pivots, nearest_of(len(pivots)))
        return pd.DataFrame({"label": key[0], "size": key[1], "pivot": key[2], "node": left["node"].to_numpy(), "perm2": list(perm)})

    both = dealt.select(*keys, "block", "node", "v").groupBy(*keys, "block").cogroup(chosen.select(*keys, "block", "points", "nth", "v").groupBy(*keys, "block"))
    return cut(both.applyInPandas(describe_block, "label string, size int, pivot int, node long, perm2 array<int>"))


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    nearest: int | None = None, shared: int = SHARED, cell: int = CELL, long: int = LONG,
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors of one label link if their cosine in double precision reaches ``threshold``.  Equal vectors
    become one representative with a weight.  A bounded number of representatives, those with the
    smallest hashes that are not too much alike (``separated``), serve as reference points; every representative is described by its ``nearest``
    ones (``nearest_of`` their number, if not given) in order and entered in the inverted list of each.  Members of a list that share enough
    reference points are candidates, and each candidate pair is verified in the list of the smallest
    number it shares.  Lists longer than ``cell`` are divided into cells of blocks against blocks, so
    that none is gathered whole and no candidate is given up; lists longer than ``long``, which come with
    tables beyond the largest number of reference points, are described anew by reference points of their
    own, and their members meet in the sublists of those, so that a vector's copies do not grow with the
    table.  A cell returns, per vector, the weight it links with and one edge of a spanning forest, never
    its pairs.

    Pairs that share fewer than ``shared`` reference points are missed; tests hold the recall against
    brute force.  Defined cases: a null label, and a null, empty or zero vector, or one with null or
    non-finite components, links with nothing; vectors of different lengths do not link; repeated rows
    link with each other; a null id never names a component that has another; of equally near reference
    points any is taken; an empty table gives an empty result; other columns are ignored.
    """
    v = F.col("v")
    fine = v.isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    # single precision is enough to carry what came in single precision; it is computed with in double
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    src = src.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("h", F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64("v", F.lit("second"), "label").alias("b")))
    rows = cut(src.select("vec_id", "fine", "h.a", "h.b"))
    reps = src.where("fine").groupBy("h.a", "h.b").agg(F.count("*").alias("c"), F.min("vec_id").alias("first"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("node"), "*"))
    total = reps.count()
    count = min(max(total // VECTORS_PER_PIVOT, PIVOTS[0]), PIVOTS[1])
    chosen = [r[0] for r in reps.select("v", "node").orderBy(F.xxhash64("a", "b"), "node").limit(CANDIDATES * count).collect()]
    if not chosen:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(map(len, chosen))
    pivots = np.zeros((len(chosen), width))
    for k, p in enumerate(chosen):
        pivots[k, : len(p)] = np.array(p) / np.abs(p).max()
        pivots[k] /= np.linalg.norm(pivots[k])
    pivots = separated(pivots, count)
    nearest = nearest or nearest_of(len(pivots))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = b.column(1).flatten().to_numpy().astype(np.float64), np.diff(b.column(1).offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(ends)])
            dense = np.zeros((len(ends), width))
            for k, n in enumerate(ends):
                own = flat[starts[k] : starts[k] + n]
                own = own / np.abs(own).max()  # a scale that cannot overflow
                dense[k, : min(n, width)] = own[:width]
                if not dense[k].any():
                    dense[k, 0] = 1.0
            perm = describe(dense, pivots, nearest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(perm), pa.list_(pa.int32()))], names=["node", "perm"])

    shared = min(shared, len(pivots))
    perms = cut(reps.select("node", "v").mapInArrow(permute, "node long, perm array<int>"))
    # the smallest of at least `shared` common numbers is none of a vector's own `shared` - 1 largest
    entries = F.slice(F.array_sort("perm"), 1, F.greatest(F.size("perm") - (shared - 1), F.lit(1)))
    whole = perms.join(reps.select("node", "c", "label", "v"), "node").withColumn("size", F.size("v"))
    keys = ["label", "size", "pivot"]
    lists = perms.join(reps.select("node", "label", F.size("v").alias("size")), "node").select("label", "size", F.explode(entries).alias("pivot"))
    counted = cut(lists.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > cell))
    few = counted.count() <= BROADCAST_LISTS
    none = F.array().cast("array<int>")

    def dealt(rows: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
        """Members of lists in cells of two blocks; a list that ``sizes`` does not name is one cell."""
        out = rows.join(F.broadcast(sizes) if few else sizes, by, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / cell).cast("int"), F.lit(1)))
        out = out.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return out.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).select(*keys, "pivot2", "lo", "hi", "block", "node", "c", "v", "perm", "perm2")

    entered = whole.withColumn("pivot", F.explode(entries))
    long_ones = counted.where(F.col("n") > long)
    if long_ones.isEmpty():
        member = dealt(entered.withColumns({"pivot2": F.lit(-1), "perm2": none}), counted, keys)
    else:
        long_ones = cut(long_ones)
        short = entered.join(F.broadcast(long_ones) if few else long_ones, keys, "left_anti")
        again = _sublists(entered.select(*keys, "node", "v"), long_ones, few, shared)
        own = F.slice(F.array_sort("perm2"), 1, F.greatest(F.size("perm2") - (shared - 1), F.lit(1)))
        again = again.withColumn("pivot2", F.explode(own))
        sizes = cut(again.groupBy(*keys, "pivot2").agg(F.count("*").alias("n")).where(F.col("n") > cell))
        few = few and sizes.count() <= BROADCAST_LISTS
        below = again.join(whole.select("node", "c", "v", "perm"), "node")
        member = dealt(short.withColumns({"pivot2": F.lit(-1), "perm2": none}), counted, keys).unionByName(dealt(below, sizes, [*keys, "pivot2"]))

    def verify(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, pivot, pivot2, lo, hi = key
        units, block = _units(pdf["v"]), pdf["block"].to_numpy()
        perm, node, c = np.array(pdf["perm"].tolist(), dtype=np.int32), pdf["node"].to_numpy(), pdf["c"].to_numpy()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        if pivot2 < 0:
            i, j = links_in_cell(perm, units, pivot, left, right, threshold, shared)
        else:  # a sublist: the pair must also be this list's, by what it shares at large
            inner = np.array(pdf["perm2"].tolist(), dtype=np.int32)
            i, j = links_in_cell(inner, units, pivot2, left, right, threshold, min(shared, inner.shape[1]))
            if len(i):
                n, first = _common(perm, i, j)
                ok = (n >= shared) & (first == pivot)
                i, j = i[ok], j[ok]
        weight = np.bincount(i, weights=c[j], minlength=len(node))
        if lo != hi:
            weight += np.bincount(j, weights=c[i], minlength=len(node))
        names, roots = spanning(node[i], node[j])
        root = dict(zip(names.tolist(), roots.tolist(), strict=True))
        at = np.flatnonzero(weight)
        return pd.DataFrame({"node": node[at], "links": weight[at].astype(np.int64), "root": np.array([root[x] for x in node[at].tolist()], dtype=np.int64)})

    found = cut(member.groupBy(*keys, "pivot2", "lo", "hi").applyInPandas(verify, "node long, links long, root long"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "top")
    named = reps.select("node", "a", "b", "c", "first").join(groups, "node", "left").join(degree, "node", "left").withColumn("top", F.coalesce("top", "node"))
    # written, so that the join is one of two scans, whose large partitions can be split
    named = cut(named)
    low = cut(named.groupBy("top").agg(F.min("first").alias("component")))
    named = named.join(low, "top").select(F.col("a").alias("ra"), F.col("b").alias("rb"), "component", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.join(named, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")) & F.col("fine"), "left")
    own = F.when(F.col("ra").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: Every pair of a label by brute force; components by closure.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
