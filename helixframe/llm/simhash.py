"""SimHash fingerprints and near-duplicate groups through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import connected, cut, keep_rows, own_key, read_table

SEED = 42
#: Fingerprints the shared top of the tree is fitted on, at most.  Every fingerprint is then placed.
TREE_SAMPLE = 65_536
#: Fingerprints in a shard that the tree aims at, while the sample can carry so many shards.
SHARD = 1024
#: Below this size a branch inside a shard is compared in one block.
BLOCK = 512
#: Hashes whose bits are counted at once.
CHUNK = 65_536


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer.

    A-Z are lower-cased; words are runs of characters other than ASCII white space; a feature is each
    run of ``width`` words joined by spaces, repeats included (the whole sequence if there are fewer).
    A bit is set if it is set in more than half of the features' XXH64 values.  No word: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, type=pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the tree


def _distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(x, y))


def split(points: np.ndarray, reach: int, rng: np.random.Generator, tries: int = 8):
    """A vantage point and radius that divide ``points`` with few of them near the boundary, or None."""
    best = None
    for v in rng.choice(points, size=min(tries, len(points)), replace=False):
        at = np.bincount(_distance(points, v), minlength=65)
        inside = np.cumsum(at)
        for r in range(64):
            share = inside[r] / len(points)
            if 0 < inside[r] < len(points):
                near = at[max(0, r + 1 - reach) : r + 1 + reach].sum() / len(points)
                cost = near + 2 * abs(share - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, v, r)
    return best and best[1:]


def build(points: np.ndarray, shards: int, reach: int, seed: int = 7) -> list[tuple]:
    """The tree as a list of nodes: ``(vantage, radius, inside, outside)`` or ``(shard number,)``."""
    rng, nodes, count = np.random.default_rng(seed), [], [0]
    least = max(2, len(points) // max(1, shards))

    def grow(p: np.ndarray) -> int:
        me = len(nodes)
        nodes.append(None)
        cut_at = split(p, reach, rng) if len(p) > 1.5 * least else None
        if cut_at is None:
            nodes[me] = (count[0],)
            count[0] += 1
        else:
            v, r = cut_at
            near = _distance(p, v) <= r
            a = grow(p[near])
            nodes[me] = (v, int(r), a, grow(p[~near]))
        return me

    grow(points)
    return nodes


def route(nodes: list[tuple], points: np.ndarray, reach: int) -> list[tuple[int, np.ndarray, bool]]:
    """Where ``points`` go: ``(shard, points, home)``.

    A point has one home shard.  By the triangle inequality its partners lie on its own side of a
    boundary or within ``reach`` of it, so a point inside the radius that is that near to the boundary
    also visits the other side, as a query against the points that have their home there.
    """
    out, todo = [], [(0, points, True)]
    while todo:
        at, p, home = todo.pop()
        if not len(p):
            continue
        node = nodes[at]
        if len(node) == 1:
            out.append((node[0], p, home))
            continue
        v, r, a, b = node
        d = _distance(p, v).astype(np.int16)
        if home:
            todo += [(a, p[d <= r], True), (b, p[d > r], True), (b, p[(d <= r) & (d > r - reach)], False)]
        else:
            todo += [(a, p[d <= r + reach], False), (b, p[d > r - reach], False)]
    return out


def close_pairs(home: np.ndarray, visit: np.ndarray, reach: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs at ``reach`` bits or fewer: of home points, and of visitors with home points.

    Branches are divided by further vantage points until a block is small; points are distinct.
    """
    todo = [(home, visit)]
    while todo:
        h, q = todo.pop()
        if not len(h):
            continue
        cut_at = split(h, reach, rng, 4) if len(h) > BLOCK else None
        if cut_at is not None:
            v, r = cut_at
            dh, dq = _distance(h, v).astype(np.int16), _distance(q, v).astype(np.int16)
            todo.append((h[dh <= r], q[dq <= r + reach]))
            todo.append((h[dh > r], np.concatenate([q[dq > r - reach], h[(dh <= r) & (dh > r - reach)]])))
            continue
        for at in range(0, len(h), BLOCK):
            part = h[at : at + BLOCK]
            for other, own in ((h[at:], True), (q, False)):
                for to in range(0, len(other), 8 * BLOCK):
                    o = other[to : to + 8 * BLOCK]
                    i, j = np.nonzero(_distance(part[:, None], o[None, :]) <= reach)
                    if own:
                        i, j = i[at + i < at + to + j], j[at + i < at + to + j]
                    if len(i):
                        yield part[i], o[j]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest point of its group for each point of the pairs (a, b)."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def near_groups(fps: DataFrame, reach: int = 2, seed: int = 7) -> DataFrame:
    """``(fp, root)`` for distinct fingerprints ``fp`` that link with another, directly or through others.

    The top of the vantage-point tree is fitted on a bounded sample of the distinct fingerprints and is
    small enough to send to every task.  All fingerprints are placed in their home shards, and those
    near a boundary also visit the shards beyond it.  Every shard finds its pairs exactly and returns
    one edge per point, so a dense group never leaves a shard as all its pairs; the shards' edges meet
    in ``connected``.  Nothing but the sample reaches the driver.
    """
    total = fps.count()
    sample = [r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).collect()]
    if len(sample) < 2:
        return fps.sparkSession.createDataFrame([], "node long, root long").select(F.col("node").alias("fp"), "root")
    nodes = build(np.array(sample, dtype=np.int64).view(np.uint64), min(-(-total // SHARD), TREE_SAMPLE // 16), reach, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, p, home in route(nodes, points, reach):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), shard, dtype=np.int32)), pa.array(p.view(np.int64)), pa.array(np.full(len(p), home))],
                    names=["shard", "fp", "home"],
                )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        points, home = pdf["fp"].to_numpy().view(np.uint64), pdf["home"].to_numpy(dtype=bool)
        rng = np.random.default_rng(seed)
        a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for x, y in close_pairs(points[home], points[~home], reach, rng):
            held.append((x, y))
            size += len(x)
            if size > 2_000_000:  # shrink what has been found to one edge per point
                a, b = spanning(np.concatenate([a, *(p[0] for p in held)]), np.concatenate([b, *(p[1] for p in held)]))
                held, size = [], 0
        if held:
            a, b = spanning(np.concatenate([a, *(p[0] for p in held)]), np.concatenate([b, *(p[1] for p in held)]))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = fps.select("fp").mapInArrow(place, "shard int, fp long, home boolean")
    edges = placed.groupBy("shard").applyInPandas(link, "a long, b long")
    return connected(edges).select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Documents link if their fingerprints differ in ``reach`` bits or fewer; ``component_id`` is the
    smallest ``doc_id`` reachable through links, the document's own included.  Equal fingerprints are
    one point from the start, so groups of copies cost one point whatever their size.

    Defined cases: a null or empty text, or one of white space, has the fingerprint zero and links like
    any other; rows that repeat an id are rows of their own; a null id never names a component unless
    no other id is in it; an empty table gives an empty result; other columns are ignored.
    """
    per_doc = cut(fingerprints(docs, id_col, text_col, width))
    points = cut(per_doc.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = near_groups(points, reach)
    # written, so that the join is one of two scans, whose large partitions can be split
    rooted = cut(points.join(groups, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    low = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = rooted.join(low, "root").select("fp", "component_id")
    return per_doc.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest id.

    A row is known by its id and 128 bits of its text: rows that repeat an id, or have none, stay if their
    groups differ.  A row without an id gives way to one that has one; of rows that are equal in id and
    text any one stays.  The rows are shuffled once, to meet the keys of those that stay; columns are as
    they are, whatever their names.
    """
    key = own_key(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, type=pa.int64())], names=["own", "fp"])

    rows = cut(docs.select(key.alias("own"), F.col(text_col).alias("text")).mapInArrow(run, "own struct<none:boolean,id:long,a:long,b:long>, fp long"))
    points = cut(rows.groupBy("fp").agg(F.min("own").alias("first")))
    rooted = points.join(near_groups(points), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("own")).select("own")
    keep = cut(first.join(rows.groupBy("own").agg(F.count("*").alias("n")), "own"))
    return keep_rows(docs, key, keep)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))
