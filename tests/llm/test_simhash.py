import random

import numpy as np
import xxhash

from helixframe.llm import _shared
from helixframe.llm.simhash import build, close_pairs, drop_near, fingerprint, near_groups, route, simhash_groups


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, reach=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= reach:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint_is_the_plain_one(spark):
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["A", "b", "É", " ", "\n", " ", "\x1c", "zz ", "c\t"]) for _ in range(rng.randrange(60)))
        assert fingerprint(t) == plain_fingerprint(t)
    hashed = spark.sql("SELECT xxhash64('a b c')").first()[0] & (2**64 - 1)
    assert fingerprint("a B\nc") == hashed
    assert fingerprint(None) == fingerprint(" \n") == 0


def points(rng, n):
    centres = [rng.getrandbits(64) for _ in range(n // 8)]
    out = {0, 1, 3, 7, 2**64 - 1, 2**63}
    while len(out) < n:
        p = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return np.array(sorted(out), dtype=np.uint64)


def test_tree_loses_no_pair():
    rng = random.Random(2)
    p = points(rng, 1500)
    nodes = build(p[::3], 40, 2)
    found, homes = set(), 0
    held = {}
    for shard, q, home in route(nodes, p, 2):
        held.setdefault(shard, {True: [], False: []})[home].append(q)
        homes += len(q) * home
    assert homes == len(p) and len(held) > 10
    for part in held.values():
        both = [np.concatenate(part[k]) if part[k] else np.empty(0, np.uint64) for k in (True, False)]
        for a, b in close_pairs(*both, 2, np.random.default_rng(1)):
            found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    d = np.bitwise_count(p[:, None] ^ p[None, :])
    i, j = np.nonzero(np.triu(d <= 2, 1))
    assert found == set(zip(p[i].tolist(), p[j].tolist(), strict=True))


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    p = points(rng, 1200).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in p], "fp long").repartition(5)
    got = {r.fp: r.root for r in near_groups(df).collect()}
    want = components(p)
    grouped = {}
    for f, r in want.items():
        grouped.setdefault(r, []).append(f)
    assert got == {f: r for r, fs in grouped.items() if len(fs) > 1 for f in fs}


def test_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base, "x"), (4, base.upper(), "x"), (7, base + " tail", "x"), (1, None, None), (2, "", "x"), (2, "", "x"), (None, "other words here", "x"), (8, "b" * 300000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash_groups(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[9].component_id == by[4].component_id == 4 and by[9].fingerprint == format(plain_fingerprint(base), "016x")
    assert by[1].fingerprint == "0" * 16 and by[2].component_id == 1
    assert by[None].component_id is None
    assert simhash_groups(df.limit(0)).count() == 0


def test_stars_are_divided(spark, monkeypatch):
    """A hub's edges are split between tasks in every join of a round, and the components are right."""
    plans = []
    cut = _shared.cut

    def noted(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(_shared, "cut", noted)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = 300_000
        edges = spark.range(1, n).selectExpr("id AS a", "if(id % 1000 = 7, id - 1, 0L) AS b").unionAll(spark.range(2 * n, 2 * n + 5).selectExpr("id AS a", "id + 1 AS b"))
        got = _shared.connected(edges)
        sizes = {r.root: r["count"] for r in got.groupBy("root").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes == {0: n, 2 * n: 6}
    assert any("skewed" in p for p in plans if "Join" in p)


def test_drop_keeps_rows_without_id(spark):
    rows = [(None, f"{i} " + " ".join(f"{chr(97 + (i * 7 + j) % 26)}{i * j}" for j in range(30)), "x") for i in range(300)] + [(5, "same words here", "x"), (None, "same words here", "x"), (5, "same words here", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, own string")
    got = drop_near(df).collect()
    assert len(got) == 301 and len({r.text for r in got}) == 301
    assert [r.doc_id for r in got if r.text == "same words here"] == [5]
