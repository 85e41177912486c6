import numpy as np

from helixframe.llm import vectors
from helixframe.llm.vectors import near_vectors


def brute(rows, threshold=0.93):
    n = len(rows)
    ok = [v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if k else None for k, (_, v, _) in zip(ok, rows, strict=True)]
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low.setdefault(find(i), []).append(rows[i][0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return [(rows[i][0], links[i], first[find(i)]) for i in range(n)]


def test_odd_rows_and_groups(spark):
    rng = np.random.default_rng(2)
    f = lambda v: [float(np.float32(x)) for x in v]
    centre = rng.normal(size=(12, 16))
    rows = [(i, f(centre[i % 12] + 0.05 * rng.normal(size=16)), int(i % 3)) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)] + [(5, rows[5][1], 2)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] + [1.0] * 15, 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [1.0, None], 1), (2007, [1.0, 0.0], 0), (2008, [2.0, 0.0], 0), (None, [3.0, 0.0], 0), (2009, f(np.array(rows[0][1]) * 7), 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    key = lambda r: str(r)
    want = sorted(brute(rows), key=key)
    got = near_vectors(df, cell=32).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == want
    # lists of 40 members described anew by so many reference points: an index's recall, never a false link
    again = near_vectors(df, cell=32, long=40).collect()
    links = lambda rs: {(r[0], r[2]): r[1] for r in rs if r[0] is not None and r[0] < 1000 and r[0] != 5}
    some, all_ = links([(r.vec_id, r.n_links, r.component_id) for r in again]), links(want)
    assert some.keys() == all_.keys() and all(n <= all_[k] for k, n in some.items())
    assert sum(some.values()) >= 0.98 * sum(all_.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_near_the_threshold(spark):
    """Pairs planted just above the threshold among unrelated vectors."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=(3000, 64))
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.932, 0.95, size=(3000, 1))
    twin = cosine * base + np.sqrt(1 - cosine**2) * away
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, twin]).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for long in (32_768, 300):  # the second describes all lists anew by reference points of their own
        got = near_vectors(df, long=long).collect()
        found = sum(r.n_links > 0 for r in got) / len(got)
        print("recall", long, found)
        assert found >= 0.99
        assert all(r.component_id == r.vec_id % 3000 for r in got if r.n_links)


def test_recall_stays_level_as_reference_points_grow():
    """Planted pairs share enough of the nearest reference points, whatever the number of them."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base, away = unit(rng.normal(size=(1500, 64))), rng.normal(size=(1500, 64))
    away = unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    cosine = rng.uniform(0.932, 0.95, size=(1500, 1))
    twin = cosine * base + np.sqrt(1 - cosine**2) * away
    for n in (64, 1024, 4096):
        pivots = unit(rng.normal(size=(n, 64)))
        k = vectors.nearest_of(n)
        a, b = (vectors.describe(x, pivots, k) for x in (base, twin))
        recall = ((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= vectors.SHARED).mean()
        print("recall", n, k, recall)
        assert recall >= 0.999, n


def test_recall_in_a_dense_group(spark):
    """A third of all vectors lie about the threshold apart from each other, so most reference points drawn would be theirs."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    group = centre / np.linalg.norm(centre) + rng.normal(size=(1200, 64)) * 0.26 / 8
    all_ = np.concatenate([group, rng.normal(size=(2400, 64))]).astype(np.float32)
    unit = all_.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(all_)], "vec_id long, embedding array<float>, label int").repartition(4)
    for long in (32_768, 500):
        got = {r.vec_id: r.n_links for r in near_vectors(df, long=long).collect()}
        have = np.array([got[i] for i in range(len(all_))])
        print("recall", long, have.sum() / want.sum(), want.sum())
        assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
