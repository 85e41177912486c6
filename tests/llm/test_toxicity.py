import random
import zlib

import numpy as np

from helixframe.llm.toxicity import CHAIN, FEATURES, FOLDS, Chain, drop_toxic, features, fit_logistic, op8_toxicity, predict, toxicity, train


def test_linear_model_finds_the_telling_feature():
    rng = np.random.default_rng(1)
    rows = np.repeat(np.arange(400), 5)
    cols = rng.integers(1, 30, 2000)
    y = (np.arange(400) % 4 == 0).astype(float)
    rows, cols = np.concatenate([rows, np.flatnonzero(y)]), np.concatenate([cols, np.zeros(100, int)])
    w = fit_logistic(rows, cols, np.zeros((400, 0)), y, 30)
    assert np.argmax(w[:-1]) == 0
    assert ((predict(w, rows, cols, np.zeros((400, 0)), 400) > 0.5) == (y == 1)).mean() > 0.99


def test_later_models_are_fed_probabilities_of_models_that_have_not_seen_the_document():
    rng = np.random.default_rng(2)
    n = 300
    rows, cols = np.arange(n), rng.integers(0, 50, n)
    labels = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 2, n)])
    folds = np.arange(n) % FOLDS
    chain = Chain(["a", "b"], {f"w{i}": i for i in range(50)}).fit(rows, cols, labels, np.ones((n, 2), bool), folds)
    for f in range(FOLDS):
        seen = np.flatnonzero(folds != f)
        w = fit_logistic(np.arange(len(seen)), cols[seen], np.zeros((len(seen), 0)), labels[seen, 0].astype(float), 50)
        own = np.flatnonzero(folds == f)
        assert np.allclose(chain.held_out[0][own], predict(w, np.arange(len(own)), cols[own], np.zeros((len(own), 0)), len(own)))
    assert len(chain.weights[1]) == 50 + 1 + 1


def sample(n=600):
    rng = random.Random(3)
    calm = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(calm, k=rng.choice([5, 60, 400]))
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Idiot", "scum!", "moron,"])
        docs.append((i, " ".join(words), i % 2))
        if i % 3:
            labels.append((i, int(i % 7 > 0), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = sample()
    odd = [(1000, None, 1), (1001, "", 1), (1002, "what an IDIOT", 1), (1003, "word1 " * 90000, 1), (1003, "word1 " * 3, 1), (None, "scum", 1)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, toxic int")
    lab = spark.createDataFrame([*labels, (1, None, None), (7, 1, 0), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(df, lab).collect()
    by = {r.doc_id: r.rejected for r in got}
    assert len(got) == len(docs) + len(odd)
    known = {i for i, _, _ in labels}
    assert all(by[i] == (i % 5 == 0) for i, _, _ in docs if i not in known)
    assert by[1002] and by[None] and not by[1000] and not by[1001] and not by[1003]
    kept = drop_toxic(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in by.items() if not x}


def test_nothing_to_learn_from(spark):
    docs, labels = sample(30)
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    lab = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in toxicity(df, lab).collect())
    assert not any(r.rejected for r in toxicity(df, lab.limit(0)).collect())
    assert toxicity(df.limit(0), lab).count() == 0


def plain_fit(x, y, l2=0.5):
    """Newton's method with the whole matrix of second derivatives, to the end."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge, w = np.append(np.full(x.shape[1] - 1, l2), 1e-6), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


def plain_chain(docs, labels):
    """The whole operator over lists: features, choice by chi-square, folds, chain; probabilities per document."""
    known = {}
    for d, q, t in labels:
        if d is not None:
            old = known.get(d, (None, None))
            known[d] = tuple(max((x for x in (a, b) if x is not None), default=None) for a, b in zip(old, (None if q is None else int(q == 0), None if t is None else int(t == 1)), strict=True))
    rows = [(d, features(t), known[d]) for d, t in sorted(docs.items()) if d in known and known[d] != (None, None)]
    wanted = set()
    for k in range(2):
        own = [(f, y[k]) for _, f, y in rows if y[k] is not None]
        pos, neg = sum(y for _, y in own), sum(1 - y for _, y in own)
        scored = []
        for f in {f for fs, _ in own for f in fs}:
            a, b = sum(y for fs, y in own if f in fs), sum(1 - y for fs, y in own if f in fs)
            if 3 <= a + b < pos + neg and pos and neg:
                top = float(a) * (neg - b) - float(b) * (pos - a)
                scored.append((-(top * top * (pos + neg) / (float(a + b) * (pos + neg - a - b) * pos * neg)), f))
        wanted |= {f for _, f in sorted(scored)[:FEATURES]}
    names = sorted(wanted)
    matrix = lambda sets: np.array([[f in s for f in names] for s in sets], float).reshape(len(sets), len(names))
    x, every = matrix([f for _, f, _ in rows]), matrix([features(t) for _, t in sorted(docs.items())])
    folds = np.array([hash((d, 11)) % FOLDS for d, _, _ in rows])
    apply = lambda w, m: 1 / (1 + np.exp(-np.clip(m @ w[:-1] + w[-1], -30, 30)))
    for k in range(2):
        ok, y = np.array([r[2][k] is not None for r in rows]), np.array([r[2][k] or 0 for r in rows], float)
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            out[folds == f] = apply(plain_fit(x[ok & (folds != f)], y[ok & (folds != f)]), x[folds == f])
        own = apply(plain_fit(x[ok], y[ok]), every)
        x, every = np.column_stack([x, out]), np.column_stack([every, own])
    return {d: tuple(every[i, -2:]) for i, d in enumerate(sorted(docs))}


def test_query_matches_the_plain_chain(spark, tmp_path):
    rng = random.Random(4)
    words, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], ["idiot", "scum"]
    docs, labels = {}, []
    for i in range(240):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        docs[i] = " ".join(rng.choices(words, k=12) + [rng.choice(bad)] * (toxic and rng.random() < 0.9) + ["junk"] * poor)
        if zlib.crc32(str(i).encode()) % 4:
            labels.append((i, None if i % 17 == 0 else int(not poor), None if i % 19 == 0 else int(toxic)))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = plain_chain(docs, labels)
    got = op8_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert np.allclose([r.low_quality, r.toxic], want[r.doc_id], atol=0.02), r
        assert r.rejected == (r.toxic > 0.5)


def test_copies_of_a_labelled_id_are_learned_from_once(spark, monkeypatch):
    docs, labels = sample(60)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    many = df.where("doc_id = 5").crossJoin(spark.range(4000)).selectExpr("doc_id", "concat(text, ' x', id % 50) AS text")
    lab = spark.createDataFrame([*labels, (5, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    fit = Chain.fit
    monkeypatch.setattr(Chain, "fit", lambda self, r, c, y, *rest: seen.append(len(y)) or fit(self, r, c, y, *rest))
    train(df.unionByName(many).unionByName(df.where("doc_id = 5").selectExpr("doc_id", "cast(null AS string) AS text")), lab)
    assert seen == [len({d for d, _, _ in labels} | {5})] and len(CHAIN) == 2
