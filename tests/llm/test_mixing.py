import random

import duckdb
import pytest

from pyspark.sql import functions as F

from helixframe.llm import mixing
from helixframe.llm.mixing import Mix, _bucket, mixed_documents, mixture, mixture_sql

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, place long"


def documents(n=900, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choice([0, 1, 3, 30, 200]) if i else 9000
        source = "src0" if rng.random() < 0.4 else rng.choice([f"src{k}" for k in range(9)] + [None])
        out.append((i, "w\t" * words if words else rng.choice([None, "", " \n"]), rng.choice(["en", "en", "de", "fr", "xx", None]), source, words, 7))
    return out


def brute(rows, mix):
    """Budgets by filling children step by step, then prefixes by a plain loop."""
    import hashlib
    import math

    def domain(s):
        d = hashlib.md5((s or "").encode()).hexdigest()[0]
        return "web" if d in "0123" else "books" if d in "4567" else "code" if d in "89ab" else "papers"

    leaf = {}
    for d, t, lang, s, *_ in rows:
        leaf.setdefault((domain(s), lang or "", s or ""), []).append((d, len((t or "").split())))
    room = {k: mix.epochs * sum(n for _, n in v) for k, v in leaf.items()}
    levels = [mix.domain, mix.lang, mix.source]

    def fill(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        kids = sorted({k[depth] for k in room if k[:depth] == prefix})
        size = {k: sum(r for p, r in room.items() if p[: depth + 1] == (*prefix, k)) for k in kids}
        weight = {k: levels[depth].get(k, mix.other) for k in kids}
        give, left, open_ = dict.fromkeys(kids, 0.0), budget, [k for k in kids if size[k] > 0]
        while open_ and left > 1e-9:
            total = sum(weight[k] for k in open_)
            full = [k for k in open_ if give[k] + left * weight[k] / total >= size[k] - 1e-12]
            if not full:
                for k in open_:
                    give[k] += left * weight[k] / total
                left = 0
            else:
                # fill the one that is full first and start again from nothing
                k = min(open_, key=lambda k: size[k] / weight[k])
                give[k], budget_left = float(size[k]), left - size[k]
                left = budget_left
                open_.remove(k)
        out = {}
        for k in kids:
            out |= fill((*prefix, k), give[k])
        return out

    total = sum(n for v in leaf.values() for _, n in v)
    give = fill((), total * mix.share)
    used = []
    for k, docs in leaf.items():
        size = sum(n for _, n in docs)
        if not size:
            continue
        g = math.floor(give[k] + 1e-6)
        whole, rest = divmod(g, size)
        used += [(d, e) for d, _ in docs for e in range(whole)]
        order = sorted((int(hashlib.md5(f"{mix.seed}:{whole}:{d}".encode()).hexdigest()[:13], 16), d, n) for d, n in docs)
        run = 0
        for _, d, n in order:
            run += n
            if run <= rest:
                used.append((d, whole))
    return sorted(used)


@pytest.mark.parametrize("mix", [Mix(), Mix(share=0.3), Mix(share=5.0, epochs=3), Mix(lang={"en": 1.0, "de": 9.0}, source={"src0": 0.01}, share=1.0)])
def test_matches_brute_force_and_sql(spark, mix):
    rows = documents()
    df = spark.createDataFrame(rows, COLUMNS)
    got = sorted((r.doc_id, r.epoch) for r in mixture(df, mix).collect())
    assert got == brute(rows, mix)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT, place BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?, ?)", rows)
    assert sorted((r[0], r[5]) for r in con.execute(mixture_sql(mix=mix)).fetchall()) == got


def test_documents_keep_their_columns(spark):
    rows = [*documents(200), (5, "again", "en", "src0", 1, 1), (None, "no id", None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = mixed_documents(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in mixture(df).collect())
    assert mixed_documents(df.limit(0)).count() == mixture(df.limit(0)).count() == 0


def test_hot_leaf_in_buckets(spark):
    rows = [(i, "a b c", "en", "src1", 5, 0) for i in range(6000)] + [(6000 + i, "a", "de", "src2", 1, 0) for i in range(50)]
    df = spark.createDataFrame(rows, COLUMNS)
    mix = Mix(share=0.5)
    assert sorted((r.doc_id, r.epoch) for r in mixture(df, mix).collect()) == brute(rows, mix)


def test_buckets_of_very_large_leaves(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(52), n) for n in (1, 7, 2**20, 2**23, 2**31 + 5, 2**40) for _ in range(50)] + [(2**52 - 1, 2**40), (0, 2**40)]
    got = spark.createDataFrame(rows, "place long, n long").withColumn("b", _bucket(F.col("place"), F.col("n"))).collect()
    assert all(r.b == (r.place >> 12) * r.n >> 40 for r in got)


@pytest.mark.parametrize("few", [20_000, 0])
def test_many_sources_of_a_parent(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", few)
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 2, 40, 900]), "en", f"s{rng.randrange(700)}", 1, 1) for i in range(4000)]
    mix = Mix(share=1.1, source={f"s{k}": float(1 + k % 5) for k in range(60)})
    got = sorted((r.doc_id, r.epoch) for r in mixture(spark.createDataFrame(rows, COLUMNS), mix).collect())
    assert got == brute(rows, mix)


def test_rows_that_share_an_id(spark):
    """Rows of one id in a leaf have one place and stand or fall together."""
    rows = [(None, "a b", "en", "src1", 1, 1)] * 3000 + [(i, "a b c", "en", "src1", 1, 1) for i in range(3000)]
    got = mixture(spark.createDataFrame(rows, COLUMNS), Mix(share=0.5)).groupBy("doc_id").count().collect()
    by = {r.doc_id: r["count"] for r in got}
    assert by.pop(None, 0) in (0, 3000) and set(by.values()) == {1}
