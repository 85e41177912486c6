import random

import pytest

from helixframe.functions import sequence as S
from helixframe.operators import hits as H
from helixframe.operators import primitives as P
from helixframe.operators import search as R
from helixframe.operators import suffix as X
from pyspark.sql import functions as F


def strings(seed=1, n=40, alphabet="ACGT", longest=60):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest)))) for i in range(n)]


@pytest.mark.parametrize("rows", [strings(), strings(2, 12, "A", 50), [(0, "ACAC" * 40), (1, "ACAC" * 40), (2, ""), (3, "G" * 200)]])
def test_suffix_array_of_a_set(spark, rows):
    df = spark.createDataFrame(rows, "string_id long, seq string")
    got = [(r.string_id, r.pos) for r in X.suffix_array(df, key=4).orderBy("sa_rank").collect()]
    want = sorted(((s[b:], i, b) for i, s in rows for b in range(len(s) + 1)))
    assert got == [(i, b) for _, i, b in want]


def test_bwt_turns_back(spark):
    rows = strings(3, 10)
    df = spark.createDataFrame(rows, "string_id long, seq string")
    for r in X.bwt(X.string_suffix_array(df)).collect():
        last = r.bwt[: r.primary] + "$" + r.bwt[r.primary :]
        order = sorted(range(len(last)), key=lambda k: (last[k] != "$", last[k], k))
        out, at = [], r.primary
        for _ in range(len(last) - 1):
            at = order[at]
            out.append(last[at])
        assert "".join(out) == dict(rows)[r.string_id]


def test_search_finds_every_place(spark):
    texts, patterns = strings(4, 6, "AC", 80), strings(5, 30, "AC", 9)
    t = spark.createDataFrame(texts, "text_id long, seq string")
    p = spark.createDataFrame([x for x in patterns if x[1]] + [(99, "ANA")], "pattern_id long, pattern string")
    want = sorted((i, j, b) for i, q in patterns for j, s in texts for b in range(len(s)) if q and s[b : b + len(q)] == q)
    assert sorted((r.pattern_id, r.text_id, r.text_pos) for r in R.locate(p, t).collect()) == want
    counts = {r.pattern_id: r.n for r in R.count(p, t).collect()}
    assert counts[99] == 0 and all(counts[i] == sum(w[0] == i for w in want) for i, q in patterns if q)
    eight = spark.createDataFrame([(i, s[:8]) for i, s in texts if len(s) >= 8], "pattern_id long, pattern string")
    off = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    near = sorted((i, j, b, off(q[:8], s[b : b + 8])) for i, q in texts if len(q) >= 8 for j, s in texts for b in range(len(s) - 7) if off(q[:8], s[b : b + 8]) <= 1)
    assert sorted(map(tuple, R.approximate(eight, t, 8).collect())) == near


def test_mems(spark):
    reads, texts = strings(6, 8, "AC", 30), strings(7, 3, "AC", 40)
    got = R.mems(spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(texts, "text_id long, seq string"), 3)
    want = set()
    for i, q in reads:
        spans = {}
        for j, s in texts:
            for a in range(len(q)):
                for b in range(len(s)):
                    if q[a] == s[b] and (a == 0 or b == 0 or q[a - 1] != s[b - 1]):
                        n = 0
                        while a + n < len(q) and b + n < len(s) and q[a + n] == s[b + n]:
                            n += 1
                        if n >= 3:
                            spans.setdefault((a, a + n), []).append((j, b))
        for (a, e), places in spans.items():
            if not any((x, y) != (a, e) and x <= a and y >= e for x, y in spans):
                want |= {(i, j, a, e, b) for j, b in places}
    assert {(r.read_id, r.text_id, r.begin, r.end, r.text_pos) for r in got.collect()} == want


def test_scans_and_runs(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(5), rng.choice("aab") if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, c string").repartition(6)
    total, want, before = 0, [], []
    for _, v, _ in rows:
        before.append(total)
        total += v
        want.append(total)
    assert [r.s for r in P.scan(df, ["k"], F.col("v"), "s").orderBy("k").collect()] == want
    assert [r.s for r in P.scan(df, ["k"], F.col("v"), "s", exclusive=True).orderBy("k").collect()] == before
    encoded = []
    for _, _, c in rows:
        if encoded and encoded[-1][0] == c:
            encoded[-1][1] += 1
        else:
            encoded.append([c, 1])
    assert [[r.c, r.n] for r in P.runlength_encode(df, ["k"], "c").orderBy("run").collect()] == encoded
    assert P.is_sorted(df, ["k"], "k").first().sorted and not P.is_sorted(df, ["k"], "v").first().sorted
    assert P.is_sorted(df.limit(0), ["k"], "k").first().sorted
    assert P.scan(df.limit(0), ["k"], F.col("v"), "s").count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys, others = spark.range(0, 1000), spark.range(10_000, 30_000)
    words = P.bloom_build(keys, F.col("id"), 1 << 14)
    assert P.bloom_has(keys, words, F.col("id"), 1 << 14).count() == 1000
    assert P.bloom_has(others, words, F.col("id"), 1 << 14).count() < 400


def test_best_two(spark):
    rows = [(1, 5, 100, "+"), (1, 5, 90, "+"), (1, 4, 120, "+"), (1, 3, 99, "-"), (1, 2, 300, "+"), (2, 1, 1, "+"), (3, 7, 5, "+"), (3, 7, 500, "-")]
    got = {r.read: r for r in H.best_two(spark.createDataFrame(rows, "read long, score int, pos long, strand string"), "read", 50).collect()}
    assert (got[1].best_pos, got[1].second_score, got[1].second_strand) == (90, 3, "-")
    assert got[2].second_score is None
    assert (got[3].best_strand, got[3].second_pos) == ("+", 500)


def test_mapping_quality(spark):
    case = lambda best, second, local: spark.sql(f"SELECT {H.mapq_sql(str(best), str(second) if second is not None else 'CAST(NULL AS INT)', '-60', '0', local)} AS q").first().q
    assert case(0, None, False) == 42 and case(-30, None, False) == 23 and case(-61, None, False) == 0
    assert case(0, -30, False) == 35 and case(-12, -12, False) == 1 and case(-30, -31, False) == 2
    assert case(0, None, True) == 44 and case(0, -54, True) == 40


def test_mates(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "first boolean, fw boolean")
    want = {"FF": [(0, 1), (1, 0), (1, 1), (0, 0)], "FR": [(0, 0), (1, 1), (0, 0), (1, 1)], "RF": [(1, 0), (0, 1), (1, 0), (0, 1)], "RR": [(1, 1), (0, 0), (0, 1), (1, 0)]}
    for policy, cases in want.items():
        left, fw = H.opposite_mate(policy, F.col("first"), F.col("fw"))
        assert [(int(r[0]), int(r[1])) for r in df.select(left, fw).collect()] == cases, policy


def test_codes_turn_back(spark):
    df = spark.createDataFrame([("ACGT",), ("TTTT",), ("AANA",)], "g string")
    got = df.select("g", S.qgram_code(F.col("g"), 4).alias("c")).withColumn("b", S.code_gram(F.col("c"), 4)).collect()
    assert [(r.c, r.b) for r in got] == [(0 + 1 * 4 + 2 * 16 + 3 * 64, "ACGT"), (255, "TTTT"), (0, "AAAA")]
    assert S.band_length(3) == 7 and S.band_length(4) == 15


def test_orders_of_many_ranges(spark, monkeypatch):
    """The same results whatever the number of ranges, with keys that share the first column."""
    from helixframe.operators import hits as H
    from helixframe.operators import primitives as P

    rows = [(i // 400, (i * 7919) % 1009, i % 13, "ab"[i // 37 % 2]) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, v long, k string").repartition(4)
    refs = spark.createDataFrame([(k, k * 50, 50) for k in range(200)], "ref_id long, offset long, length long")
    places = spark.createDataFrame([(i, (i * 977) % 10000, 20) for i in range(700)], "hit long, pos long, length long")

    def all_of():
        scans = [sorted(map(tuple, P.scan(df, ["a", "b"], F.col("v"), "s", exclusive=e).collect())) for e in (False, True)]
        runs = sorted(map(tuple, P.runlength_encode(df, ["a", "b"], "k").collect()))
        low = sorted(map(tuple, P.bounds(df, df.select((F.col("v") * 3).alias("x")), "v", "x").collect()))
        at = sorted(map(tuple, H.to_reference(places, refs).collect()))
        inner = [sorted(map(tuple, P.segmented_scan(df, ["k"], ["a", "b"], F.col("v"), "s", exclusive=e).collect())) for e in (False, True)]
        return scans, runs, low, at, inner

    one = all_of()
    monkeypatch.setattr(P, "ROWS_PER_RANGE", 64)
    assert all_of() == one
    total, want = 0, []
    for r in sorted(rows):
        total += r[2]
        want.append((*r, total))
    assert one[0][0] == want


def test_suffixes_of_a_packed_set_are_those_of_doubling(spark, monkeypatch):
    import random

    from helixframe.operators import suffix as X

    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(300))
    seqs = [base, base, base[:150] + "T" + base[151:], base[40:104], "A" * 64, "A" * 65, "A" * 32, "", "ACGT", "", "T"] + ["".join(rng.choice("AC") for _ in range(rng.randrange(80))) for _ in range(30)]
    df = spark.createDataFrame([(k * 7 % 41, s) for k, s in enumerate(seqs)] + [(99, None)], "id long, seq string")
    want = sorted((s[p:], k * 7 % 41, p, s[p - 1] if p else "$") for k, s in enumerate(seqs) for p in range(len(s) + 1))
    want = [(k, p, r, c) for r, (_, k, p, c) in enumerate(want)]
    for suffixes, places in ((X.SUFFIXES, X.PLACES), (150, 333)):
        monkeypatch.setattr(X, "SUFFIXES", suffixes)
        monkeypatch.setattr(X, "PLACES", places)
        got = X.sorted_suffixes(df, "id")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want
        assert got.dtypes == X.suffix_array(df, "id").dtypes
    monkeypatch.setattr(X, "STEPS", 3)
    assert X.sorted_suffixes(df, "id") is None
    monkeypatch.setattr(X, "SENT", 10)
    assert X.sorted_suffixes(df, "id") is None
    assert X.sorted_suffixes(df.replace("ACGT", "ACNT"), "id") is None
