import re

from helixframe.llm import exact_dedup
from helixframe.llm.exact_dedup import drop_exact, exact_groups

ROWS = [
    (1, "a b", "x"), (2, "a  b", "x"), (3, "ab", "x"), (4, None, "x"), (5, " \n", "x"), (6, "", None), (7, "AB", "x"),
    (8, "a b", "x"), (9, "z" * 200000, "x"), (10, "z" * 200000, "x"), (10, "z" * 200000, "x"), (11, "é\x0b", "x"), (12, "é", "x"),
]


def brute(rows):
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    return sorted((d, min(g)[1], len(g), d == min(g)[1]) for g in groups.values() for _, d in g)


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, h string").repartition(3)
    got = exact_groups(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute(ROWS)
    assert exact_groups(df.limit(0)).count() == 0


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: exact_dedup.F.lit("same"))
    df = spark.createDataFrame(ROWS, "doc_id long, text string, h string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df).collect()) == brute(ROWS)


def test_drop(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, h string")
    got = drop_exact(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({k for _, k, _, _ in brute(ROWS)})


def test_many_copies_are_salted(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot text', concat('t', id % 7)) AS text")
    got = exact_groups(df).groupBy("keep_id").count().collect()
    assert sum(r["count"] for r in got) == 5000 and len(got) == 8


def test_drop_keeps_rows_that_share_an_id_or_have_none(spark):
    rows = [(1, "ab", "p"), (1, "a b", "q"), (1, "a   b", "r"), (2, "other", "s"), (2, "different", "t"), (None, "x y", None), (None, "x  y", "u"), (3, "x y", "v")]
    rows += [(None, f"text {i}", "w") for i in range(1000)] + [(9, "twice", "x"), (9, "twice", "y")]
    df = spark.createDataFrame(rows, "own long, row string, n string").repartition(3)
    got = drop_exact(df, "own", "row")
    assert got.columns == df.columns
    want = [(1, "a   b"), (2, "other"), (2, "different"), (None, "x  y"), (9, "twice")] + [(None, f"text {i}") for i in range(1000)]
    assert sorted(((r.own, r.row) for r in got.collect()), key=str) == sorted(want, key=str)


def test_repeated_rows_are_dealt_to_many_salts(spark, monkeypatch):
    """One row repeated: its copies meet the representative in parts, whatever their ids."""
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SALT", 64)
    seen = []
    cut = exact_dedup.cut
    monkeypatch.setattr(exact_dedup, "cut", lambda df: seen.append(df) or cut(df))
    df = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", "'same text' AS text").repartition(4)
    assert {(r.group_size, r.kept) for r in exact_groups(df).collect()} == {(3000, True)}
    assert drop_exact(df).count() == 1
