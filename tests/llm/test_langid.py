import random
import zlib
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import langid
from helixframe.llm.langid import Filter, grams, identify, learn, op9_langid, places


def test_grams():
    assert [int(x).to_bytes(4, "little") for x in grams("Ab, c")] == [b" ab ", b"ab c", b"b c "]
    assert len(grams("12 !")) == 0


def test_filter_returns_all_languages_and_corrects_counts():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**32, 20000, dtype=np.uint32) for _ in range(3)]
    table = np.zeros(1 << 18, np.uint8)
    for k, codes in enumerate(sets):
        for p in places(codes, len(table)):
            table[p] |= 1 << k
    f = Filter(table, ["a", "b", "c"])
    assert all(f.of(f.containing(s), k).all() for k, s in enumerate(sets))
    other = rng.integers(0, 2**32, 50000, dtype=np.uint32)
    assert (np.abs(f.counts(other)) < 0.01 * 50000).all()


def test_held_out_accuracy(spark):
    rows = op9_langid(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right / len(held) > 0.95


def test_odd_rows(spark, tmp_path):
    rows = [(i, "the quick brown fox " * 5, "en") for i in range(30)] + [(100 + i, "der schnelle braune fuchs " * 5, "de") for i in range(30)]
    odd = [(500, None, "en"), (501, "123 !?", "de"), (502, "fuchs", None), (502, "fuchs", None), (None, "fox", "x"), (503, "日本", None), (504, "the fox " * 50000, None)]
    spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_langid(spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows + odd)
    assert by[500].lang_pred == by[501].lang_pred == "und"
    assert by[502].lang_pred == "de" and by[504].lang_pred == "en"
    assert all(by[i].lang_pred == lang for i, _, lang in rows)
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    assert learn(empty).predict("text") == ("und", 0.0)


def plain(train, texts, positions):
    """The operator over dictionaries and sets of positions."""
    counts = {}
    for text, lang in train:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text).tolist())
    langs = sorted(k for k, v in counts.items() if v)
    rate = {k: {g: n / sum(counts[k].values()) for g, n in counts[k].items()} for k in langs}
    top = {}
    for k in langs:
        for g, r in rate[k].items():
            top[g] = max(top.get(g, 0), r)
    at = lambda g: [int(p[0]) for p in places(np.array([g], np.uint32), positions)]
    stored = {k: {p for g, n in counts[k].items() if n >= langid.LEAST_COUNT and rate[k][g] >= langid.LEAST_RATE and rate[k][g] >= langid.LEAST_PART * top[g] for p in at(g)} for k in langs}
    false = {k: (len(stored[k]) / positions) ** langid.HASHES for k in langs}
    out = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        own = [at(g) for g in grams(t).tolist()]
        c = [max(0.0, (sum(all(p in stored[k] for p in ps) for ps in own) - len(own) * false[k]) / (1 - false[k])) for k in langs]
        best = c.index(max(c))
        out.append((langs[best], c[best] / sum(c) if sum(c) else 0.0))
    return out


@pytest.mark.parametrize("languages", [3, 12, 70, 300])
def test_matches_plain_sets_with_any_number_of_languages(spark, languages):
    rng = random.Random(languages)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 7))) for _ in range(9)] for k in range(languages)}
    train = [(" ".join(rng.choices(w, k=12)), lang) for lang, w in words.items() for _ in range(2)] + [(None, "l000"), ("abc", None), ("12", "zz")]
    texts = [" ".join(rng.choices(words[rng.choice(list(words))], k=6)) for _ in range(60)] + [None, "", "123", "zzzz qqqq", "a"]
    model = learn(spark.createDataFrame(train, "text string, lang string"), 1 << 14)
    got = identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    want = plain(train, texts, 1 << 14)
    assert [(r.lang_pred, round(r.score, 9)) for r in sorted(got, key=lambda r: r.doc_id)] == [(k, round(s, 9)) for k, s in want]


def test_query_matches_plain_sets(spark, tmp_path):
    rng = random.Random(5)
    words = {"aa": ["ram", "sola", "tiga"], "bb": ["ramo", "sol", "tigre"], "cc": ["ramus", "soleil", "tigris"]}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randrange(1, 9))), k) for i, k in enumerate(rng.choices(list(words), k=120))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    want = plain([(t, k) for i, t, k in rows if not fold(i)], [t for _, t, _ in rows], langid.POSITIONS[0])
    got = sorted(op9_langid(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert [(r.held_out, r.lang_pred, round(r.score, 9)) for r in got] == [(fold(i), k, round(s, 9)) for (i, _, _), (k, s) in zip(rows, want, strict=True)]
