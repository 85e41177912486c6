import hashlib
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_exact_dedup import brute as exact_groups
from test_mixing import brute as mix
from test_simhash import components, plain_fingerprint

from helixframe.llm.mixing import Mix
from helixframe.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_every_stage_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, SF)
        rows = at.collect()
        outs.append(rows)
        if k < 4:
            assert at.columns == docs.columns
            at = spark.createDataFrame(rows, docs.schema)
    toxic, exact, near, mixed, coded = outs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in toxicity(docs, labels).collect() if not r.rejected}
    assert {r.doc_id for r in toxic} == kept
    plain = [(r.doc_id, r.text, None) for r in toxic]
    assert sorted(r.doc_id for r in exact) == sorted(d for d, _, _, stays in exact_groups(plain) if stays)
    prints = {}
    for r in exact:
        prints.setdefault(plain_fingerprint(r.text), []).append(r.doc_id)
    groups = {}
    for f, root in components(list(prints)).items():
        groups.setdefault(root, []).extend(prints[f])
    assert sorted(r.doc_id for r in near) == sorted(map(min, groups.values()))
    want = mix([(r.doc_id, r.text, r.lang, r.source) for r in near], Mix())
    assert sorted(r.doc_id for r in mixed) == sorted(d for d, _ in want)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed}
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mixed)
    for r in coded:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    long = "word " * 60000
    rows = [(i, f"text number {i} of some plain words", "en", f"src{i % 3}", 5, "x") for i in range(40)]
    rows += [(100, None, None, None, None, None), (101, "", "en", None, 0, "x"), (102, long, None, "src1", 3, None), (103, long, "de", "src1", 3, "y"), (0, rows[0][1], "en", "src0", 5, "x"), (None, "no id at all here", "fr", "src2", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, salt string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if k < 4:
            assert at.columns == docs.columns
        if k == 2:
            assert at.count() == at.select("doc_id").distinct().count()
            assert at.where("text LIKE 'word word%'").count() == 1
    assert at.count() > 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0


def test_near_dedup_keeps_unrelated_rows_that_share_an_id_or_have_none(spark):
    texts = [f"row {k} tells of {' '.join(chr(97 + (k * 7 + j * j) % 26) * 5 for j in range(12))}" for k in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (None, texts[4]), (3, texts[4]), (None, texts[5]), (None, texts[5]), (4, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.simhash(spark, docs, SF)
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (None, texts[5]), (4, None)]
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
