"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from helixframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()
#: A few of each kind, so that the tests stay short; all of them are registered with their SQL.
CHOSEN = ["revcomp", "seeds_retry", "qgram_encode", "qgram_index", "qgram_range", "qgram_best_diagonal", "bwt", "rank_queries", "fm_count", "hamming_match", "mem", "mapq", "pair_hits", "diff_contingency", "coord_to_refseq", "reduce_by_key", "bounds", "sum_tree", "bloom_semi", "suffix_trie", "edit_distance_semiglobal", "sw_local", "gotoh_semiglobal", "qmap", "fmmap", "qgram_page", "checksum", "best2_ends", "fastq_file", "bam_file", "sam_reads", "bwt_packed", "read_batches", "run_statistics", "edit_distance_banded", "gotoh_quality", "cigar", "diff_single", "diff_paired"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", ["aligner", "paired_aligner"])
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_every_query_has_sql_or_a_reason():
    missing = set(registry.queries()) - set(registry.oracle_sql())
    assert missing == {"aligner", "paired_aligner"}


def test_paired_aligner_uses_whole_texts(spark, tmp_path):
    """Fragments from the beginning to the end of a long text, and of a text shorter than a fragment."""
    import random

    rng = random.Random(4)
    texts = {1: "".join(rng.choice("ACGT") for _ in range(3300)), 2: "".join(rng.choice("ACGT") for _ in range(70)), 3: "", 4: "ACG"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r.read_id, r.begin, r.mate): r for r in registry.queries()["paired_aligner"](spark, str(tmp_path)).collect()}
    assert set(rows) == {(k, b, m) for k, t in texts.items() for b in range(0, len(t), 160) for m in (1, 2)}
    for (k, b, _), r in rows.items():
        size = min(160, len(texts[k]) - b)
        assert (r.flag & 7, r.ed, r.score, abs(r.tlen)) == (3, 0, 0, size) if k < 4 else r.flag & 4
