import gzip

import pytest

from helixframe.functions import sequence as S
from helixframe.operators import qgram as Q
from helixframe.sources import reads as R
from helixframe.sources import sinks as K
from helixframe.streaming import reads as T

FASTQ = "@r1 first\nACGT\nAC\n+\n!!!!II\n\n@r2\nNNA\n+r2\n@@@\n"
ALIGNED = [
    ("r1", 0, "chr1", 5, 40, "4M", "*", 0, 0, "ACGT", "IIII", 0, 8, None, 0, 0, 0, "4"),
    ("r2", 16, "chr2", 1, 3, "2M1D2M", "=", 9, -12, "AACCN", "*", 1, -3, -4, 0, 1, 1, "2^G2"),
    ("r3", 256, "chr1", 7, 0, "4M", "*", 0, 0, "ACGT", "IIII", None, None, None, None, None, None, None),
    ("r4", 4, "*", 0, 0, "*", "*", 0, 0, "GGG", "!!!", None, None, None, None, None, None, None),
]
COLUMNS = "name string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, nm int, `as` int, xs int, xm int, xo int, xg int, md string"
REFS = [("chr1", 100), ("chr2", 50)]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(FASTQ)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(FASTQ.encode()))
    want = [("r1 first", "ACGTAC", "!!!!II"), ("r2", "NNA", "@@@")]
    for name in ("a.fastq", "b.fastq.gz"):
        assert sorted(tuple(r) for r in R.fastq(spark, str(tmp_path / name)).collect()) == want
    got = R.reads(spark, str(tmp_path / "a.fastq"), strands=("forward", "reverse_complement"), max_len=4).collect()
    assert ("r1 first", "ACGT", "!!!!", "reverse_complement") in [tuple(r) for r in got] and len(got) == 4
    with pytest.raises(R.MalformedFile, match="line 1"):
        list(R.parse_fastq(b"ACGT\n"))


def test_fasta_and_text(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 note\nACGN\nNRAC\n>c2\nTT\n")
    refs = R.fasta(spark, str(tmp_path / "a.fa"))
    assert sorted(map(tuple, refs.collect())) == [("c1", "ACGNNRAC"), ("c2", "TT")]
    assert sorted(map(tuple, R.ambiguities(refs).collect())) == [("c1", 3, 2, "N"), ("c1", 5, 1, "R")]
    (tmp_path / "a.txt").write_text("ACGT\x01T\n\nGG \n")
    assert [r.seq for r in R.reads(spark, str(tmp_path / "a.txt")).collect()] == ["ACGTT", "GG"]
    with pytest.raises(ValueError):
        R.reads(spark, "a.xyz")


def test_sam_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ALIGNED, COLUMNS)
    K.write(df, str(tmp_path / "x.sam"), REFS)
    back = R.sam_alignments(spark, str(tmp_path / "x.sam"))
    want = sorted((*a[:-1], a[-1] or "*") for a in ALIGNED)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(want, key=str)
    reads = {r.name: (r.seq, r.qual) for r in R.reads_of(back).collect()}
    assert reads == {"r1": ("ACGT", "IIII"), "r2": ("NGGTT", None), "r4": ("GGG", "!!!")}


def test_bam_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ALIGNED, COLUMNS).repartition(2)
    K.write(df, str(tmp_path / "x.bam"), REFS)
    assert len(list((tmp_path / "x.bam").glob("part-*"))) >= 2
    for part in (tmp_path / "x.bam").glob("part-*"):
        assert part.read_bytes().endswith(K.LAST) and gzip.decompress(part.read_bytes())[:4] == b"BAM\x01"
    back = R.bam_alignments(spark, str(tmp_path / "x.bam"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(ALIGNED, key=str)
    K.write(df, "/dev/null", REFS)
    K.write(df, str(tmp_path / "x.dbg"), REFS)
    assert spark.read.parquet(str(tmp_path / "x.dbg")).count() == 4


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACG", "III"), ("b", "TT", None)], "name string, seq string, qual string")
    K.write_fastq(df, str(tmp_path / "f.fastq"))
    assert sorted(map(tuple, R.fastq(spark, str(tmp_path / "f.fastq" / "*.txt")).collect())) == [("a", "ACG", "III"), ("b", "TT", "II")]
    K.write_fasta(df, str(tmp_path / "f.fa"))
    assert sorted(map(tuple, R.fasta(spark, str(tmp_path / "f.fa")).collect())) == [("a", "ACG"), ("b", "TT")]
    K.write_strings(df, str(tmp_path / "s"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "s")).collect()) == ["AA", "ACG", "CGT", "TT"]
    rows = spark.createDataFrame([(0, "A", 1), (1, "$", 1), (2, "C", 2)], "sa_rank long, symbol string, string_id long")
    K.write_bwt(rows, str(tmp_path / "b.bwt"), "gzip")
    assert [r.value for r in spark.read.text(str(tmp_path / "b.bwt.pri")).collect()] == ["#PRI", "1 1"]
    assert [tuple(r) for r in K.read_primary(spark, str(tmp_path / "b.bwt.pri")).collect()] == [(1, 1)]
    assert [tuple(r) for r in K.packed_bwt(rows).collect()] == [(0, 1 << 28)]
    assert sorted(map(tuple, K.unpacked_bwt(K.packed_bwt(rows, 4), 2, 4).collect())) == [(0, "A"), (1, "C")]


def test_qualities(spark):
    df = spark.createDataFrame([("I!5",)], "q string")
    assert df.select(S.phred(df.q)).first()[0] == [40, 0, 20]
    table = [S.solexa_step(q) for q in range(256)]
    assert table[:21] == [0, 1, 1, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9, 10, 10] and table[255] == 245
    assert df.select(S.phred(df.q, "solexa")).first()[0] == [table[ord(c)] for c in "I!5"]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("ACGTACGTAA\nTTTTTTTT\n")
    (folder / "2.txt").write_text("GGACGTACGT\n")
    post = Q.set_postings(spark.createDataFrame([(1, "ACGTACGT")], "string_id long, seq string"), 8)
    hits = T.stream_hits(T.read_stream(spark, str(folder), 1), post, 8, 1)
    seen = []
    T.run_batches(hits, str(tmp_path / "c"), lambda df, k: seen.extend(df.collect()))
    assert sorted(r.read_pos for r in seen) == [0, 2]
    T.run_batches(hits, str(tmp_path / "c"), lambda df, k: seen.extend(df.collect()))
    assert len(seen) == 2


def test_scoring_file():
    assert R.scoring("match 2\nread-gap-const 5 x\n\n") == {"match": "2", "read-gap-const": "5"}


def test_fastq_in_small_splits(spark, tmp_path):
    """Splits end anywhere, also before quality lines that begin with the records' sign."""
    import random

    rng = random.Random(3)
    want, lines = [], []
    for k in range(400):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 30)))
        qual = "".join(rng.choice("@@@+I!") for _ in seq)
        name = f"read {k} @x" if k % 3 else f"@{k}"
        want.append((name, seq, qual))
        cut = rng.randrange(len(seq) + 1)
        lines.append(f"@{name}\n{seq[:cut]}\n{seq[cut:]}\n+\n{qual}\n" if k % 5 == 0 and seq else f"@{name}\n{seq}\n+{name if k % 4 == 0 else ''}\n{qual}\n")
    (tmp_path / "a.fastq").write_text("".join(lines))
    (tmp_path / "b.fq").write_text("\n\n" + "".join(lines[:30]).rstrip("\n"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for size in (97, 256, 5000):
            spark.conf.set(key, str(size))
            df = R.fastq(spark, str(tmp_path / "a.fastq"))
            assert sorted(map(tuple, df.collect())) == sorted(want), size
        assert sorted(map(tuple, R.fastq(spark, str(tmp_path / "b.fq")).collect())) == sorted(want[:30])
    finally:
        spark.conf.set(key, before)
    (tmp_path / "c.fq").write_text("ACGT\n")
    with pytest.raises(Exception, match="expected '@'"):
        R.fastq(spark, str(tmp_path / "c.fq")).collect()


def test_batches_and_schemes(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "repeat('A', cast(id % 7 AS int)) AS seq")
    rows = sorted(R.batches(df, ["id"], 10, 12).collect())
    for k in {r.batch for r in rows}:
        own = [r for r in rows if r.batch == k]
        assert len(own) <= 10 and sum(len(r.seq) for r in own[:-1]) < 12 + 6
    assert [r.batch for r in rows] == sorted(r.batch for r in rows) and {r.batch for r in rows} == set(range(rows[-1].batch + 1))
    (tmp_path / "s.txt").write_text("match 3\nmm-penalty-max 6\nmm-penalty-min 2\ngap-open 5\ngap-ext 3\n")
    assert R.scheme_file(spark, str(tmp_path / "s.txt")) == R.Scheme(3, -2, -5, -3, -6)
