"""Queries of readers and writers: what is written to files comes back from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import align as A
from ..operators import qgram as Q
from ..operators import suffix as X
from ..operators.hits import mapq, mapq_sql
from ..operators.storage import scratch
from ..sources import index as I
from ..sources import reads as R
from ..sources import reports as T
from ..sources import sinks as K
from ..streaming import reads as M
from .alignment import BEST2, GOTOH, PAIRS, _pairs, best2, score_sql
from .index import SET_SA, _set_sa
from .tables import DOCS, ITEMS, docs, items, table

_L = lambda c: F.col(c).cast("long").alias(c)
_REFS = [(f"ref{k}", 1 << 20) for k in range(3)]


def _reads(spark, d):
    """``name, seq, qual``: documents as reads; qualities hold the signs that begin a record and its second part."""
    rows = docs(spark, d).where("seq <> ''").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select(F.concat(F.lit("doc"), "doc_id", F.lit(" "), F.coalesce("lang", F.lit("?"))).alias("name"), "seq", F.translate("seq", "ACGT", "I5@+").alias("qual"))


READS = f"{DOCS}, reads AS (SELECT 'doc' || doc_id || ' ' || coalesce(lang, '?') AS name, seq, translate(seq, 'ACGT', 'I5@+') AS qual FROM dna JOIN documents USING (doc_id) WHERE seq <> '')"


def fastq_file(spark, d):
    path = scratch(spark, "reads.fastq")
    K.write_fastq(_reads(spark, d), path)
    return R.fastq(spark, path)


def fastq_gzip(spark, d):
    path = scratch(spark, "reads.fastq")
    K.write_fastq(_reads(spark, d), path, "gzip")
    return R.fastq(spark, path).groupBy(F.length("seq").cast("long").alias("length")).agg(F.count("*").alias("n"), F.min("name").alias("first"))


def read_file(spark, d):
    """A file of reads opened by its ending: both strands, cut to 50 symbols, as Phred values' sum."""
    path = scratch(spark, "reads.fq")
    K.write_fastq(_reads(spark, d), path)
    rows = R.reads(spark, path, ("forward", "reverse_complement"), max_len=50)
    total = F.aggregate(S.phred(F.col("qual")), F.lit(0).cast("long"), lambda a, q: a + q)
    return rows.select("name", "strand", "seq", "qual", total.alias("phred"))


def read_encoded(spark, d):
    """Qualities of older encodings, read as the usual one."""
    rows, made = _reads(spark, d), []
    for k, encoding in enumerate(("phred64", "solexa")):
        path = scratch(spark, "reads.fastq")
        K.write_fastq(rows.withColumn("qual", F.translate("seq", "ACGT", "hTBe")), path)
        made.append(R.reads(spark, path, encoding=encoding).select("name", F.lit(encoding).alias("encoding"), "qual"))
    return made[0].unionByName(made[1])


def quality_codes(spark, d):
    """Sums of Phred values by encoding, and of the rounded costs."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, q: a + q)
    kinds = [total(S.phred(F.col("qual"), k)).alias(k) for k in ("phred", "phred33", "phred64", "solexa")]
    return _reads(spark, d).select("name", *kinds, total(F.transform(S.phred(F.col("qual")), S.rounded_cost)).alias("cost"))


def fasta_file(spark, d):
    path = scratch(spark, "refs.fa")
    K.write_fasta(items(spark, d).where("seq <> ''").select(F.concat(F.lit("item"), "item_id").alias("name"), "seq"), path)
    return R.fasta(spark, path)


def fasta_unknown(spark, d):
    """Runs of symbols other than A, C, G, T in documents of which the letter N is kept."""
    rows = table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTNacgtn]", "")).alias("seq")).where("seq <> ''")
    path = scratch(spark, "refs.fa")
    K.write_fasta(rows, path)
    return R.ambiguities(R.fasta(spark, path)).select("name", _L("offset"), "len", "base")


def extracted_reads(spark, d):
    """Symbols of reads and of their reverse complements, a line each, read back and counted."""
    path = scratch(spark, "reads.txt")
    K.write_strings(_reads(spark, d), path)
    return R.text_reads(spark, path).groupBy("seq").agg(F.count("*").alias("n"))


def _alignments(spark, d):
    n, q = F.length("seq"), F.col("doc_id")
    rows = docs(spark, d).where("seq <> ''")
    i = lambda c: c.cast("int")
    return rows.select(
        F.concat(F.lit("doc"), "doc_id").alias("name"), i(F.pmod(q, F.lit(2)) * 16 + F.when(F.pmod(q, F.lit(7)) == 0, 256).otherwise(0)).alias("flag"),
        F.concat(F.lit("ref"), F.pmod(q, F.lit(3))).alias("rname"), i(q * 3 + 1).alias("pos"), i(F.pmod(q, F.lit(43))).alias("mapq"),
        F.concat(F.lit("2S"), n - 2, F.lit("M")).alias("cigar"), F.lit("=").alias("rnext"), i(q + 9).alias("pnext"), i(F.pmod(q, F.lit(11)) - 5).alias("tlen"),
        "seq", F.translate("seq", "ACGT", "I5@+").alias("qual"), i(F.pmod(q, F.lit(5))).alias("nm"), i(-F.pmod(q, F.lit(9))).alias("as"),
        F.when(F.pmod(q, F.lit(2)) == 0, i(-F.pmod(q, F.lit(4)))).alias("xs"), F.concat(n - 2, F.lit("")).alias("md"),
    ).where(F.length("seq") > 2)


_FIELDS = ["name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "nm", "as", "xs", "md"]
ALN = f"""{DOCS}, aln AS (SELECT doc_id, 'doc' || doc_id AS name, (doc_id % 2 * 16 + CASE WHEN doc_id % 7 = 0 THEN 256 ELSE 0 END)::INTEGER AS flag, 'ref' || (doc_id % 3) AS rname, (doc_id * 3 + 1)::INTEGER AS pos,
  (doc_id % 43)::INTEGER AS mapq, '2S' || (length(seq) - 2) || 'M' AS cigar, '=' AS rnext, (doc_id + 9)::INTEGER AS pnext, (doc_id % 11 - 5)::INTEGER AS tlen, seq, translate(seq, 'ACGT', 'I5@+') AS qual,
  (doc_id % 5)::INTEGER AS nm, (-(doc_id % 9))::INTEGER AS "as", (CASE WHEN doc_id % 2 = 0 THEN -(doc_id % 4) END)::INTEGER AS xs, (length(seq) - 2)::VARCHAR AS md FROM dna WHERE length(seq) > 2)"""
_COLS = ", ".join(f'"{c}"' for c in _FIELDS)


def sam_file(spark, d):
    path = scratch(spark, "out.sam")
    K.write(_alignments(spark, d), path, _REFS)
    return R.sam_alignments(spark, path).select(*(F.col(f"`{c}`") for c in _FIELDS))


def bam_file(spark, d):
    path = scratch(spark, "out.bam")
    K.write(_alignments(spark, d), path, _REFS)
    return R.bam_alignments(spark, path).select(*(F.col(f"`{c}`") for c in _FIELDS))


def sam_reads(spark, d):
    """Reads as they were sequenced, from a SAM file."""
    path = scratch(spark, "out.sam")
    K.write(_alignments(spark, d), path, _REFS)
    return R.reads(spark, path).select("name", "seq", "qual")


def debug_file(spark, d):
    """The compact form of alignments, read for a comparison."""
    path = scratch(spark, "out.dbg")
    K.write(_alignments(spark, d), path, _REFS)
    return R.debug_alignments(spark, path).select("name", "flag", "pos", "mapq", "nm", "subs", "ins", "dels", "read_len")


def _set_rows(spark, d):
    return X.set_bwt(_set_sa(spark, d), "item_id").withColumnRenamed("item_id", "string_id")


def bwt_file(spark, d):
    """A set's transform as text with its primary map: how often each symbol, and the map."""
    path = scratch(spark, "set.bwt")
    K.write_bwt(_set_rows(spark, d), path, "gzip")
    letters = spark.read.option("lineSep", "\u0000").text(path).groupBy(F.col("value").alias("symbol")).agg(F.count("*").alias("n"))
    return letters.unionByName(K.read_primary(spark, path + ".pri").select(F.concat(F.lit("$"), "string_id").alias("symbol"), F.col("sa_rank").alias("n")))


def bwt_packed(spark, d):
    """A set's transform in words of two bits a symbol, written, read and unpacked."""
    rows, path = _set_rows(spark, d), scratch(spark, "set.bwt2")
    K.write_packed_bwt(rows, path)
    total = rows.where("symbol <> '$'").count()
    return K.unpacked_bwt(spark.read.parquet(path), total)


def index_file(spark, d):
    """An index written to files and opened by part: occurrences before each block of rows, and the sampled rows."""
    path = scratch(spark, "index")
    I.build_index(items(spark, d).withColumnRenamed("item_id", "ref_id"), path)
    got = I.load_index(spark, path, ("occ", "ssa"))
    sampled = got["ssa"].groupBy(F.floor(F.col("sa_rank") / I.OCC_EVERY).alias("block")).agg(F.count("*").alias("sampled"))
    return got["occ"].join(sampled, "block", "left").select("block", *(_L(x) for x in "acgt"), F.coalesce("sampled", F.lit(0)).cast("long").alias("sampled"))


def index_served(spark, d):
    """An index as views of the application: references with offsets, and their suffixes' number."""
    path = scratch(spark, "index")
    I.build_index(items(spark, d).withColumnRenamed("item_id", "ref_id"), path)
    I.serve_index(spark, path, "served")
    other = spark.newSession()  # as another client of the application sees it
    rows = other.sql("SELECT g.ref_id, g.offset, g.length, count(*) AS suffixes FROM global_temp.served_genome g JOIN global_temp.served_sa s ON g.ref_id = s.ref_id GROUP BY ALL")
    return spark.createDataFrame(rows.collect(), rows.schema)  # a row for each reference


def scoring_file(spark, d):
    """Pairs scored by the scheme that a scoring file gives."""
    path = scratch(spark, "scores.txt")
    spark.createDataFrame([("match 2",), ("mm-penalty-max 2",), ("gap-open 5",), ("gap-ext 3",)], "value string").coalesce(1).write.text(path)
    return _pairs(spark, d).select("item_id", A.align_score("pattern", "text", R.scheme_file(spark, path), "semi_global").cast("long").alias("score"))


def read_batches(spark, d):
    """Reads in batches bounded by reads and by bases."""
    rows = R.batches(docs(spark, d), ["doc_id"], 64, 20_000)
    return rows.groupBy("batch").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), F.min("doc_id").alias("first"))


def read_stream(spark, d):
    """A stream of reads joined with the items' q-grams, batch by batch, and what the batches left."""
    folder, done = scratch(spark, "in"), scratch(spark, "out")
    docs(spark, d).where("seq <> ''").select("seq").write.text(folder)
    post = Q.set_postings(items(spark, d), 12, 1, "item_id")
    found = M.stream_hits(M.read_stream(spark, folder, 4), post, 12, 16).select("item_id", _L("pos"), "qgram")
    M.run_batches(found, scratch(spark, "state"), lambda df, k: df.write.mode("append").parquet(f"{done}/batch={k}"))
    return spark.read.schema("item_id long, pos long, qgram string").parquet(done).groupBy("item_id").agg(F.count("*").alias("hits"), F.countDistinct("qgram").alias("grams")) if _any(spark, done) else post.where("false").selectExpr("item_id", "0L AS hits", "0L AS grams")


def _any(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def run_statistics(spark, d):
    """What a run reports of its alignments, and the same rows out of the written page's table."""
    b = best2(spark, d).select(F.lit(0).alias("flag"), F.col("best_score").alias("score"), "second_score", mapq("best_score", "second_score", "1", "6").alias("mapq"))
    stats, path = T.run_statistics(b), scratch(spark, "report.html")
    T.write_html({"Run": (stats, ("section", "bin"))}, path, "Alignments")
    page = spark.read.text(path).where("value LIKE '<tr><td>%'")
    cell = lambda k: F.regexp_extract("value", r"^<tr>" + r"<td>([^<]*)</td>" * 3, k)
    return page.select(cell(1).alias("section"), cell(2).cast("long").alias("bin"), cell(3).cast("long").alias("n"))


_BIN = "CASE WHEN score - second_score <= 0 THEN 0 ELSE length(bin((score - second_score)::BIGINT)) END::BIGINT"
_SUM = lambda e: f"list_sum(list_transform(string_split(qual, ''), lambda c: {e}))::BIGINT"
_BY = lambda f: "CASE c " + " ".join(f"WHEN '{c}' THEN {f(ord(c))}" for c in "I5@+") + " END"
_BLOCKS = ", ".join(f"coalesce(sum(count(*) FILTER (prev = '{x.upper()}')) OVER (ORDER BY sa_rank // 64 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS {x}" for x in "acgt")
QUERIES = {
    "fastq_file": (fastq_file, f"WITH {READS} SELECT name, seq, qual FROM reads"),
    "fastq_gzip": (fastq_gzip, f"WITH {READS} SELECT length(seq) AS length, count(*) AS n, min(name) AS first FROM reads GROUP BY 1"),
    "read_file": (read_file, f"WITH {READS}, c AS (SELECT name, left(seq, 50) AS seq, left(qual, 50) AS qual FROM reads), b AS (SELECT name, 'forward' AS strand, seq, qual FROM c UNION ALL SELECT name, 'reverse_complement', reverse(translate(seq, 'ACGT', 'TGCA')), reverse(qual) FROM c) SELECT name, strand, seq, qual, {_SUM('ascii(c) - 33')} AS phred FROM b"),
    "read_encoded": (read_encoded, f"WITH {READS} SELECT name, 'phred64' AS encoding, translate(seq, 'ACGT', '{''.join(chr(ord(c) - 31) for c in 'hTBe')}') AS qual FROM reads UNION ALL SELECT name, 'solexa', translate(seq, 'ACGT', '{''.join(chr(min(S.solexa_step(ord(c)), 93) + 33) for c in 'hTBe')}') FROM reads"),
    "quality_codes": (quality_codes, f"WITH {READS} SELECT name, {_SUM('ascii(c)')} AS phred, {_SUM('ascii(c) - 33')} AS phred33, {_SUM('ascii(c) - 64')} AS phred64, {_SUM(_BY(S.solexa_step))} AS solexa, {_SUM(_BY(lambda c: 0 if c - 33 < 5 else 10 if c - 33 < 15 else 20 if c - 33 < 25 else 30))} AS cost FROM reads"),
    "fasta_file": (fasta_file, f"WITH {ITEMS} SELECT 'item' || item_id AS name, seq FROM ref WHERE seq <> ''"),
    "fasta_unknown": (fasta_unknown, """WITH s AS (SELECT 'doc' || doc_id AS name, upper(regexp_replace(coalesce(text, ''), '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents),
c AS (SELECT name, o FROM (SELECT name, seq, unnest(range(0, length(seq))) AS o FROM s) x WHERE substr(seq, o + 1, 1) = 'N'), g AS (SELECT name, o, o - row_number() OVER (PARTITION BY name ORDER BY o) AS i FROM c)
SELECT name, min(o) AS "offset", count(*) AS len, 'N' AS base FROM g GROUP BY name, i"""),
    "extracted_reads": (extracted_reads, f"WITH {READS}, x AS (SELECT seq FROM reads UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads) SELECT seq, count(*) AS n FROM x GROUP BY seq"),
    "sam_file": (sam_file, f"WITH {ALN} SELECT {_COLS} FROM aln"),
    "bam_file": (bam_file, f"WITH {ALN} SELECT {_COLS} FROM aln"),
    "sam_reads": (sam_reads, f"WITH {ALN} SELECT name, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual FROM aln WHERE flag & 256 = 0"),
    "debug_file": (debug_file, f"WITH {ALN} SELECT name, flag, pos, mapq, nm, length(seq) - 2 AS subs, 0::BIGINT AS ins, 0::BIGINT AS dels, length(seq) AS read_len FROM aln"),
    "bwt_file": (bwt_file, f"WITH {SET_SA} SELECT prev AS symbol, count(*) AS n FROM sa WHERE prev <> '$' GROUP BY prev UNION ALL SELECT '$' || item_id, sa_rank FROM sa WHERE prev = '$'"),
    "bwt_packed": (bwt_packed, f"WITH {SET_SA} SELECT row_number() OVER (ORDER BY sa_rank) - 1 AS at, prev AS symbol FROM sa WHERE prev <> '$'"),
    "index_file": (index_file, f"WITH {SET_SA} SELECT sa_rank // 64 AS block, {_BLOCKS}, count(*) FILTER (pos % {I.SSA_EVERY} = 0) AS sampled FROM sa GROUP BY sa_rank // 64"),
    "index_served": (index_served, f"WITH {ITEMS} SELECT item_id AS ref_id, (sum(length(seq)) OVER (ORDER BY item_id) - length(seq))::BIGINT AS \"offset\", length(seq) AS length, length(seq) + 1 AS suffixes FROM ref"),
    "scoring_file": (scoring_file, f"WITH RECURSIVE {PAIRS}, {score_sql('pairs', 'item_id', GOTOH, 'semi_global')} SELECT item_id, score FROM scored"),
    "read_batches": (read_batches, f"WITH {DOCS}, s AS (SELECT doc_id, length(seq) AS n, (row_number() OVER w - 1) // 64 AS r, (sum(length(seq)) OVER w - length(seq)) // 20000 AS b FROM dna WINDOW w AS (ORDER BY doc_id)), k AS (SELECT *, dense_rank() OVER (ORDER BY r, b) - 1 AS batch FROM s) SELECT batch, count(*) AS reads, sum(n)::BIGINT AS bases, min(doc_id) AS first FROM k GROUP BY batch"),
    "read_stream": (read_stream, f"WITH {DOCS}, {ITEMS}, s AS (SELECT substr(seq, b + 1, 12) AS g FROM (SELECT seq, unnest(range(0, length(seq) - 12 + 1, 16)) AS b FROM dna WHERE length(seq) >= 12)), p AS (SELECT item_id, substr(seq, b + 1, 12) AS g FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 12 + 1)) AS b FROM ref WHERE length(seq) >= 12)) SELECT item_id, count(*) AS hits, count(DISTINCT g) AS grams FROM s JOIN p USING (g) GROUP BY item_id"),
    "run_statistics": (run_statistics, f"""{BEST2}, q AS (SELECT best_score AS score, second_score, ({mapq_sql('best_score', 'second_score', '1', '6')})::BIGINT AS mapq FROM b2),
r AS (SELECT 'reads' AS section, 0::BIGINT AS bin FROM q UNION ALL SELECT 'mapped', 0 FROM q UNION ALL SELECT 'unique', 0 FROM q WHERE second_score IS NULL UNION ALL SELECT 'ambiguous', 0 FROM q WHERE score = second_score
 UNION ALL SELECT 'mapq', mapq FROM q UNION ALL SELECT 'score_gap', {_BIN} FROM q WHERE second_score IS NOT NULL) SELECT section, bin, count(*) AS n FROM r GROUP BY ALL"""),
}

