"""Queries of suffix arrays, transforms, exact and bounded-mismatch search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as R
from ..operators import suffix as X
from ..operators.seeds import seeds
from .tables import DOCS, ITEMS, docs, items

_L = lambda c: F.col(c).cast("long").alias(c)
#: The suffixes of each item in order, rank 0 the empty one.
SA = f"""{ITEMS}, sfx AS (SELECT item_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM ref),
sa AS (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY substr(seq, pos + 1)) - 1 AS sa_rank, CASE WHEN pos = 0 THEN '$' ELSE substr(seq, pos, 1) END AS prev FROM sfx)"""
SET_SA = f"""{ITEMS}, sfx AS (SELECT item_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM ref),
sa AS (SELECT item_id, pos, row_number() OVER (ORDER BY substr(seq, pos + 1), item_id) - 1 AS sa_rank, CASE WHEN pos = 0 THEN '$' ELSE substr(seq, pos, 1) END AS prev FROM sfx)"""
PATTERNS = f"{DOCS}, pb AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 8 + 1, 50)) AS b FROM dna WHERE length(seq) >= 8), pat AS (SELECT doc_id, b, substr(seq, b + 1, 8) AS pattern FROM pb)"
WIN8 = "w AS (SELECT item_id, b AS text_pos, substr(seq, b + 1, 8) AS pattern FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 8 + 1)) AS b FROM ref WHERE length(seq) >= 8))"


def _sa(spark, d):
    return X.string_suffix_array(items(spark, d), "item_id").select("item_id", _L("pos"), "sa_rank", "prev")


def _set_sa(spark, d):
    return X.suffix_array(items(spark, d), "item_id").select("item_id", _L("pos"), "sa_rank", "prev")


def _patterns(spark, d):
    return seeds(docs(spark, d), 8, 50, "doc_id").select("doc_id", _L("begin"), F.col("seed").alias("pattern"))


def _texts(spark, d):
    return items(spark, d).withColumnRenamed("item_id", "text_id")


def suffix_array(spark, d):
    return _sa(spark, d).select("item_id", "pos", "sa_rank")


def set_suffix_array(spark, d):
    return _set_sa(spark, d).select("item_id", "pos", "sa_rank")


def docs_suffix_array(spark, d):
    """Of all documents: sorted in ranges where every task can hold the set, else ranks by doubling."""
    rows = docs(spark, d)
    found = X.sorted_suffixes(rows, "doc_id", prev=False)
    return (X.suffix_array(rows, "doc_id") if found is None else found).select("doc_id", _L("pos"), "sa_rank")


def bwt(spark, d):
    return X.bwt(_sa(spark, d), "item_id")


def set_bwt(spark, d):
    return X.set_bwt(_set_sa(spark, d), "item_id")


def find_primary(spark, d):
    return _sa(spark, d).where("pos = 0").select("item_id", F.col("sa_rank").alias("primary"))


def occ_table(spark, d):
    return X.occurrences(_sa(spark, d), 16, ["item_id"]).select("item_id", _L("block"), *(_L(x) for x in "acgt"))


def rank_queries(spark, d):
    return X.rank_all(_sa(spark, d), ["item_id"]).select("item_id", "sa_rank", *(_L(f"rank_{x}") for x in "acgt"))


def lf_mapping(spark, d):
    return X.lf(_sa(spark, d), ["item_id"]).select("item_id", "sa_rank", "lf")


def ssa_value(spark, d):
    return X.sample_by_value(_sa(spark, d), 8).select("item_id", "sa_rank", "pos")


def ssa_index(spark, d):
    return X.sample_by_row(_sa(spark, d), 8).select("item_id", "sa_rank", "pos")


def fm_count(spark, d):
    p = _patterns(spark, d).withColumn("pattern_id", F.struct("doc_id", "begin"))
    return R.count(p, _texts(spark, d)).select("pattern_id.doc_id", "pattern_id.begin", "n")


def fm_range(spark, d):
    return R.sa_ranges(_patterns(spark, d), _texts(spark, d), _set_sa(spark, d).withColumnRenamed("item_id", "text_id"))


def fm_locate(spark, d):
    return R.locate(_patterns(spark, d), _texts(spark, d)).select("doc_id", "begin", F.col("text_id").alias("item_id"), _L("text_pos"))


def fm_match_reverse(spark, d):
    p = _patterns(spark, d).withColumn("pattern_id", F.struct("doc_id", "begin"))
    return R.match_reverse(p, _texts(spark, d)).select("pattern_id.doc_id", "pattern_id.begin", "n")


def _long_patterns(spark, d):
    return seeds(docs(spark, d), 16, 40, "doc_id").select(F.struct("doc_id", _L("begin")).alias("pattern_id"), F.col("seed").alias("pattern"))


def hamming_match(spark, d):
    found = R.hamming(_long_patterns(spark, d), _texts(spark, d), 16, 8, 3)
    return found.select("pattern_id.doc_id", "pattern_id.begin", F.col("text_id").alias("item_id"), _L("text_pos"), "mismatches")


def one_mismatch(spark, d):
    found = R.approximate(_long_patterns(spark, d), _texts(spark, d), 16)
    return found.select("pattern_id.doc_id", "pattern_id.begin", F.col("text_id").alias("item_id"), _L("text_pos"), "mismatches")


def mem(spark, d):
    reads = docs(spark, d).withColumnRenamed("doc_id", "read_id")
    return R.mems(reads, _texts(spark, d), 12).select(F.col("read_id").alias("doc_id"), F.col("text_id").alias("item_id"), "begin", "end", "text_pos")


def mem_frequent(spark, d):
    """Longest matches that occur twice or more in the items, of 13 symbols or more."""
    reads = docs(spark, d).withColumnRenamed("doc_id", "read_id")
    found = R.mems(reads, _texts(spark, d), 12, min_count=2, min_span=13)
    return found.groupBy(F.col("read_id").alias("doc_id"), "begin", "end").agg(F.count("*").alias("n"), F.min(F.struct("text_id", "text_pos")).alias("x")).select("doc_id", "begin", "end", "n", F.col("x.text_id").alias("item_id"), F.col("x.text_pos").alias("text_pos"))


def rank_two_ended(spark, d):
    """Symbols before the begin and the end of each item's middle half of rows."""
    sa = _sa(spark, d)
    ranges = sa.groupBy("item_id").agg(F.floor(F.max("sa_rank") / 4).alias("begin"), F.floor(F.max("sa_rank") * 3 / 4).alias("end"))
    return X.rank_range(sa, ranges, ["item_id"]).select("item_id", "begin", "end", *(_L(f"{s}_{x}") for s in ("begin", "end") for x in "acgt"))


def inv_psi_walk(spark, d):
    return X.walk_to_sample(_sa(spark, d), 8, ["item_id"])


def ssa_lookup(spark, d):
    sa = _sa(spark, d)
    return X.look_up(X.walk_to_sample(sa, 8, ["item_id"]), X.sample_by_value(sa, 8), ["item_id"]).select("item_id", "sa_rank", _L("pos"))


def whole_read(spark, d):
    """Items as reads, exact on both strands, in the documents."""
    reads = items(spark, d)
    texts = docs(spark, d).select(F.col("doc_id").alias("text_id"), F.col("seq").alias("text_seq"))
    return R.whole_reads(reads, texts).select("item_id", "strand", F.col("text_id").alias("doc_id"), _L("text_pos"))


_RANKS = ", ".join(f"count(*) FILTER (prev = '{x}') OVER (PARTITION BY item_id ORDER BY sa_rank) AS rank_{x.lower()}" for x in "ACGT")
_LONG = f"{DOCS}, pb AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 16 + 1, 40)) AS b FROM dna WHERE length(seq) >= 16), pat AS (SELECT doc_id, b AS begin, substr(seq, b + 1, 16) AS p FROM pb), {ITEMS}, w AS (SELECT item_id, b AS text_pos, substr(seq, b + 1, 16) AS t FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 16 + 1)) AS b FROM ref WHERE length(seq) >= 16))"
QUERIES = {
    "suffix_array": (suffix_array, f"WITH {SA} SELECT item_id, pos, sa_rank FROM sa"),
    "set_suffix_array": (set_suffix_array, f"WITH {SET_SA} SELECT item_id, pos, sa_rank FROM sa"),
    "docs_suffix_array": (docs_suffix_array, f"WITH {DOCS}, sfx AS (SELECT doc_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM dna) SELECT doc_id, pos, row_number() OVER (ORDER BY substr(seq, pos + 1), doc_id) - 1 AS sa_rank FROM sfx"),
    "bwt": (bwt, f"WITH {SA} SELECT item_id, coalesce(string_agg(prev, '' ORDER BY sa_rank) FILTER (prev <> '$'), '') AS bwt, max(sa_rank) FILTER (prev = '$') AS \"primary\" FROM sa GROUP BY item_id"),
    "set_bwt": (set_bwt, f"WITH {SET_SA} SELECT sa_rank, prev AS symbol, item_id FROM sa"),
    "find_primary": (find_primary, f"WITH {ITEMS}, s AS (SELECT item_id, seq, unnest(range(0, length(seq) + 1)) AS pos FROM ref) SELECT item_id, count(*) FILTER (substr(seq, pos + 1) < seq) AS \"primary\" FROM s GROUP BY item_id"),
    "occ_table": (occ_table, f"WITH {SA}, c AS (SELECT item_id, sa_rank // 16 AS block, " + ", ".join(f"count(*) FILTER (prev = '{x}') AS {x.lower()}" for x in "ACGT") + " FROM sa GROUP BY ALL) SELECT item_id, block, " + ", ".join(f"coalesce(sum({x}) OVER (PARTITION BY item_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS {x}" for x in "acgt") + " FROM c"),
    "rank_queries": (rank_queries, f"WITH {SA} SELECT item_id, sa_rank, {_RANKS} FROM sa"),
    "lf_mapping": (lf_mapping, f"WITH {SA} SELECT a.item_id, a.sa_rank, b.sa_rank AS lf FROM sa a LEFT JOIN sa b ON a.item_id = b.item_id AND b.pos = a.pos - 1"),
    "ssa_value": (ssa_value, f"WITH {SA} SELECT item_id, sa_rank, pos FROM sa WHERE pos % 8 = 0"),
    "ssa_index": (ssa_index, f"WITH {SA} SELECT item_id, sa_rank, pos FROM sa WHERE sa_rank % 8 = 0"),
    "fm_count": (fm_count, f"WITH {PATTERNS}, {ITEMS}, {WIN8}, c AS (SELECT pattern, count(*) AS n FROM w GROUP BY pattern) SELECT doc_id, b AS begin, coalesce(n, 0) AS n FROM pat LEFT JOIN c USING (pattern)"),
    "fm_range": (fm_range, f"WITH {PATTERNS}, {SET_SA}, r AS (SELECT substr(seq, pos + 1, 8) AS pattern, min(sa_rank) AS lo, max(sa_rank) AS hi FROM sa JOIN ref USING (item_id) WHERE length(seq) - pos >= 8 GROUP BY 1) SELECT pattern, lo AS begin, hi + 1 AS \"end\" FROM r WHERE pattern IN (SELECT pattern FROM pat)"),
    "fm_locate": (fm_locate, f"WITH {PATTERNS}, {ITEMS}, {WIN8} SELECT doc_id, b AS begin, item_id, text_pos FROM pat JOIN w USING (pattern)"),
    "fm_match_reverse": (fm_match_reverse, f"WITH {PATTERNS}, {ITEMS}, {WIN8}, c AS (SELECT pattern, count(*) AS n FROM w GROUP BY pattern) SELECT doc_id, b AS begin, coalesce(n, 0) AS n FROM pat LEFT JOIN c ON reverse(pat.pattern) = c.pattern"),
    "hamming_match": (hamming_match, f"WITH {_LONG} SELECT doc_id, begin, item_id, text_pos, hamming(p, t)::BIGINT AS mismatches FROM pat JOIN w ON right(p, 8) = right(t, 8) WHERE hamming(p, t) <= 3"),
    "one_mismatch": (one_mismatch, f"WITH {_LONG}, x AS (SELECT doc_id, begin, item_id, text_pos, hamming(p, t)::BIGINT AS mismatches FROM pat JOIN w ON right(p, 8) = right(t, 8) UNION SELECT doc_id, begin, item_id, text_pos, hamming(p, t)::BIGINT FROM pat JOIN w ON left(p, 8) = left(t, 8)) SELECT * FROM x WHERE mismatches <= 1"),
    "mem": (mem, f"""WITH {DOCS}, {ITEMS},
a AS (SELECT doc_id, i, substr(seq, i + 1, 12) AS g FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 12 + 1)) AS i FROM dna WHERE length(seq) >= 12)),
b AS (SELECT item_id, j, substr(seq, j + 1, 12) AS g FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 12 + 1)) AS j FROM ref WHERE length(seq) >= 12)),
x AS (SELECT doc_id, item_id, i, j - i AS d, i - row_number() OVER (PARTITION BY doc_id, item_id, j - i ORDER BY i) AS island FROM a JOIN b USING (g)),
s AS (SELECT doc_id, item_id, d, min(i) AS b, max(i) + 12 AS e FROM x GROUP BY doc_id, item_id, d, island)
SELECT doc_id, item_id, b AS begin, e AS "end", b + d AS text_pos FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.b <= s.b AND o.e >= s.e AND (o.b < s.b OR o.e > s.e))"""),
    "mem_frequent": (mem_frequent, f"""WITH {DOCS}, {ITEMS},
a AS (SELECT doc_id, i, substr(seq, i + 1, 12) AS g FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 12 + 1)) AS i FROM dna WHERE length(seq) >= 12)),
b AS (SELECT item_id, j, substr(seq, j + 1, 12) AS g FROM (SELECT item_id, seq, unnest(range(0, length(seq) - 12 + 1)) AS j FROM ref WHERE length(seq) >= 12)),
x AS (SELECT doc_id, item_id, i, j - i AS d, i - row_number() OVER (PARTITION BY doc_id, item_id, j - i ORDER BY i) AS island FROM a JOIN b USING (g)),
s AS (SELECT doc_id, item_id, d, min(i) AS b, max(i) + 12 AS e FROM x GROUP BY doc_id, item_id, d, island),
p AS (SELECT DISTINCT l.doc_id, l.b, r.e FROM s l JOIN s r ON l.doc_id = r.doc_id AND r.e - l.b >= 13), f AS (SELECT p.doc_id, p.b, p.e, count(*) AS n, min((item_id, p.b + d)) AS x FROM p JOIN s ON s.doc_id = p.doc_id AND s.b <= p.b AND s.e >= p.e GROUP BY p.doc_id, p.b, p.e HAVING count(*) >= 2)
SELECT doc_id, b AS begin, e AS "end", n, x[1] AS item_id, x[2] AS text_pos FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.b <= f.b AND o.e >= f.e AND (o.b < f.b OR o.e > f.e))"""),
    "rank_two_ended": (rank_two_ended, f"WITH {SA}, r AS (SELECT item_id, max(sa_rank) // 4 AS b, max(sa_rank) * 3 // 4 AS e FROM sa GROUP BY item_id) SELECT item_id, b AS begin, e AS \"end\", " + ", ".join(f"count(*) FILTER (prev = '{x.upper()}' AND sa_rank < {s[0]}) AS {s}_{x}" for s in ("begin", "end") for x in "acgt") + " FROM sa JOIN r USING (item_id) GROUP BY item_id, b, e"),
    "inv_psi_walk": (inv_psi_walk, f"WITH {SA} SELECT a.item_id, a.sa_rank, b.sa_rank AS at, a.pos % 8 AS steps FROM sa a JOIN sa b ON a.item_id = b.item_id AND b.pos = a.pos - a.pos % 8"),
    "ssa_lookup": (ssa_lookup, f"WITH {SA} SELECT item_id, sa_rank, pos FROM sa"),
    "whole_read": (whole_read, f"WITH {DOCS}, {ITEMS}, r AS (SELECT item_id, seq, 'forward' AS strand FROM ref WHERE seq <> '' UNION ALL SELECT item_id, reverse(translate(seq, 'ACGT', 'TGCA')), 'reverse_complement' FROM ref WHERE seq <> ''), l AS (SELECT DISTINCT length(seq) AS n FROM r), w AS (SELECT doc_id, n, unnest(range(0, length(seq) - n + 1)) AS b, seq FROM dna, l WHERE length(seq) >= n), g AS (SELECT doc_id, b, substr(seq, b + 1, n) AS seq FROM w) SELECT item_id, strand, doc_id, b AS text_pos FROM r JOIN g USING (seq)"),
}
