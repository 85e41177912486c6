"""Queries of string functions, seeds and q-gram indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import primitives as P
from ..operators import qgram as Q
from ..operators import seeds as E
from .tables import DOCS, ITEMS, docs, items, table

SEEDS12 = f"{DOCS}, s AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 12 + 1, 16)) AS b FROM dna WHERE length(seq) >= 12), seeds AS (SELECT doc_id, b AS doc_pos, substr(seq, b + 1, 12) AS qgram FROM s)"
POST12 = f"{ITEMS}, p AS (SELECT item_id, seq, unnest(range(0, length(seq) - 12 + 1)) AS b FROM ref WHERE length(seq) >= 12), post AS (SELECT item_id, b AS item_pos, substr(seq, b + 1, 12) AS qgram FROM p)"
HITS = f"WITH {SEEDS12}, {POST12}, hits AS (SELECT doc_id, doc_pos, item_id, item_pos FROM seeds JOIN post USING (qgram))"
SNAP = "cast(ceil((doc_pos - item_pos) / 16.0 - 0.5) * 16 AS BIGINT)"


def _seeds(spark, d):
    return E.seeds(docs(spark, d), 12, 16, "doc_id").select("doc_id", F.col("begin").cast("long").alias("doc_pos"), F.col("seed").alias("qgram"))


def _post(spark, d):
    return Q.set_postings(items(spark, d), 12, 1, "item_id").select("item_id", F.col("pos").cast("long").alias("item_pos"), "qgram")


def _hits(spark, d):
    return Q.hits(_seeds(spark, d), _post(spark, d))


def symbol_counts(spark, d):
    return docs(spark, d).select("doc_id", *(S.count_of(F.col("seq"), x).alias(f"n_{x.lower()}") for x in "ACGT"))


def revcomp(spark, d):
    seq = F.col("seq")
    return docs(spark, d).select("doc_id", F.reverse(seq).alias("rev"), S.complement(seq).alias("comp"), S.reverse_complement(seq).alias("revcomp"))


def strand_set(spark, d):
    rows = docs(spark, d).select("doc_id", F.explode(S.strands(F.col("seq"))).alias("x"))
    return rows.select("doc_id", "x.strand", "x.seq")


def string_set_lengths(spark, d):
    n = F.length("seq").cast("long")
    return docs(spark, d).agg(F.count("*").alias("strings"), F.sum(n).alias("symbols"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


def infix_set(spark, d):
    rows = docs(spark, d).select("doc_id", "seq", F.explode(F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1, F.lit(100)))).alias("b"))
    end = F.least(F.col("b") + 100, F.length("seq"))
    return rows.select("doc_id", F.col("b").cast("long").alias("begin"), end.cast("long").alias("end"), S.infix(F.col("seq"), F.col("b"), end).alias("infix"))


def prefix_suffix(spark, d):
    return docs(spark, d).select("doc_id", S.prefix(F.col("seq"), 10).alias("prefix"), S.suffix(F.col("seq"), F.greatest(F.length("seq") - 10, F.lit(0))).alias("suffix"))


def symbol_codes(spark, d):
    return items(spark, d).select("item_id", F.array_join(S.symbols(F.col("seq")), "").alias("codes"), S.bases(S.symbols(F.col("seq"))).alias("back"))


def quality_costs(spark, d):
    q = (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")) % 42
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"))
    return rows.select("l_orderkey", "l_linenumber", F.col("q").cast("long").alias("q"), S.rounded_cost(F.col("q")).cast("long").alias("rounded"), S.mismatch_cost(F.col("q"), 2, 6).cast("long").alias("mismatch"))


def seeds_uniform(spark, d):
    return E.seeds(docs(spark, d), 20, 10, "doc_id").select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "seed")


def seeds_by_length(spark, d):
    rows = E.seeds(docs(spark, d), 22, S.seed_interval(F.length("seq")), "doc_id")
    return rows.select("doc_id", F.col("begin").cast("long").alias("begin"), "seed")


def seeds_retry(spark, d):
    rows = E.reseeds(docs(spark, d), 22, 12, 3, "doc_id")
    return rows.groupBy("doc_id", "retry").agg(F.count("*").alias("n"), F.sum("begin").cast("long").alias("sum_begin"), F.max("seed").alias("last_seed")).withColumn("retry", F.col("retry").cast("long"))


def qgram_encode(spark, d):
    return _seeds(spark, d).select("doc_id", "doc_pos", S.qgram_code(F.col("qgram"), 12).alias("code"))


def qgram_index(spark, d):
    """Of each item as a string of its own: zero-padded tails included."""
    post = Q.string_postings(items(spark, d), 6, "item_id")
    return post.groupBy("item_id", "qgram").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("positions"))


def qgram_set_index(spark, d):
    return Q.index(_post(spark, d)).select("qgram", "n", "begin", "end")


def qgram_slots(spark, d):
    post = _post(spark, d)
    return Q.slots(post, Q.index(post), "item_id", "item_pos").select("qgram", "item_id", "item_pos", "slot")


def qgram_range(spark, d):
    return Q.rank(_seeds(spark, d), Q.index(_post(spark, d))).select("doc_id", "doc_pos", "begin", "end")


def qgram_rank_total(spark, d):
    ranges = Q.rank(_seeds(spark, d), Q.index(_post(spark, d)))
    return ranges.agg(F.count("*").alias("queries"), F.count("n").alias("found"), F.sum("n").alias("hits"))


def qgram_locate(spark, d):
    return _hits(spark, d).select("doc_id", "doc_pos", "item_id", "item_pos")


def qgram_diagonals(spark, d):
    return _hits(spark, d).select("doc_id", "item_id", "doc_pos", Q.diagonal(F.col("doc_pos"), F.col("item_pos"), 16).alias("diag"))


def qgram_diagonal_count(spark, d):
    return Q.count_by_diagonal(_hits(spark, d), ["doc_id", "item_id"], "doc_pos", "item_pos", 16)


def qgram_best_diagonal(spark, d):
    return Q.best_diagonal(qgram_diagonal_count(spark, d), ["doc_id"], ["item_id"])


def qgram_unique(spark, d):
    return _post(spark, d).agg(F.countDistinct("qgram").alias("unique_qgrams"), F.count("*").alias("qgrams"))


def qgram_rare_hits(spark, d):
    found = Q.hits(_seeds(spark, d), _post(spark, d), max_occ=2)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


def qgram_page(spark, d):
    """Hits 500 to 999 in order."""
    found = Q.page(_hits(spark, d).select("doc_id", "doc_pos", "item_id", "item_pos"), ["doc_id", "doc_pos", "item_id", "item_pos"], 500, 1000)
    return found.withColumn("hit", F.col("hit").cast("long"))


def checksum(spark, d):
    return P.checksum(docs(spark, d), "doc_id", "seq")


_C = "list_sum(list_transform(range(0, 12), lambda j: (instr('ACGT', substr(qgram, j + 1, 1)) - 1) * (1::BIGINT << (2 * j)::INTEGER)))"
def qgroup_range(spark, d):
    """Slot ranges of the documents' seeds in a q-group index of the items."""
    words, slots = Q.group_index(_post(spark, d), 12)
    return Q.group_range(_seeds(spark, d).select("doc_id", "doc_pos", "qgram"), words, slots, 12)


_CODE12 = "list_sum(list_transform(range(0, 12), lambda j: (instr('ACGT', substr(qgram, j + 1, 1)) - 1)::BIGINT << (2 * j)))::BIGINT"
QUERIES = {
    "symbol_counts": (symbol_counts, f"WITH {DOCS} SELECT doc_id, " + ", ".join(f"(length(seq) - length(replace(seq, '{x}', '')))::BIGINT AS n_{x.lower()}" for x in "ACGT") + " FROM dna"),
    "revcomp": (revcomp, f"WITH {DOCS} SELECT doc_id, reverse(seq) AS rev, translate(seq, 'ACGT', 'TGCA') AS comp, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp FROM dna"),
    "strand_set": (strand_set, f"WITH {DOCS} SELECT doc_id, 'forward' AS strand, seq FROM dna UNION ALL SELECT doc_id, 'reverse', reverse(seq) FROM dna UNION ALL SELECT doc_id, 'forward_complement', translate(seq, 'ACGT', 'TGCA') FROM dna UNION ALL SELECT doc_id, 'reverse_complement', reverse(translate(seq, 'ACGT', 'TGCA')) FROM dna"),
    "string_set_lengths": (string_set_lengths, f"WITH {DOCS} SELECT count(*) AS strings, sum(length(seq))::BIGINT AS symbols, min(length(seq))::BIGINT AS shortest, max(length(seq))::BIGINT AS longest FROM dna"),
    "infix_set": (infix_set, f"WITH {DOCS}, b AS (SELECT doc_id, seq, unnest(range(0, length(seq), 100)) AS b FROM dna) SELECT doc_id, b AS begin, least(b + 100, length(seq))::BIGINT AS \"end\", substr(seq, b + 1, least(100, length(seq) - b)) AS infix FROM b"),
    "prefix_suffix": (prefix_suffix, f"WITH {DOCS} SELECT doc_id, substr(seq, 1, 10) AS prefix, CASE WHEN length(seq) <= 10 THEN seq ELSE right(seq, 10) END AS suffix FROM dna"),
    "symbol_codes": (symbol_codes, f"WITH {ITEMS} SELECT item_id, translate(seq, 'ACGT', '0123') AS codes, seq AS back FROM ref"),
    "quality_costs": (quality_costs, "WITH x AS (SELECT l_orderkey, l_linenumber, ((l_linenumber * 7 + l_quantity::INTEGER) % 42)::BIGINT AS q FROM lineitem) SELECT *, CASE WHEN q < 5 THEN 0 WHEN q < 15 THEN 10 WHEN q < 25 THEN 20 ELSE 30 END::BIGINT AS rounded, (2 + floor(least(q, 40) / 40.0::DOUBLE * 4))::BIGINT AS mismatch FROM x"),
    "seeds_uniform": (seeds_uniform, f"WITH {DOCS}, b AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 20 + 1, 10)) AS b FROM dna WHERE length(seq) >= 20) SELECT doc_id, b AS begin, b + 20 AS \"end\", substr(seq, b + 1, 20) AS seed FROM b"),
    "seeds_by_length": (seeds_by_length, f"WITH {DOCS}, b AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 22 + 1, greatest(1, floor(1.0::DOUBLE + 1.15::DOUBLE * sqrt(length(seq))))::BIGINT)) AS b FROM dna WHERE length(seq) >= 22) SELECT doc_id, b AS begin, substr(seq, b + 1, 22) AS seed FROM b"),
    "seeds_retry": (seeds_retry, f"WITH {DOCS}, r AS (SELECT doc_id, seq, unnest(range(3)) AS retry FROM dna), b AS (SELECT doc_id, seq, retry, unnest(range(retry * 4, length(seq) - 22 + 1, 12)) AS b FROM r WHERE length(seq) >= 22 + retry * 4) SELECT doc_id, retry, count(*) AS n, sum(b)::BIGINT AS sum_begin, max(substr(seq, b + 1, 22)) AS last_seed FROM b GROUP BY doc_id, retry"),
    "qgram_encode": (qgram_encode, f"WITH {SEEDS12} SELECT doc_id, doc_pos, {_C}::BIGINT AS code FROM seeds"),
    "qgram_index": (qgram_index, f"WITH {ITEMS}, b AS (SELECT item_id, seq || 'AAAAA' AS s, unnest(range(0, length(seq))) AS b FROM ref WHERE length(seq) > 0), g AS (SELECT item_id, b, substr(s, b + 1, 6) AS qgram FROM b) SELECT item_id, qgram, count(*) AS n, string_agg(b::VARCHAR, ',' ORDER BY b) AS positions FROM g GROUP BY item_id, qgram"),
    "qgram_set_index": (qgram_set_index, f"WITH {POST12}, u AS (SELECT qgram, count(*) AS n FROM post GROUP BY qgram), x AS (SELECT qgram, n, sum(n) OVER (ORDER BY qgram)::BIGINT AS e FROM u) SELECT qgram, n, e - n AS begin, e AS \"end\" FROM x"),
    "qgram_slots": (qgram_slots, f"WITH {POST12} SELECT qgram, item_id, item_pos, row_number() OVER (ORDER BY qgram, item_id, item_pos) - 1 AS slot FROM post"),
    "qgram_range": (qgram_range, f"WITH {SEEDS12}, {POST12}, u AS (SELECT qgram, count(*) AS n FROM post GROUP BY qgram), x AS (SELECT qgram, n, sum(n) OVER (ORDER BY qgram)::BIGINT AS e FROM u) SELECT doc_id, doc_pos, e - n AS begin, e AS \"end\" FROM seeds LEFT JOIN x USING (qgram)"),
    "qgram_rank_total": (qgram_rank_total, f"WITH {SEEDS12}, {POST12}, u AS (SELECT qgram, count(*) AS n FROM post GROUP BY qgram) SELECT count(*) AS queries, count(n) AS found, sum(n)::BIGINT AS hits FROM seeds LEFT JOIN u USING (qgram)"),
    "qgram_locate": (qgram_locate, f"{HITS} SELECT doc_id, doc_pos, item_id, item_pos FROM hits"),
    "qgram_diagonals": (qgram_diagonals, f"{HITS} SELECT doc_id, item_id, doc_pos, {SNAP} AS diag FROM hits"),
    "qgram_diagonal_count": (qgram_diagonal_count, f"{HITS} SELECT doc_id, item_id, {SNAP} AS diag, count(*) AS n FROM hits GROUP BY ALL"),
    "qgram_best_diagonal": (qgram_best_diagonal, f"{HITS}, c AS (SELECT doc_id, item_id, {SNAP} AS diag, count(*) AS n FROM hits GROUP BY ALL) SELECT doc_id, item_id, diag, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id, diag) = 1"),
    "qgram_unique": (qgram_unique, f"WITH {POST12} SELECT count(DISTINCT qgram) AS unique_qgrams, count(*) AS qgrams FROM post"),
    "qgram_page": (qgram_page, f"{HITS} SELECT doc_id, doc_pos, item_id, item_pos, row_number() OVER (ORDER BY doc_id, doc_pos, item_id, item_pos) - 1 AS hit FROM hits QUALIFY hit >= 500 AND hit < 1000"),
    "checksum": (checksum, f"WITH {DOCS} SELECT count(*) AS rows, bit_xor(('0x' || substr(md5(doc_id || chr(9) || seq), 1, 15))::BIGINT) AS sum FROM dna"),
    "qgram_rare_hits": (qgram_rare_hits, f"WITH {SEEDS12}, {POST12}, r AS (SELECT qgram FROM post GROUP BY qgram HAVING count(*) <= 2) SELECT doc_id, count(*) AS n FROM seeds JOIN post USING (qgram) SEMI JOIN r USING (qgram) GROUP BY doc_id"),
    "qgroup_range": (qgroup_range, f"WITH {SEEDS12}, {POST12}, g AS (SELECT qgram, {_CODE12} AS code, count(*) AS n FROM post GROUP BY qgram), r AS (SELECT qgram, (sum(n) OVER (ORDER BY code) - n)::BIGINT AS b, (sum(n) OVER (ORDER BY code))::BIGINT AS e FROM g) SELECT doc_id, doc_pos, qgram, b AS begin, e AS \"end\" FROM seeds LEFT JOIN r USING (qgram)"),
}
