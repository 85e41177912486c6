"""Queries of pairwise alignment, hit reduction, mapping quality, SAM fields and comparison reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import align as A
from ..operators import aligner as G
from ..operators import diff as D
from ..operators import hits as H
from ..operators import qgram as Q
from ..operators import seeds as E
from ..operators.storage import cut
from .strings import HITS, SNAP, qgram_diagonal_count
from .tables import DOCS, ITEMS, docs, items

_L = lambda c: F.col(c).cast("long").alias(c)
GOTOH = A.Scheme(2, -2, -5, -3)


def _pairs(spark, d):
    """``item_id, other, pattern, text``: each item with the next one."""
    ref = items(spark, d)
    return ref.join(ref.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("text")), "item_id").withColumnRenamed("seq", "pattern")


PAIRS = f"{ITEMS}, pairs AS (SELECT a.item_id, a.seq AS pattern, b.seq AS text FROM ref a JOIN ref b ON b.item_id = a.item_id + 1)"


def _candidates(spark, d, least=2):
    """``doc_id, item_id, diag, pattern, text``: diagonals with ``least`` shared seeds, with the document's
    window around the item."""
    found = qgram_diagonal_count(spark, d).where(F.col("n") >= least)
    both = found.join(items(spark, d).withColumnRenamed("seq", "pattern"), "item_id").withColumn("ref_id", F.col("doc_id"))
    refs, most = docs(spark, d).withColumnRenamed("doc_id", "ref_id"), items(spark, d).agg(F.max(F.length("seq"))).first()[0] or 0
    cases = G.windows(both, refs, F.greatest(F.col("diag") - 16, F.lit(0)), F.length("pattern") + 48, most + 48)
    return cases.select("doc_id", "item_id", "diag", "n", "pattern", "begin", "text").where("text <> ''")


def score_sql(pairs: str, keys: str, scheme: A.Scheme, kind: str, quality: bool = False) -> str:
    """Recursive tables for DuckDB that score ``pattern`` with ``text`` for the rows of table ``pairs``: ``dp``
    goes through the text a symbol at a time with a row of the matrix as a list, ``scored`` has ``keys`` and
    ``score``.  Semi-global and local; ``j`` counts from 1, the border.  With ``quality`` the table also has
    ``qual``, and must have it among the keys."""
    go, ge, local = scheme.gap_open, scheme.gap_ext, kind == "local"
    miss = f"({scheme.mismatch} + trunc(least(ascii(substr(qual, j - 1, 1)) - 33, 40) / 40.0 * ({scheme.mismatch_most} - {scheme.mismatch})))::BIGINT" if quality else str(scheme.mismatch)
    first = "0" if local else f"CASE WHEN j = 0 THEN 0 ELSE {go} + {ge} * (j - 1) END"
    clamp = "0, " if local else ""
    end = "list_max(nh)" if local else "nh[length(pattern) + 1]"
    return f"""dp AS (
  SELECT {keys}, pattern, text, 0 AS i, list_transform(range(0, length(pattern) + 1), lambda j: ({first})::BIGINT) AS h,
    list_transform(range(0, length(pattern) + 1), lambda j: -1000000::BIGINT) AS f, (CASE WHEN {str(local).lower()} OR length(pattern) = 0 THEN 0 ELSE {go} + {ge} * (length(pattern) - 1) END)::BIGINT AS best FROM {pairs}
  UNION ALL
  SELECT {keys}, pattern, text, i + 1, nh, nf, greatest(best, {end}) FROM (
    SELECT *, list_transform(range(1, length(pattern) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(tmp[j], list_max(list_transform(range(1, j), lambda k: tmp[k] + {go} + {ge} * (j - k - 1)))) END) AS nh FROM (
      SELECT *, list_transform(range(1, length(pattern) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest({clamp}nf[j], h[j - 1] + CASE WHEN substr(pattern, j - 1, 1) = substr(text, i + 1, 1) THEN {scheme.match} ELSE {miss} END) END) AS tmp FROM (
        SELECT *, list_transform(range(1, length(pattern) + 2), lambda j: greatest(h[j] + {go}, f[j] + {ge})) AS nf FROM dp WHERE i < length(text)) x) y) z),
scored AS (SELECT {keys}, best AS score FROM dp WHERE i = length(text))"""


def banded_sql(pairs: str, keys: str, band: int) -> str:
    """The same for the semi-global edit distance within a band: the text is ahead by 0 to ``band`` - 1 symbols."""
    low, ok = -1000000, f"(i + 1 - (j - 1) >= 0 AND i + 1 - (j - 1) < {band})"
    return f"""dp AS (
  SELECT {keys}, pattern, text, 0 AS i, list_transform(range(0, length(pattern) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE {low} END::BIGINT) AS h, (CASE WHEN length(pattern) = 0 THEN 0 ELSE {low} END)::BIGINT AS best FROM {pairs}
  UNION ALL
  SELECT {keys}, pattern, text, i + 1, nh, greatest(best, nh[length(pattern) + 1]) FROM (
    SELECT *, list_transform(range(1, length(pattern) + 2), lambda j: CASE WHEN NOT {ok} THEN {low} WHEN j = 1 THEN 0 ELSE greatest(tmp[j], list_max(list_transform(range(1, j), lambda k: tmp[k] - (j - k)))) END) AS nh FROM (
      SELECT *, list_transform(range(1, length(pattern) + 2), lambda j: CASE WHEN NOT {ok} THEN {low} WHEN j = 1 THEN 0 ELSE greatest(h[j] - 1, h[j - 1] - CASE WHEN substr(pattern, j - 1, 1) = substr(text, i + 1, 1) THEN 0 ELSE 1 END) END) AS tmp FROM dp WHERE i < length(text)) x) y),
scored AS (SELECT {keys}, CASE WHEN best > {low} // 2 THEN best END AS score FROM dp WHERE i = length(text))"""


def trace_sql(keys: str, scheme: A.Scheme) -> str:
    """Tables after the ``dp`` of a local ``score_sql``: ``walked`` goes back from the last best cell, ``traced`` has
    ``keys, score``, the places, ``cigar``, ``md`` and ``ed``."""
    go, ge = scheme.gap_open, scheme.gap_ext
    on = f"e1 + {ge} > h1 + {go}"
    same = [f"{{0}}.{k.strip()} = {{1}}.{k.strip()}" for k in keys.split(",")]
    meet = lambda a, b: " AND ".join(x.format(a, b) for x in same)
    of = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    insert = lambda j: f"list_max(list_transform(range(1, {j}), lambda k: r.h[k] + {go} + {ge} * ({j} - k - 1)))"
    return f"""tops AS (SELECT *, list_max(h[2:]) AS top FROM dp WHERE i > 0 AND length(pattern) > 0),
ends AS (SELECT {keys}, pattern, text, i, top, list_max(list_filter(range(2, length(pattern) + 2), lambda j: h[j] = top)) AS j FROM tops QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY top DESC, i DESC) = 1),
walked AS (
  SELECT {keys}, pattern, text, i, j, NULL::VARCHAR AS state, '' AS steps, false AS done, top AS score, i AS te, j AS pe FROM ends
  UNION ALL
  SELECT {keys}, pattern, text, CASE WHEN way IN ('M', 'D') THEN i - 1 ELSE i END, CASE WHEN way IN ('M', 'I') THEN j - 1 ELSE j END,
    CASE WHEN way = 'I' AND e_on THEN 'I' WHEN way = 'D' AND f_on THEN 'D' END, CASE WHEN way = 'S' THEN steps ELSE way || steps END, way = 'S', score, te, pe FROM (
    SELECT *, coalesce(state, CASE WHEN h0 <= 0 THEN 'S' WHEN f0 > e0 THEN CASE WHEN f0 > diag THEN 'D' ELSE 'M' END WHEN e0 > diag THEN 'I' ELSE 'M' END) AS way, coalesce({on}, false) AS e_on, f1 + {ge} > hu + {go} AS f_on FROM (
      SELECT {of('w')}, w.pattern, w.text, w.i, w.j, w.state, w.steps, w.score, w.te, w.pe, r.h[w.j] AS h0, r.f[w.j] AS f0, {insert('w.j')} AS e0, {insert('(w.j - 1)')} AS e1, r.h[w.j - 1] AS h1, q.f[w.j] AS f1, q.h[w.j] AS hu,
        q.h[w.j - 1] + CASE WHEN substr(w.pattern, w.j - 1, 1) = substr(w.text, w.i, 1) THEN {scheme.match} ELSE {scheme.mismatch} END AS diag
      FROM walked w JOIN dp r ON {meet('w', 'r')} AND r.i = w.i JOIN dp q ON {meet('w', 'q')} AND q.i = w.i - 1 WHERE NOT w.done AND w.j > 1) x) y),
last AS (SELECT *, i AS tb, j - 1 AS pb FROM walked QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY length(steps) DESC, done DESC) = 1),
marked AS (
  SELECT {keys}, pattern, text, steps, 1 AS k, tb AS i, pb AS j, 0 AS same, false AS gap, '' AS md, 0 AS ed FROM last
  UNION ALL
  SELECT {keys}, pattern, text, steps, k + 1, CASE WHEN s = 'I' THEN i ELSE i + 1 END, CASE WHEN s = 'D' THEN j ELSE j + 1 END,
    CASE WHEN s = 'M' AND eq THEN same + 1 WHEN s = 'I' THEN same ELSE 0 END, s = 'D',
    md || CASE WHEN s = 'M' AND NOT eq THEN same || substr(text, i + 1, 1) WHEN s = 'D' THEN CASE WHEN gap THEN substr(text, i + 1, 1) ELSE same || '^' || substr(text, i + 1, 1) END ELSE '' END,
    ed + CASE WHEN s = 'M' AND eq THEN 0 ELSE 1 END FROM (SELECT *, substr(steps, k, 1) AS s, substr(pattern, j + 1, 1) = substr(text, i + 1, 1) AS eq FROM marked WHERE k <= length(steps)) x),
noted AS (SELECT {keys}, md || same AS md, ed FROM marked WHERE k = length(steps) + 1),
traced AS (SELECT {of('l')}, score, tb AS text_begin, te AS text_end, pb AS pattern_begin, pe - 1 AS pattern_end,
  CASE WHEN pb > 0 THEN pb || 'S' ELSE '' END || array_to_string(list_transform(regexp_extract_all(steps, 'M+|I+|D+'), lambda x: length(x) || x[1]), '') || CASE WHEN length(pattern) > pe - 1 THEN (length(pattern) - pe + 1) || 'S' ELSE '' END AS cigar, md, ed FROM last l JOIN noted n ON {meet('l', 'n')})"""


def edit_distance_global(spark, d):
    return _pairs(spark, d).select("item_id", A.align_score("pattern", "text", A.EDIT, "global").cast("long").alias("score"))


def edit_distance_semiglobal(spark, d):
    return _pairs(spark, d).select("item_id", A.align_score("pattern", "text", A.EDIT, "semi_global").cast("long").alias("score"))


def edit_distance_banded(spark, d):
    return _pairs(spark, d).select("item_id", A.align_score("pattern", "text", A.EDIT, "semi_global", 31).cast("long").alias("score"))


def sw_local(spark, d):
    return _pairs(spark, d).select("item_id", A.align_score("pattern", "text", A.Scheme(2, -1, -1, -1), "local").cast("long").alias("score"))


def gotoh_semiglobal(spark, d):
    return _pairs(spark, d).select("item_id", A.align_score("pattern", "text", GOTOH, "semi_global").cast("long").alias("score"))


def _traced(rows, **more):
    names = ("score", "text_begin", "text_end", "pattern_begin", "pattern_end", "ed")
    return rows.select("item_id", A.align("pattern", "text", GOTOH, "local", **more).alias("a")).select("item_id", *(F.col(f"a.{c}").cast("long").alias(c) for c in names), "a.cigar", "a.md")


def cigar(spark, d):
    """Local alignments of pairs of items that are not empty, with their paths."""
    return _traced(_pairs(spark, d).where("pattern <> '' AND text <> ''"))


#: Mismatches cost two to six by quality.
QUALITY = A.Scheme(2, -2, -5, -3, mismatch_most=-6)


def _qualities(pattern):
    return F.translate(pattern, "ACGT", "I5+!")


def gotoh_quality(spark, d):
    """Mismatches scaled by the qualities of the pattern's symbols."""
    return _pairs(spark, d).select("item_id", A.align_score("pattern", "text", QUALITY, "semi_global", quality=_qualities(F.col("pattern"))).cast("long").alias("score"))


def qmap(spark, d):
    """Items mapped to documents by q-gram counts, then aligned; the best score of each document."""
    scored = _candidates(spark, d).withColumn("score", A.align_score("pattern", "text", A.EDIT, "semi_global"))
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("item_id")).alias("i"), (-F.col("diag")).alias("g"))).alias("b")).select("doc_id", (-F.col("b.i")).alias("item_id"), (-F.col("b.g")).alias("diag"), F.col("b.score").cast("long").alias("score"))


def fmmap(spark, d):
    """Items on both strands as reads: seeds located in the documents, diagonals aligned, the best score of
    each item over both strands, and how many items reach each score."""
    reads = items(spark, d).select("item_id", F.explode(S.strands(F.col("seq"), ("forward", "reverse_complement"))).alias("x"))
    reads = reads.select(F.struct("item_id", "x.strand").alias("read"), F.col("x.seq").alias("pattern"))
    seeds = E.seeds(reads, 16, 8, "read", "pattern").select("read", F.col("begin").alias("q"), F.col("seed").alias("qgram"))
    post = Q.set_postings(docs(spark, d), 16, 1, "doc_id")
    found = Q.hits(seeds, post).select("read", "doc_id", Q.diagonal(F.col("pos"), F.col("q"), 16).alias("diag")).distinct()
    both = found.join(reads, "read").join(docs(spark, d), "doc_id")
    begin = F.greatest(F.col("diag") - 16, F.lit(0)).cast("int")
    cases = both.select("read.item_id", "pattern", S.infix(F.col("seq"), begin, begin + F.length("pattern") + 48).alias("text")).where("text <> ''").distinct()
    best = cases.withColumn("score", A.align_score("pattern", "text", A.EDIT, "semi_global")).groupBy("item_id").agg(F.max("score").alias("score"))
    return best.groupBy("score").agg(F.count("*").alias("items")).select(_L("score"), "items")


def _scored(spark, d):
    """Alignments scored without Python: matching seeds, on the strand the diagonal's parity names."""
    c = qgram_diagonal_count(spark, d)
    strand = F.when(F.pmod(F.col("item_id"), F.lit(2)) == 0, "+").otherwise("-")
    return c.select("doc_id", F.col("n").alias("score"), F.greatest(F.col("diag"), F.lit(0)).alias("pos"), strand.alias("strand"), "item_id")


SCORED = f"{HITS}, c AS (SELECT doc_id, item_id, {SNAP} AS diag, count(*) AS n FROM hits GROUP BY ALL), sc AS (SELECT doc_id, n AS score, greatest(diag, 0) AS pos, CASE WHEN item_id % 2 = 0 THEN '+' ELSE '-' END AS strand, item_id FROM c)"


def best2(spark, d):
    return H.best_two(_scored(spark, d), "doc_id", 50)


BEST2 = f"""{SCORED}, t AS (SELECT doc_id, score AS best_score, pos AS best_pos, strand AS best_strand FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, strand) = 1),
s2 AS (SELECT doc_id, score AS second_score, pos AS second_pos, strand AS second_strand FROM sc JOIN t USING (doc_id) WHERE strand <> best_strand OR abs(pos - best_pos) > 50 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, strand) = 1),
b2 AS (SELECT * FROM t LEFT JOIN s2 USING (doc_id))"""


def mapq(spark, d):
    rows = best2(spark, d)
    return rows.select("doc_id", H.mapq("best_score", "second_score", "1", "6").cast("long").alias("mapq"), H.mapq("best_score", "second_score", "1", "6", local=True).cast("long").alias("mapq_local"))


def topk_hits(spark, d):
    return H.select_hits(qgram_diagonal_count(spark, d), "doc_id", 3, "n", "diag").withColumn("rank", _L("rank")).groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("n").alias("rarest"))


def reseed(spark, d):
    reads = docs(spark, d).select("doc_id")
    return H.needs_reseed(qgram_diagonal_count(spark, d), reads, "doc_id", "n", 3).select("doc_id")


def prune_search(spark, d):
    return H.prune(docs(spark, d).select("doc_id"), qgram_diagonal_count(spark, d).select("doc_id"), "doc_id")


def coord_to_refseq(spark, d):
    """Places in the items' concatenation back to items."""
    from ..operators.primitives import scan

    ref = scan(items(spark, d).select("item_id", F.length("seq").cast("long").alias("length")), ["item_id"], F.col("length"), "offset", exclusive=True)
    ref = ref.where("length > 0").select(F.col("item_id").alias("ref_id"), "offset", "length")
    total = items(spark, d).agg(F.sum(F.length("seq"))).first()[0] or 0
    hits = docs(spark, d).select("doc_id", F.pmod(F.col("doc_id") * 7919, F.lit(max(total, 1))).alias("pos"), F.lit(20).cast("long").alias("length"))
    return H.to_reference(hits, ref).select("doc_id", "pos", "ref_id", "ref_pos", "bridges")


def pair_hits(spark, d):
    """Pairs of hits of a document as anchors (items of even number) and mates (odd) within 200 symbols."""
    s = _scored(spark, d).select("doc_id", F.lit(0).alias("ref_id"), "pos", "strand", "score", F.lit(16).cast("long").alias("length"))
    found = H.pair_up(s.where("strand = '+'"), s.where("strand = '-'"), "doc_id", 200)
    return found.select("doc_id", "a_pos", "o_pos", "score", H.template_length(F.col("a_pos"), F.col("a_pos") + F.col("a_length"), F.col("o_pos"), F.col("o_pos") + F.col("o_length"), F.lit(True)).alias("tlen"))


def sam_records(spark, d):
    """Best alignments as SAM lines."""
    b = best2(spark, d)
    q = H.mapq("best_score", "second_score", "1", "6")
    flag = H.sam_flags(reverse=F.col("best_strand") == "-", unmapped=q == 0)
    line = H.sam_line(F.concat(F.lit("doc"), "doc_id"), flag, F.lit("docs"), F.col("best_pos") + 1, q, F.lit("*"), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.concat(F.lit("AS:i:"), "best_score"))
    return b.select("doc_id", line.alias("line"))


def _sides(spark, d):
    """Two sets of alignments of the same documents: the best hit on items of even and of odd number."""
    s = _scored(spark, d)

    def side(test):
        b = H.best_two(s.where(test), "doc_id", 50)
        flag = F.when(F.col("best_strand") == "-", 16).otherwise(0)
        return b.select("doc_id", (F.col("best_pos") + 1).alias("pos"), flag.alias("flag"), F.lit(0).alias("ref_id"), F.lit(100).cast("long").alias("read_len"), F.col("best_score").alias("score"), F.col("second_score").alias("sec_score"), (F.lit(6) - F.col("best_score")).alias("ed"), H.mapq("best_score", "second_score", "1", "6").alias("mapq"))

    return D.zip_sides(side(F.pmod(F.col("item_id"), F.lit(3)) != 0), side(F.pmod(F.col("item_id"), F.lit(3)) != 1), ["doc_id"])


def _side_sql(name, test):
    return f"""t{name} AS (SELECT doc_id, score AS best_score, pos AS best_pos, strand AS best_strand FROM sc WHERE {test} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, strand) = 1),
s{name} AS (SELECT doc_id, score AS second_score FROM sc JOIN t{name} USING (doc_id) WHERE {test} AND (strand <> best_strand OR abs(pos - best_pos) > 50) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, strand) = 1),
{name} AS (SELECT doc_id, best_pos + 1 AS {name}_pos, CASE WHEN best_strand = '-' THEN 16 ELSE 0 END AS {name}_flag, best_score AS {name}_score, second_score AS {name}_sec_score, 6 - best_score AS {name}_ed, {H.mapq_sql('best_score', 'second_score', '1', '6')} AS {name}_mapq FROM t{name} LEFT JOIN s{name} USING (doc_id))"""


SIDES = f"{SCORED}, {_side_sql('l', 'item_id % 3 <> 0')}, {_side_sql('r', 'item_id % 3 <> 1')}, z AS (SELECT * FROM l JOIN r USING (doc_id))"


def diff_contingency(spark, d):
    tests = {"mapped": (D.is_mapped("l"), D.is_mapped("r")), "unique": (D.is_unique("l"), D.is_unique("r")), "ambiguous": (D.is_ambiguous("l"), D.is_ambiguous("r")), "reverse": (D.is_reverse("l"), D.is_reverse("r"))}
    return D.contingency(_sides(spark, d), tests)


_T = {"mapped": ("{0}_pos <> 0 AND {0}_flag & 4 = 0"), "unique": "{0}_sec_score IS NULL", "ambiguous": "coalesce({0}_sec_score = {0}_score, false)", "reverse": "{0}_flag & 16 <> 0"}
_CONT = " UNION ALL ".join(f"SELECT '{k}' AS test, count(*) FILTER ({t.format('l')}) AS l, count(*) FILTER ({t.format('r')}) AS r, count(*) FILTER (({t.format('l')}) AND ({t.format('r')})) AS both, count(*) FILTER (({t.format('l')}) AND NOT ({t.format('r')})) AS l_only, count(*) FILTER (({t.format('r')}) AND NOT ({t.format('l')})) AS r_only FROM z" for k, t in _T.items())
_BIN = lambda x: f"CASE WHEN {x} <= 0 THEN 0 ELSE length(bin({x}::BIGINT)) END::BIGINT"


def diff_hist(spark, d):
    return D.histogram(_sides(spark, d), D.log_bin(F.abs(F.col("l_pos") - F.col("r_pos"))).alias("bin"))


def diff_hist2d(spark, d):
    return D.histogram(_sides(spark, d), D.linear_bin(F.col("l_mapq"), 10, 5).alias("l_bin"), D.linear_bin(F.col("r_mapq"), 10, 5).alias("r_bin"))


def diff_summary(spark, d):
    return D.summary(_sides(spark, d), "score")


def diff_filter(spark, d):
    return D.discordant_reads(_sides(spark, d), "doc_id", ("distant", "discordant"), ("score",), 1)


#: Two made sets of alignments of the documents, mate by mate: column -> expression of the id and the side.
_MADE = {
    "pos": "CASE WHEN (doc_id + {k}) % 9 = 0 THEN 0 ELSE doc_id % 500 + {k} * (doc_id % 7) * 40 + 1 END", "ref_id": "(doc_id + {k} * (doc_id % 13 // 12)) % 3",
    "flag": "((doc_id // 2 + {k} * (doc_id % 5 // 4)) % 2) * 16 + ((doc_id + {k}) % 4 // 3) * 4 + ((doc_id * 3 + {k}) % 5 // 1 % 2) * 2",
    "read_len": "100 + doc_id % 3 + {k} * (doc_id % 17 // 16)", "score": "-(doc_id % 6) * {k}", "sec_score": "CASE WHEN (doc_id + {k}) % 3 = 0 THEN NULL ELSE -((doc_id + {k}) % 6) END",
    "mapq": "(doc_id * 7 + {k} * 3) % 43", "ed": "(doc_id + {k}) % 8", "subs": "90 - (doc_id + {k}) % 11", "ins": "(doc_id * {k}) % 3", "dels": "(doc_id + 2 * {k}) % 4", "mms": "(doc_id * 5 + {k}) % 7",
}


def _made(spark, d, sides):
    from .tables import table

    cast = lambda e, k: F.expr(f"cast({e.format(k=k).replace('//', 'DIV')} AS bigint)")
    return table(spark, d, "documents").select("doc_id", *(cast(e, k).alias(f"{t}_{c}") for t, k in sides.items() for c, e in _MADE.items()))


_SINGLE, _PAIRED = {"l": 1, "r": 2}, {"l1": 1, "l2": 3, "r1": 2, "r2": 3}


def diff_single(spark, d):
    return D.analyse(_made(spark, d, _SINGLE))


def diff_paired(spark, d):
    return D.analyse(_made(spark, d, _PAIRED), paired=True)


def diff_pairs(spark, d):
    """Tests and sums of pairs, and derived sums of their mates."""
    rows = D.pair_columns(_made(spark, d, {"l1": 1, "l2": 3}), "l")
    return rows.select("doc_id", *(f"l_is_{t}" for t in ("mapped", "paired", "unpaired", "unique", "ambiguous")), "l_score", "l_sec_score", "l_mapq", "l_read_len", D.mapped_read_bases("l").alias("read_bases"), D.mapped_ref_bases("l1").alias("ref_bases"), D.trimmed("l2").alias("trimmed"))


def _made_sql(sides):
    cols = ", ".join(f"({e.format(k=k)})::BIGINT AS {t}_{c}" for t, k in sides.items() for c, e in _MADE.items())
    return f"m AS (SELECT doc_id, {cols} FROM documents)"


def _pair_sql(t):
    a, b = f"{t}1", f"{t}2"
    up = lambda x: f"({x}_pos <> 0 AND {x}_flag & 4 = 0)"
    pair = f"({up(a)} AND {up(b)} AND {a}_flag & 2 <> 0 AND {b}_flag & 2 <> 0)"
    sums = ", ".join(f"{a}_{c} + {b}_{c} AS {t}_{c}" for c in ("read_len", "score", "sec_score", "ed", "subs", "ins", "dels", "mms"))
    return f"""{sums}, {a}_mapq AS {t}_mapq, {a}_pos AS {t}_pos, {up(a)} AND {up(b)} AS {t}_is_mapped, {pair} AS {t}_is_paired, {up(a)} AND {up(b)} AND NOT {pair} AS {t}_is_unpaired,
  {pair} AND {a}_sec_score IS NULL AND {b}_sec_score IS NULL AS {t}_is_unique, {pair} AND coalesce({a}_sec_score + {b}_sec_score = {a}_score + {b}_score, false) AS {t}_is_ambiguous"""


def _single_sql(t):
    up = f"({t}_pos <> 0 AND {t}_flag & 4 = 0)"
    return f"{up} AS {t}_is_mapped, {up} AND {t}_sec_score IS NULL AS {t}_is_unique, {up} AND coalesce({t}_sec_score = {t}_score, false) AS {t}_is_ambiguous"


def _analyse_sql(paired):
    sides, mates = (_PAIRED, (("l1", "r1"), ("l2", "r2"))) if paired else (_SINGLE, (("l", "r"),))
    tests = ("mapped", "paired", "unique", "ambiguous") if paired else ("mapped", "unique", "ambiguous")
    shape = _pair_sql if paired else _single_sql
    elsewhere = " OR ".join(f"{l}_ref_id <> {r}_ref_id" for l, r in mates)
    distant = " OR ".join(f"{l}_ref_id <> {r}_ref_id OR abs({l}_pos - {r}_pos) > {l}_read_len" for l, r in mates)
    turned = " OR ".join(f"{l}_flag & 16 <> {r}_flag & 16" for l, r in mates)
    fits = " AND ".join(f"{l}_read_len = {r}_read_len" for l, r in mates)
    ok = "l_is_paired AND r_is_paired" if paired else "l_is_mapped AND r_is_mapped"
    parts = ["SELECT 'mismatched' AS section, 'reads' AS item, '-' AS side, 0::BIGINT AS bin FROM s WHERE NOT fits"]
    for t in tests:
        parts += [f"SELECT 'tests', '{t}', '{k}', 0 FROM s WHERE fits AND {w}" for k, w in (("l", f"l_is_{t}"), ("r", f"r_is_{t}"), ("both", f"l_is_{t} AND r_is_{t}"))]
        parts += [f"SELECT 'only', '{t}', '{a}', {_BIN(f'{a}_mapq')} FROM s WHERE fits AND {a}_is_{t} AND NOT {b}_is_{t}" for a, b in (("l", "r"), ("r", "l"))]
    parts += [f"SELECT 'moved', '{k}', '-', {_BIN('r_mapq')} FROM s WHERE fits AND ok AND {k}" for k in ("elsewhere", "distant", "discordant")]
    value = {"ed": "{0}_ed", "mapq": "{0}_mapq", "length": "({0}_subs + {0}_ins)", "trimmed": "({0}_read_len - {0}_subs - {0}_ins)", "subs": "{0}_subs", "mms": "{0}_mms", "ins": "{0}_ins", "dels": "{0}_dels", "pos": "{0}_pos"}
    for section, test in (("all", "true"), ("distant", "distant"), ("discordant", "discordant")):
        for item, v in value.items():
            gap = f"({v.format('l')} - {v.format('r')})"
            parts.append(f"SELECT '{section}', '{item}', CASE WHEN {gap} > 0 THEN 'l' WHEN {gap} < 0 THEN 'r' ELSE 'equal' END, {_BIN(f'abs({gap})')} FROM s WHERE fits AND ok AND {test}")
    return f"""WITH {_made_sql(sides)}, p AS (SELECT *, {shape('l')}, {shape('r')} FROM m),
s AS (SELECT *, {fits} AS fits, {ok} AS ok, ({elsewhere}) AS elsewhere, ({distant}) AS distant, ({turned}) AS discordant FROM p), x AS ({" UNION ALL ".join(parts)})
SELECT section, item, side, bin, count(*) AS n FROM x GROUP BY ALL"""


def best2_ends(spark, d):
    """Best two ends of each pair's semi-global alignment, more than 8 symbols apart."""
    ends = _pairs(spark, d).select("item_id", A.end_scores("pattern", "text", A.EDIT).alias("ends"))
    return ends.select("item_id", A.best_two_ends(F.col("ends"), 8).alias("x")).select("item_id", *(F.col(f"x.{c}").cast("long").alias(c) for c in ("score", "end", "second_score", "second_end")))


def aligner(spark, d):
    """Items as reads, aligned to the documents."""
    reads = items(spark, d).select(F.col("item_id").alias("read_id"), "seq")
    refs = docs(spark, d).select(F.col("doc_id").alias("ref_id"), "seq")
    out = G.align_reads(reads, refs, G.Options(seed=12, interval=4))
    return out.select("read_id", *(_L(c) for c in ("flag", "ref_id", "pos", "score", "second_score", "mapq", "ed")), "cigar", "md")


#: Symbols of a fragment of ``paired_aligner``, and of a mate.
FRAGMENT, MATE = 160, 50


def paired_aligner(spark, d):
    """Every document's whole text cut into fragments (``begin``), the last one as long as what is left; both ends of
    each are mates, aligned to the whole documents as pairs."""
    rows = cut(docs(spark, d).where("seq <> ''"))  # read four times
    begin = F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(FRAGMENT)))
    parts = rows.select("doc_id", "seq", begin.alias("begin")).select(F.struct("doc_id", "begin").alias("read_id"), S.infix(F.col("seq"), F.col("begin"), F.col("begin") + FRAGMENT).alias("seq"))
    first = parts.select("read_id", F.left("seq", F.lit(MATE)).alias("seq"))
    second = parts.select("read_id", S.reverse_complement(F.right("seq", F.lit(MATE))).alias("seq"))
    out = G.align_pairs(first, second, rows.withColumnRenamed("doc_id", "ref_id"), G.Options(seed=20, interval=10, max_hits=200), G.Pairing(max_fragment=300))
    return out.select(F.col("read_id.doc_id").alias("read_id"), F.col("read_id.begin").cast("long").alias("begin"), *(_L(c) for c in ("mate", "flag", "score", "pair_score", "mapq", "tlen", "ed")), "cigar", "md")


def mapq_filter(spark, d):
    rows = best2(spark, d).select("doc_id", H.mapq("best_score", "second_score", "1", "6").alias("mapq"))
    return H.filter_mapq(rows, 20).select("doc_id", _L("mapq"), "mapped")


def select_random(spark, d):
    """Two diagonals of each document drawn by their hits."""
    from ..operators.primitives import uniform

    c = qgram_diagonal_count(spark, d)
    drawn = H.select_random(c, "doc_id", 2, F.col("n"), uniform(F.concat_ws("/", "doc_id", "item_id", "diag"), 3))
    return drawn.select("doc_id", _L("rank"), "item_id", "diag")


def target_scores(spark, d):
    b = best2(spark, d)
    return b.select("doc_id", G.target_score(F.col("best_score"), F.col("second_score"), F.lit(1)).cast("long").alias("target"))


def best2_pairs(spark, d):
    """The best two pairs of a document's hits, or its best two hits where it has no pair."""
    s = _scored(spark, d).select("doc_id", F.lit(0).alias("ref_id"), "pos", "strand", "score", F.lit(16).cast("long").alias("length"))
    pairs = H.pair_up(s.where("strand = '+'"), s.where("strand = '-'"), "doc_id", 200)
    return G.best_two_pairs(pairs, s, "doc_id", 50).select("doc_id", "paired", "best_score", "best_pos", "best_strand", "second_score", "second_pos", "second_strand")


def mate_windows(spark, d):
    """Where the other mate is expected, by policy."""
    rows = docs(spark, d).select("doc_id", F.length("seq").cast("long").alias("pos"), F.explode(F.array(*map(F.lit, ("FR", "RF", "FF", "RR")))).alias("policy"))
    first, forward = F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.pmod(F.col("doc_id"), F.lit(3)) == 0
    left = right = F.lit(None).cast("boolean")
    for p in ("FR", "RF", "FF", "RR"):
        a, b = H.opposite_mate(p, first, forward)
        left, right = F.when(F.col("policy") == p, a).otherwise(left), F.when(F.col("policy") == p, b).otherwise(right)
    begin, end = H.mate_window(F.col("pos"), F.lit(50).cast("long"), left, 0, 300)
    return rows.select("doc_id", "policy", left.alias("left"), right.alias("forward"), begin.alias("begin"), end.alias("end"))


def band_lengths(spark, d):
    n = F.pmod(F.col("doc_id"), F.lit(200))
    return docs(spark, d).select("doc_id", S.band_of(n).alias("band"))


def gap_room(spark, d):
    n = F.length("seq").cast("long")
    least = F.floor(n * 0.6)
    return docs(spark, d).select("doc_id", S.gap_room(n, least, 2, -5, -3).alias("affine"), S.gap_room(n, least, 2, 0, -3).alias("linear"))


_GAP = lambda o: f"CASE WHEN n * 2 < m THEN 0 WHEN n * 2 + {o} < m THEN 0 ELSE greatest(least(n, floor((n * 2 + {o} - m) / 3.0) + 1) - 1, 0) END::BIGINT"
QUERIES = {
    "edit_distance_global": (edit_distance_global, f"WITH {PAIRS} SELECT item_id, -levenshtein(pattern, text) AS score FROM pairs"),
    "edit_distance_semiglobal": (edit_distance_semiglobal, f"WITH RECURSIVE {PAIRS}, {score_sql('pairs', 'item_id', A.EDIT, 'semi_global')} SELECT item_id, score FROM scored"),
    "edit_distance_banded": (edit_distance_banded, f"WITH RECURSIVE {PAIRS}, {banded_sql('pairs', 'item_id', 31)} SELECT item_id, score FROM scored"),
    "gotoh_quality": (gotoh_quality, f"WITH RECURSIVE {PAIRS}, qp AS (SELECT *, translate(pattern, 'ACGT', 'I5+!') AS qual FROM pairs), {score_sql('qp', 'item_id, qual', QUALITY, 'semi_global', True)} SELECT item_id, score FROM scored"),
    "sw_local": (sw_local, f"WITH RECURSIVE {PAIRS}, {score_sql('pairs', 'item_id', A.Scheme(2, -1, -1, -1), 'local')} SELECT item_id, score FROM scored"),
    "gotoh_semiglobal": (gotoh_semiglobal, f"WITH RECURSIVE {PAIRS}, {score_sql('pairs', 'item_id', GOTOH, 'semi_global')} SELECT item_id, score FROM scored"),
    "cigar": (cigar, f"WITH RECURSIVE {PAIRS}, whole AS (SELECT * FROM pairs WHERE pattern <> '' AND text <> ''), {score_sql('whole', 'item_id', GOTOH, 'local')}, {trace_sql('item_id', GOTOH)} SELECT item_id, score, text_begin, text_end, pattern_begin, pattern_end, cigar, md, ed::BIGINT AS ed FROM traced"),
    "qmap": (qmap, f"""{HITS.replace("WITH", "WITH RECURSIVE", 1)}, c AS (SELECT doc_id, item_id, {SNAP} AS diag FROM hits GROUP BY ALL HAVING count(*) >= 2),
cases AS (SELECT doc_id, c.item_id, diag, ref.seq AS pattern, substr(dna.seq, greatest(diag - 16, 0) + 1, length(ref.seq) + 48) AS text FROM c JOIN ref ON c.item_id = ref.item_id JOIN dna USING (doc_id)),
whole AS (SELECT * FROM cases WHERE text <> ''), {score_sql("whole", "doc_id, item_id, diag", A.EDIT, "semi_global")}
SELECT doc_id, item_id, diag, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id, diag) = 1"""),
    "fmmap": (fmmap, f"""WITH RECURSIVE {DOCS}, {ITEMS}, r AS (SELECT item_id, 0 AS strand, seq AS pattern FROM ref UNION ALL SELECT item_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM ref),
s AS (SELECT item_id, strand, q, substr(pattern, q + 1, 16) AS g FROM (SELECT item_id, strand, pattern, unnest(range(0, length(pattern) - 16 + 1, 8)) AS q FROM r WHERE length(pattern) >= 16)),
p AS (SELECT doc_id, b, substr(seq, b + 1, 16) AS g FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 16 + 1)) AS b FROM dna WHERE length(seq) >= 16)),
d AS (SELECT DISTINCT item_id, strand, doc_id, cast(ceil((b - q) / 16.0 - 0.5) * 16 AS BIGINT) AS diag FROM s JOIN p USING (g)),
cases AS (SELECT DISTINCT item_id, pattern, substr(seq, greatest(diag - 16, 0) + 1, length(pattern) + 48) AS text FROM d JOIN r USING (item_id, strand) JOIN dna USING (doc_id)),
whole AS (SELECT * FROM cases WHERE text <> ''), {score_sql("whole", "item_id", A.EDIT, "semi_global")},
best AS (SELECT item_id, max(score) AS score FROM scored GROUP BY item_id) SELECT score, count(*) AS items FROM best GROUP BY score"""),
    "best2": (best2, f"{BEST2} SELECT doc_id, best_score, best_pos, best_strand, second_score, second_pos, second_strand FROM b2"),
    "mapq": (mapq, f"{BEST2} SELECT doc_id, ({H.mapq_sql('best_score', 'second_score', '1', '6')})::BIGINT AS mapq, ({H.mapq_sql('best_score', 'second_score', '1', '6', True)})::BIGINT AS mapq_local FROM b2"),
    "topk_hits": (topk_hits, f"{SCORED}, k AS (SELECT doc_id, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n, diag) <= 3) SELECT doc_id, count(*) AS hits, min(n) AS rarest FROM k GROUP BY doc_id"),
    "reseed": (reseed, f"{SCORED}, a AS (SELECT doc_id, avg(n) AS a FROM c GROUP BY doc_id) SELECT doc_id FROM dna LEFT JOIN a USING (doc_id) WHERE a IS NULL OR a >= 3"),
    "prune_search": (prune_search, f"{SCORED} SELECT doc_id FROM dna WHERE doc_id NOT IN (SELECT doc_id FROM c)"),
    "coord_to_refseq": (coord_to_refseq, f"""WITH {ITEMS}, r AS (SELECT item_id, length(seq) AS len, sum(length(seq)) OVER (ORDER BY item_id)::BIGINT - length(seq) AS off FROM ref),
h AS (SELECT doc_id, ((doc_id * 7919) % (SELECT sum(length(seq))::BIGINT FROM ref))::BIGINT AS pos FROM documents) SELECT doc_id, pos, item_id AS ref_id, pos - off + 1 AS ref_pos, pos + 20 > off + len AS bridges FROM h JOIN r ON pos >= off AND pos < off + len"""),
    "pair_hits": (pair_hits, f"{SCORED} SELECT a.doc_id, a.pos AS a_pos, o.pos AS o_pos, a.score + o.score AS score, CASE WHEN o.pos < a.pos THEN -1 ELSE 1 END * (greatest(a.pos, o.pos) + 16 - least(a.pos, o.pos)) AS tlen FROM sc a JOIN sc o ON a.doc_id = o.doc_id AND a.strand = '+' AND o.strand = '-' AND o.pos >= a.pos AND o.pos + 16 <= a.pos + 200"),
    "sam_records": (sam_records, f"{BEST2}, q AS (SELECT *, {H.mapq_sql('best_score', 'second_score', '1', '6')} AS q FROM b2) SELECT doc_id, concat_ws(chr(9), 'doc' || doc_id, (CASE WHEN best_strand = '-' THEN 16 ELSE 0 END) + (CASE WHEN q = 0 THEN 4 ELSE 0 END), 'docs', best_pos + 1, q, '*', '*', 0, 0, '*', '*', 'AS:i:' || best_score) AS line FROM q"),
    "diff_contingency": (diff_contingency, f"{SIDES} {_CONT}"),
    "diff_hist": (diff_hist, f"{SIDES} SELECT {_BIN('abs(l_pos - r_pos)')} AS bin, count(*) AS n FROM z GROUP BY ALL"),
    "diff_hist2d": (diff_hist2d, f"{SIDES} SELECT least(greatest(l_mapq // 10, 0), 4)::BIGINT AS l_bin, least(greatest(r_mapq // 10, 0), 4)::BIGINT AS r_bin, count(*) AS n FROM z GROUP BY ALL"),
    "diff_summary": (diff_summary, f"{SIDES}, s3 AS (SELECT CASE WHEN l_score > r_score THEN 'l' WHEN l_score < r_score THEN 'r' ELSE 'equal' END AS side, {_BIN('abs(l_score - r_score)')} AS bin FROM z) SELECT side, bin, count(*) AS n FROM s3 GROUP BY ROLLUP (side, bin)"),
    "diff_filter": (diff_filter, f"{SIDES} SELECT doc_id FROM z WHERE (abs(l_pos - r_pos) > 100 OR (l_flag & 16) <> (r_flag & 16)) AND l_score - r_score >= 1"),
    "diff_single": (diff_single, _analyse_sql(False)),
    "diff_paired": (diff_paired, _analyse_sql(True)),
    "diff_pairs": (diff_pairs, f"WITH {_made_sql({'l1': 1, 'l2': 3})}, p AS (SELECT *, {_pair_sql('l')} FROM m) SELECT doc_id, l_is_mapped, l_is_paired, l_is_unpaired, l_is_unique, l_is_ambiguous, l_score, l_sec_score, l_mapq, l_read_len, l_subs + l_ins AS read_bases, l1_subs + l1_dels AS ref_bases, l2_read_len - l2_subs - l2_ins AS trimmed FROM p"),
    "best2_ends": (best2_ends, f"""WITH RECURSIVE {PAIRS}, {score_sql('pairs', 'item_id', A.EDIT, 'semi_global')}, en AS (SELECT item_id, i AS e, h[length(pattern) + 1] AS score FROM dp),
b AS (SELECT item_id, score, e AS "end" FROM en QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, e DESC) = 1),
o AS (SELECT en.item_id, en.score AS second_score, e AS second_end FROM en JOIN b USING (item_id) WHERE abs(e - "end") > 8 QUALIFY row_number() OVER (PARTITION BY en.item_id ORDER BY en.score DESC, e DESC) = 1)
SELECT item_id, score, "end", second_score, second_end FROM b LEFT JOIN o USING (item_id)"""),
    "aligner": (aligner, None),
    "paired_aligner": (paired_aligner, None),
    "mapq_filter": (mapq_filter, f"{BEST2}, q AS (SELECT doc_id, ({H.mapq_sql('best_score', 'second_score', '1', '6')})::BIGINT AS q FROM b2) SELECT doc_id, CASE WHEN q < 20 THEN 0 ELSE q END AS mapq, q >= 20 AS mapped FROM q"),
    "select_random": (select_random, f"""{SCORED}, u AS (SELECT *, -ln((('0x' || substr(md5('3:' || doc_id || '/' || item_id || '/' || diag), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE) / n AS w FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS rank, item_id, diag FROM u QUALIFY rank <= 2"""),
    "target_scores": (target_scores, f"{BEST2} SELECT doc_id, CASE WHEN second_score IS NULL THEN 1 ELSE second_score + trunc((best_score - second_score) * 3 / 4.0) END::BIGINT AS target FROM b2"),
    "best2_pairs": (best2_pairs, f"""{SCORED}, pr AS (SELECT a.doc_id, a.pos, '+-' AS strand, a.score + o.score AS score FROM sc a JOIN sc o ON a.doc_id = o.doc_id AND a.strand = '+' AND o.strand = '-' AND o.pos >= a.pos AND o.pos + 16 <= a.pos + 200),
e AS (SELECT *, true AS paired FROM pr UNION ALL SELECT doc_id, pos, strand, score, false FROM sc WHERE doc_id NOT IN (SELECT doc_id FROM pr)),
t AS (SELECT doc_id, paired, score AS best_score, pos AS best_pos, strand AS best_strand FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, strand) = 1),
s2 AS (SELECT doc_id, score AS second_score, pos AS second_pos, strand AS second_strand FROM e JOIN t USING (doc_id) WHERE strand <> best_strand OR abs(pos - best_pos) > 50 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, strand) = 1)
SELECT doc_id, paired, best_score, best_pos, best_strand, second_score, second_pos, second_strand FROM t LEFT JOIN s2 USING (doc_id)"""),
    "mate_windows": (mate_windows, f"""WITH {DOCS}, r AS (SELECT doc_id, length(seq) AS pos, unnest(['FR', 'RF', 'FF', 'RR']) AS policy, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS f FROM dna),
w AS (SELECT *, CASE policy WHEN 'FR' THEN NOT f WHEN 'RF' THEN f WHEN 'FF' THEN a <> f ELSE a = f END AS "left", CASE WHEN policy IN ('FF', 'RR') THEN f ELSE NOT f END AS forward FROM r)
SELECT doc_id, policy, "left", forward, CASE WHEN "left" THEN greatest(pos + 50 - 300, 0) ELSE pos END AS begin, CASE WHEN "left" THEN pos + 50 ELSE pos + 300 END AS "end" FROM w"""),
    "band_lengths": (band_lengths, "SELECT doc_id, ((1 << length(bin((doc_id % 200) * 2 + 1))) - 1)::BIGINT AS band FROM documents"),
    "gap_room": (gap_room, f"WITH x AS (SELECT doc_id, length(upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))) AS n FROM documents), y AS (SELECT doc_id, n, floor(n * 0.6::DOUBLE) AS m FROM x) SELECT doc_id, {_GAP(-5)} AS affine, {_GAP(0)} AS linear FROM y"),
}
