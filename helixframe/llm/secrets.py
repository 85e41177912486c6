"""Secret scans: base patterns, and weak credentials that count only next to their other parts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, read_table

#: Base kinds in their order: name, pattern (letters of key words in either case), group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Parts that are weak on their own.
IDENT = r"""(?i:access_?key(?:_?id)?|client_?id|user(?:name)?|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"""(?i:https?|ftp|postgres|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|(?i:host(?:name)?|endpoint|server|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Parts of one credential lie so many code points apart at most.
SCOPE = 300
#: Order of kinds in the output.
KINDS = ("assign", "access", "hex", "ident", "weak")

SPANS = "array<struct<s:int,e:int,v:string>>"
_NONE = f"cast(array() AS {SPANS})"


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``(s, e, v)``: code points from start to end, and a group's text.

    The texts between matches and the matches themselves give the places.
    """
    p = F.lit(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("v")
    )
    empty = F.array().cast(SPANS)

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        one = F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"))).cast(SPANS)
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(x["whole"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda a: a["out"])


def _at_least(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(x["v"]) >= least)


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k")))


def _if(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.expr(_NONE))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: ``doc_id, base, spans`` (arrays of ``(s, e, k)``, ``k`` an index of ``KINDS``).

    ``base`` has the base spans; ``spans`` adds weak candidates.  A weak secret (an opaque token with
    letters and digits) is reported if an identifier and an endpoint lie within ``scope`` code points of
    it; a weak identifier is reported with it.  Access keys count as identifiers too, and a base
    assignment or hexadecimal string next to a weak identifier and an endpoint reports the identifier.

    The parts are linked by interval joins on the row and on cells of ``scope`` code points: by their
    starts, and for overlaps by every cell that a part covers.  Parts of one kind do not overlap, so a
    cell holds a bounded number of them, a long part is in as many cells as its length asks for, and the
    joins grow with the text.  Texts are read in one pass and never shuffled: only places of parts are.

    Defined cases: a null text counts as empty; rows without a part have empty arrays; repeated rows and
    null ids are rows of their own; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    low = src.withColumn("hints", F.col("text").rlike(r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"))
    base = {}
    for name, pattern, group, least in BASE:
        base[name] = _if(F.col("hints"), _at_least(_spans(F.col("text"), pattern, group), least))
    found = low.select("doc_id", "text", *(v.alias(k) for k, v in base.items()))
    hint = F.col("text").rlike(r"://|(?i:host|endpoint|server|region)")
    found = found.withColumn("endpoint", _if(hint, _spans(F.col("text"), ENDPOINT)))
    found = found.withColumn("ident", _if(F.size("endpoint") > 0, _spans(F.col("text"), IDENT)))
    linked = (F.size("endpoint") > 0) & ((F.size("ident") > 0) | (F.size("access") > 0))
    found = found.withColumn("opaque", _if(linked, F.filter(_spans(F.col("text"), OPAQUE), lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]"))))
    plain = "array<struct<s:int,e:int>>"
    rows = cut(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(F.transform(c, lambda x: F.struct(x["s"], x["e"])).cast(plain).alias(c) for c in ("assign", "access", "hex", "ident", "endpoint", "opaque"))))

    kinds = {k: i for i, k in enumerate(KINDS)}
    with_k = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(kinds[c]).alias("k"), x["e"].alias("e")))

    def part(*names: tuple[str, int]) -> DataFrame:
        tagged = F.concat(*(_of_kind(F.col(c), k) for c, k in names))
        return rows.where(linked).select("row", F.explode(tagged).alias("x")).select("row", "x.*").withColumn("cell", F.floor(F.col("s") / scope))

    def around(df: DataFrame, tag: str) -> DataFrame:
        near = df.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
        return near.select(F.col("row"), F.col("cell"), F.col("s").alias(f"{tag}_s"), F.col("e").alias(f"{tag}_e"), F.col("k").alias(f"{tag}_k"))

    secrets = part(("assign", kinds["assign"]), ("hex", kinds["hex"]), ("opaque", kinds["weak"]))
    strong = part(("assign", 0), ("hex", 0), ("access", 0), ("ident", 1), ("endpoint", 1))
    idents, ends = around(part(("access", kinds["access"]), ("ident", kinds["ident"])), "i"), around(part(("endpoint", -1)), "p")
    close = lambda t: (F.abs(F.col("s") - F.col(f"{t}_s")) <= scope) & ((F.col("e") <= F.col(f"{t}_s")) | (F.col(f"{t}_e") <= F.col("s")))
    ended = secrets.join(ends, ["row", "cell"]).where(close("p")).select("row", "cell", "s", "e", "k").distinct()
    links = ended.join(idents, ["row", "cell"]).where(close("i"))
    # an opaque token inside or across another part is that part
    weak = links.where(F.col("k") == kinds["weak"]).select("row", "s", "e").distinct()
    covered = F.explode(F.sequence(F.floor(F.col("s") / scope), F.floor((F.col("e") - 1) / scope)))
    over = strong.select("row", covered.alias("cell"), F.col("s").alias("o_s"), F.col("e").alias("o_e"))
    inside = weak.select("row", "s", "e", covered.alias("cell")).join(over, ["row", "cell"]).where((F.col("s") < F.col("o_e")) & (F.col("o_s") < F.col("e"))).select("row", "s", "e").distinct()
    weak = weak.join(inside, ["row", "s", "e"], "left_anti").select("row", "s", F.lit(kinds["weak"]).alias("k"), "e")
    kept = links.where((F.col("k") != kinds["weak"]) & (F.col("i_k") == kinds["ident"])).select("row", F.col("i_s").alias("s"), F.col("i_k").alias("k"), F.col("i_e").alias("e"))
    by_weak = links.where((F.col("k") == kinds["weak"]) & (F.col("i_k") == kinds["ident"])).join(weak.select("row", "s", "e"), ["row", "s", "e"], "left_semi")
    kept = kept.unionByName(by_weak.select("row", F.col("i_s").alias("s"), F.col("i_k").alias("k"), F.col("i_e").alias("e"))).distinct()
    added = weak.unionByName(kept).groupBy("row").agg(F.collect_set(F.struct("s", "k", "e")).alias("added"))

    own = F.concat(with_k("assign"), with_k("access"), with_k("hex"))
    out = rows.select("row", "doc_id", own.alias("base")).join(added, "row", "left")
    more = F.coalesce("added", F.expr("cast(array() AS array<struct<s:int,k:int,e:int>>)"))
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", more)).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    out = scan(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def _both_cases(pattern: str) -> str:
    """``(?i:...)`` spelled out, as other engines fold letters beyond A-Z too."""
    spell = lambda m: "(?:" + re.sub("[A-Za-z]", lambda c: f"[{c[0].lower()}{c[0].upper()}]", m[1]) + ")"
    return re.sub(r"\(\?i:((?:[^()]|\([^()]*\))*)\)", spell, pattern)


def _sql() -> str:
    """The same for DuckDB, with plain interval joins in place of cells."""

    def place(pattern: str, group: int = 0) -> str:
        p = _both_cases(pattern).replace("'", "''")
        return f"""(SELECT list({{'s': s, 'e': s + len(w), 'v': v}} ORDER BY k) FROM (SELECT k, w, v, list_sum(list_transform(g[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0) AS s
  FROM (SELECT regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS y) q, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS k) i, LATERAL (SELECT m[k] AS w, y[k] AS v) z))"""

    bases = ", ".join(f"list_filter({place(p, g)}, lambda x: len(x.v) >= {n}) AS {name}" for name, p, g, n in BASE)
    case = lambda k: "CASE k " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(KINDS)) + " END" if k else ""
    near = lambda a, b: f"{a}.row = {b}.row AND abs({a}.s - {b}.s) <= {SCOPE} AND ({a}.e <= {b}.s OR {b}.e <= {a}.s)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT row, doc_id, {bases}, {place(ENDPOINT)} AS endpoint, {place(IDENT)} AS ident, {place(OPAQUE)} AS opaque FROM d),
p AS ({" UNION ALL ".join(f"SELECT row, {k} AS k, unnest({c}) AS x FROM f" for c, k in (("assign", 0), ("access", 1), ("hex", 2), ("ident", 3), ("opaque", 4), ("endpoint", 5)))}),
a AS (SELECT row, k, x.s AS s, x.e AS e FROM p WHERE k <> 4 OR (regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]'))),
o AS (SELECT * FROM a WHERE k NOT IN (1, 3, 5) AND (k <> 4 OR NOT EXISTS (SELECT 1 FROM a b WHERE b.row = a.row AND b.k <> 4 AND a.s < b.e AND b.s < a.e))),
l AS (SELECT o.row, o.k, o.s, o.e, i.k AS ik, i.s AS js, i.e AS je FROM o JOIN a i ON i.k IN (1, 3) AND {near("o", "i")} WHERE EXISTS (SELECT 1 FROM a q WHERE q.k = 5 AND {near("o", "q")})),
w AS (SELECT row, s, k, e FROM l WHERE k = 4 UNION SELECT row, js, ik, je FROM l WHERE ik = 3),
b AS (SELECT row, s, k, e FROM a WHERE k < 3),
t AS (SELECT row, s, k, e, {case(1)} || ':' || s || ':' || e AS x, true AS base FROM b UNION ALL SELECT row, s, k, e, {case(1)} || ':' || s || ':' || e, false FROM w),
g AS (SELECT row, count(*) FILTER (base AND k = 0) AS a, count(*) FILTER (base AND k = 1) AS c, count(*) FILTER (base AND k = 2) AS h,
  string_agg(x, ',' ORDER BY s, k, e) FILTER (base) AS bx, string_agg(x, ',' ORDER BY s, k, e) AS sx FROM t GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(bx, '')) AS base_sha256, coalesce(sx, '') AS spans FROM d LEFT JOIN g USING (row)
"""


SQL = _sql()
