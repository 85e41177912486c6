"""Queries of the dataflow primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import primitives as P
from .tables import DOCS, ITEMS, docs, items, table

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_O = ", ".join(_ORDER)


def _lines(spark, d):
    return table(spark, d, "lineitem").select(*_ORDER, F.col("l_quantity").cast("long").alias("q"))


def scan_inclusive(spark, d):
    return P.scan(_lines(spark, d), _ORDER, F.col("q"), "total").groupBy("l_orderkey").agg(F.max("total").alias("upto"))


def scan_exclusive(spark, d):
    return P.scan(_lines(spark, d), _ORDER, F.col("q"), "before", exclusive=True).groupBy("l_orderkey").agg(F.min("before").alias("before"))


def segmented_scan(spark, d):
    out = P.segmented_scan(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], F.lit(1), "nth")
    return out.select("event_id", F.col("nth").cast("long").alias("nth"))


def runlength_encode(spark, d):
    return P.runlength_encode(table(spark, d, "events").select("event_id", "event_type"), ["event_id"], "event_type").select(F.col("run").cast("long").alias("run"), "event_type", "n")


def reduce_by_key(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return P.reduce_by_key(rows, ["event_id"], "event_type", F.max("user_id").alias("top_user"), F.min("event_id").alias("first")).select("event_type", "top_user", "first")


def is_sorted(spark, d):
    a = P.is_sorted(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "o_orderkey").select(F.lit("o_orderkey").alias("what"), "sorted")
    b = P.is_sorted(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey").select(F.lit("o_custkey").alias("what"), "sorted")
    return a.unionByName(b)


def segment_sorted(spark, d):
    return P.is_segment_sorted(_lines(spark, d), ["l_orderkey"], _ORDER[1:], "q")


def copy_flagged(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return P.copy_flagged(rows, (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def any_all(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity")
    some = P.any_of(rows, F.col("l_quantity") >= 50).withColumn("k", F.lit(1))
    return some.join(P.all_of(rows, F.col("l_quantity") >= 1).withColumn("k", F.lit(1)), "k").select("any", "all")


def bounds(spark, d):
    prices = table(spark, d, "part").select(F.col("p_size").cast("long").alias("v"))
    asked = table(spark, d, "supplier").select(F.pmod("s_suppkey", F.lit(60)).cast("long").alias("x"))
    return P.bounds(prices, asked, "v", "x")


def top_k(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return P.top_k(rows, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_nationkey", F.col("rank").cast("long").alias("rank"), "c_custkey")


def merge_sort_pairs(spark, d):
    """Sorted order as ranks: nothing is returned in order, so the order is a column."""
    rows = items(spark, d).select("item_id", "seq")
    return P.scan(rows, ["seq", "item_id"], F.lit(1), "nth").select("item_id", F.col("nth").cast("long").alias("nth"))


def weighted_sample(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return P.weighted_sample(rows, F.col("o_totalprice"), F.col("o_orderkey"), 100, 7).select("o_orderkey")


def sum_tree(spark, d):
    leaves = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("w"))
    draws = table(spark, d, "supplier").select(((F.col("s_suppkey") * 37) % 101 / 101.0).alias("u")).distinct()
    return P.sum_tree_sample(leaves, "p_partkey", "w", draws, "u").select(F.round(F.col("u") * 101).cast("long").alias("k"), "leaf")


def bloom_semi(spark, d):
    """Orders of customers that have a key in a filter, then exactly."""
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    bits = 1 << 16
    words = P.bloom_build(rich, F.col("o_custkey"), bits)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return P.semi(P.bloom_has(orders, words, F.col("o_custkey"), bits), rich, ["o_custkey"]).select("o_orderkey", "o_custkey")


def prefix_trie(spark, d):
    return P.prefix_trie(items(spark, d))


def suffix_trie(spark, d):
    """The whole trie of the items' suffixes: a node for each different infix."""
    return P.suffix_trie(items(spark, d))


def suffix_dictionary(spark, d):
    """The dictionary of the documents' infixes of up to six symbols."""
    return P.suffix_trie(docs(spark, d), depth=6)


def sum_tree_update(spark, d):
    """Weights added to and set, and the leaves that draws then reach."""
    leaves = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("w"))
    few = leaves.where("p_partkey % 5 = 0")
    leaves = P.sum_tree_update(leaves, few.select("p_partkey", F.lit(7).cast("long").alias("w")), "p_partkey", "w")
    leaves = P.sum_tree_update(leaves, few.where("p_partkey % 2 = 0").select("p_partkey", F.lit(0).cast("long").alias("w")), "p_partkey", "w", "set")
    draws = table(spark, d, "supplier").select(((F.col("s_suppkey") * 37) % 101 / 101.0).alias("u")).distinct()
    return P.sum_tree_sample(leaves, "p_partkey", "w", draws, "u").select(F.round(F.col("u") * 101).cast("long").alias("k"), "leaf")


def find_pivot(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey")
    key = F.col("o_orderkey")
    parts = [P.find_pivot(rows, ["o_orderkey"], key > n).select(F.lit(n).cast("long").alias("least"), "pivot") for n in (0, 100, 1500, 10**9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def rounding(spark, d):
    """Whole divisions, multiples, logarithms and bits of order keys."""
    from ..functions import sequence as S

    x = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.divide_up(x, 7).alias("up"), S.round_up(x, 8).alias("next"), S.round_down(x, 8).alias("last"), S.log2_whole(x).alias("log"), S.popcount(x).alias("bits"))


def lcg_random(spark, d):
    """Three numbers of a congruential sequence from each order key."""
    from ..functions import sequence as S

    a = S.lcg_next(F.col("o_orderkey").cast("long"))
    rows = table(spark, d, "orders").select("o_orderkey", a.alias("a")).withColumn("b", S.lcg_next(F.col("a"))).withColumn("c", S.lcg_next(F.col("b")))
    return rows


_RUNS = "x AS (SELECT event_id, event_type, user_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS c FROM events), r AS (SELECT *, sum(c) OVER (ORDER BY event_id)::BIGINT AS run FROM x)"
_U = "((('0x' || substr(md5('7:' || o_orderkey), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE)"
QUERIES = {
    "scan_inclusive": (scan_inclusive, f"WITH x AS (SELECT l_orderkey, sum(l_quantity::BIGINT) OVER (ORDER BY {_O})::BIGINT AS t FROM lineitem) SELECT l_orderkey, max(t) AS upto FROM x GROUP BY l_orderkey"),
    "scan_exclusive": (scan_exclusive, f"WITH x AS (SELECT l_orderkey, sum(l_quantity::BIGINT) OVER (ORDER BY {_O})::BIGINT - l_quantity::BIGINT AS t FROM lineitem) SELECT l_orderkey, min(t) AS before FROM x GROUP BY l_orderkey"),
    "segmented_scan": (segmented_scan, "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events"),
    "runlength_encode": (runlength_encode, f"WITH {_RUNS} SELECT run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY run"),
    "reduce_by_key": (reduce_by_key, f"WITH {_RUNS} SELECT any_value(event_type) AS event_type, max(user_id) AS top_user, min(event_id) AS first FROM r GROUP BY run"),
    "is_sorted": (is_sorted, "SELECT 'o_orderkey' AS what, true AS sorted UNION ALL SELECT 'o_custkey', bool_and(p IS NULL OR p <= o_custkey) FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders)"),
    "segment_sorted": (segment_sorted, f"SELECT l_orderkey, bool_and(p IS NULL OR p <= q) AS sorted FROM (SELECT l_orderkey, l_quantity::BIGINT AS q, lag(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY {_O}) AS p FROM lineitem) GROUP BY l_orderkey"),
    "copy_flagged": (copy_flagged, "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"),
    "any_all": (any_all, 'SELECT bool_or(l_quantity >= 50) AS "any", bool_and(l_quantity >= 1) AS "all" FROM lineitem'),
    "bounds": (bounds, "WITH q AS (SELECT DISTINCT (s_suppkey % 60)::BIGINT AS x FROM supplier) SELECT x, (SELECT count(*) FROM part WHERE p_size < x) AS lower, (SELECT count(*) FROM part WHERE p_size <= x) AS upper FROM q"),
    "top_k": (top_k, "SELECT c_nationkey, row_number() OVER w AS rank, c_custkey FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) QUALIFY rank <= 3"),
    "merge_sort_pairs": (merge_sort_pairs, f"WITH {ITEMS} SELECT item_id, row_number() OVER (ORDER BY seq, item_id) AS nth FROM ref"),
    "weighted_sample": (weighted_sample, f"SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY -ln({_U}) / o_totalprice, o_orderkey LIMIT 100"),
    "sum_tree": (sum_tree, "WITH l AS (SELECT p_partkey, p_size::BIGINT AS w, sum(p_size) OVER (ORDER BY p_partkey)::BIGINT AS u FROM part), d AS (SELECT DISTINCT ((s_suppkey * 37) % 101)::BIGINT AS k FROM supplier) SELECT k, (SELECT p_partkey FROM l WHERE w > 0 AND u > k / 101.0::DOUBLE * (SELECT sum(p_size) FROM part) ORDER BY p_partkey LIMIT 1) AS leaf FROM d"),
    "bloom_semi": (bloom_semi, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    "prefix_trie": (prefix_trie, f"WITH {ITEMS}, n AS (SELECT substr(seq, 1, d) AS prefix, count(*) AS n, bool_or(length(seq) = d) AS leaf FROM (SELECT seq, unnest(range(0, length(seq) + 1)) AS d FROM ref) GROUP BY 1), k AS (SELECT substr(prefix, 1, length(prefix) - 1) AS prefix, count(*) AS children FROM n WHERE prefix <> '' GROUP BY 1) SELECT prefix, n, leaf, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (prefix)"),
    "suffix_trie": (suffix_trie, f"WITH {ITEMS}, s AS (SELECT substr(seq, b + 1) AS x FROM (SELECT seq, unnest(range(0, length(seq) + 1)) AS b FROM ref)), p AS (SELECT x, unnest(range(0, length(x) + 1)) AS d FROM s) SELECT substr(x, 1, d) AS prefix, count(*) AS n, bool_or(length(x) = d) AS leaf FROM p GROUP BY 1"),
    "suffix_dictionary": (suffix_dictionary, f"WITH {DOCS}, s AS (SELECT substr(seq, b + 1, 6) AS x, length(seq) - b <= 6 AS whole FROM (SELECT seq, unnest(range(0, length(seq) + 1)) AS b FROM dna)), p AS (SELECT x, whole, unnest(range(0, length(x) + 1)) AS d FROM s) SELECT substr(x, 1, d) AS prefix, count(*) AS n, bool_or(length(x) = d AND whole) AS leaf FROM p GROUP BY 1"),
    "sum_tree_update": (sum_tree_update, "WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN p_size + 7 ELSE p_size END::BIGINT AS w FROM part), l AS (SELECT p_partkey, w, sum(w) OVER (ORDER BY p_partkey)::BIGINT AS u FROM v), d AS (SELECT DISTINCT ((s_suppkey * 37) % 101)::BIGINT AS k FROM supplier) SELECT k, (SELECT p_partkey FROM l WHERE w > 0 AND u > k / 101.0::DOUBLE * (SELECT sum(w) FROM v) ORDER BY p_partkey LIMIT 1) AS leaf FROM d"),
    "find_pivot": (find_pivot, "SELECT t.least, CASE WHEN max(o_orderkey) > t.least THEN count(*) FILTER (o_orderkey <= t.least) END AS pivot FROM orders, (SELECT unnest([0, 100, 1500, 1000000000])::BIGINT AS least) t GROUP BY t.least"),
    "rounding": (rounding, "SELECT o_orderkey, (o_orderkey + 6) // 7 AS up, (o_orderkey + 7) // 8 * 8 AS next, o_orderkey // 8 * 8 AS last, length(bin(o_orderkey)) - 1 AS log, bit_count(o_orderkey)::BIGINT AS bits FROM orders"),
    "lcg_random": (lcg_random, "WITH a AS (SELECT o_orderkey, (o_orderkey::HUGEINT * 1664525 + 1013904223) % 4294967296 AS a FROM orders), b AS (SELECT *, (a * 1664525 + 1013904223) % 4294967296 AS b FROM a) SELECT o_orderkey, a::BIGINT AS a, b::BIGINT AS b, ((b * 1664525 + 1013904223) % 4294967296)::BIGINT AS c FROM b"),
}
