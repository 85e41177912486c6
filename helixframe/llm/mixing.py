"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import cut, read_table

#: Rows of a leaf in one bucket of its order.
ROWS_PER_BUCKET = 512
#: Steps of the ratio of room to weight for each doubling.
STEPS = 8
#: Leaves that are broadcast to the documents; beyond that the leaves are joined by a shuffle.
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """Target weights of a domain-language-source tree.

    Each level has relative weights by value and one for values without an entry; ``share`` is the
    budget as a part of all tokens, ``epochs`` how often a document may be used at most.
    """

    domain: dict[str, float] = field(default_factory=lambda: {"web": 4.0, "books": 3.0, "code": 2.0, "papers": 1.0})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0})
    source: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    share: float = 0.8
    epochs: int = 2
    seed: int = 17


LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source.  The tables name none, so the first hexadecimal digit of the source's MD5
    assigns one of four."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return (
        F.when(digit.isin(*"0123"), "web").when(digit.isin(*"4567"), "books").when(digit.isin(*"89ab"), "code").otherwise("papers")
    )


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(mix: Mix, level: str) -> Column:
    out = F.lit(float(mix.other))
    for value, weight in getattr(mix, level).items():
        out = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(out)
    return out


def _share_out(children: DataFrame, parent: list[str], few: bool) -> DataFrame:
    """Adds ``give``: each child's part of its parent's ``budget``, by ``weight`` up to ``room``.

    Children fill up in proportion to their weights; what a full child leaves over goes to its siblings
    by their weights, up to a level of room to weight that uses the budget: the largest of the levels
    found by filling the children in the order of that ratio.  A parent may have any number of children:
    unless all of them are ``few``, sums over steps of the ratio, combined before the shuffle, tell in which
    step the level lies, and only the ratios of that step are put in order, each once.
    """
    if few:
        ratio = F.col("room") / F.col("weight")
        up = W.partitionBy(*parent).orderBy(ratio)
        full = F.coalesce(F.sum("room").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))
        level = children.withColumn("level", (F.col("budget") - full) / rest).withColumn("level", F.max("level").over(W.partitionBy(*parent)))
        return level.withColumn("give", F.least("room", F.col("level") * F.col("weight"))).drop("level")
    kids = children.withColumn("ratio", F.col("room") / F.col("weight")).withColumn("step", F.coalesce(F.floor(F.log2("ratio") * STEPS), F.lit(-(2**20))))
    kids = cut(kids)  # read three times below; without it a level's plan would hold the plans of the levels above three times over
    steps = kids.groupBy(*parent, "step").agg(F.sum("room").alias("r"), F.sum("weight").alias("w"), F.min("ratio").alias("lo"), F.max("budget").alias("budget"))
    up = W.partitionBy(*parent).orderBy("step")
    below = F.coalesce(F.sum("r").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    steps = steps.withColumn("below", below).withColumn("rest", F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing))).withColumn("first", F.row_number().over(up) == 1)
    reached = F.col("first") | (F.col("below") + F.col("lo") * F.col("rest") <= F.col("budget"))
    start = F.max((F.col("budget") - F.col("below")) / F.col("rest")).alias("start")
    at = steps.groupBy(*parent).agg(F.max(F.when(reached, F.struct("step", "below", "rest"))).alias("at"), start).select(*parent, "at.step", "at.below", "at.rest", "start")
    inside = kids.join(at, [*parent, "step"]).groupBy(*parent, "ratio", "below", "rest", "start").agg(F.sum("room").alias("r"), F.sum("weight").alias("w"), F.max("budget").alias("budget"))
    before = W.partitionBy(*parent).orderBy("ratio").rowsBetween(W.unboundedPreceding, -1)
    full, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("r", "w"))
    level = inside.withColumn("level", F.greatest("start", (F.col("budget") - F.col("below") - full) / (F.col("rest") - used))).groupBy(*parent).agg(F.max("level").alias("level"))
    return kids.join(level, parent).withColumn("give", F.least("room", F.col("level") * F.col("weight"))).drop("level", "ratio", "step")


def budgets(leaves: DataFrame, mix: Mix, few: bool = False) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, rows) with ``give``, the whole tokens each may use; ``few``
    says that one task can order them all.

    A parent's room is the sum of its children's, so a shortage is made up among siblings while they
    have room and passes to the parent's siblings only then.  Children of weight zero get nothing.
    """
    at = leaves
    for level in LEVELS:
        at = at.withColumn(f"w_{level}", _weight(mix, level))
    at = at.where(" AND ".join(f"w_{level} > 0" for level in LEVELS)).withColumn("room", F.col("tokens").cast("double") * mix.epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    parts = at
    for depth in range(len(LEVELS)):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        rooms = at.groupBy(*keys).agg(F.sum("room").alias("room"), F.first(f"w_{LEVELS[depth]}").alias("weight"))
        if depth == 0:
            above = rooms.withColumn("budget", F.lit(float(total) * mix.share)).withColumn("__all", F.lit(0))
            parent = ["__all"]
        else:
            above = rooms.join(parts.select(*parent, "budget"), parent)
        parts = _share_out(above, parent, few).select(*keys, F.col("give").alias("budget"))
    return leaves.join(parts, list(LEVELS)).withColumn("give", F.floor(F.col("budget") + 1e-6)).drop("budget")


def _place(seed: int, epoch: Column, doc: Column) -> Column:
    """52 bits that order a leaf's documents in an epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def _bucket(place: Column, buckets: Column) -> Column:
    """The first 40 bits of the place as a part of all buckets; in two halves, as their product may need more than 64 bits."""
    high, low = F.shiftright(place, 32), F.shiftright(place, 12).bitwiseAND(F.lit(2**20 - 1))
    return F.shiftright(high * buckets + F.shiftright(low * buckets, 20), 20)


def cuts(rows: DataFrame, mix: Mix) -> DataFrame:
    """What each leaf uses: ``domain, lang, source, whole`` (epochs used in full) and the last place
    and id of the next epoch's prefix (``end_place, end_id``; null if it has none).

    ``rows`` has the leaf, ``doc_id`` and ``n_tokens`` of every document.  A leaf's order is divided into
    buckets of about ``ROWS_PER_BUCKET`` rows by place; bucket sums are combined before the shuffle, and
    only the one bucket per leaf in which the budget ends is ordered, by place and id; rows that share
    both are summed first.  No task sees a leaf.
    """
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    few = leaves.count() <= BROADCAST_LEAVES
    plan = budgets(leaves, mix, few).where("tokens > 0")
    plan = plan.withColumn("whole", F.floor(F.col("give") / F.col("tokens"))).withColumn("rest", F.col("give") - F.col("whole") * F.col("tokens"))
    plan = cut(plan.withColumn("buckets", F.ceil(F.col("rows") / ROWS_PER_BUCKET)).select(*LEVELS, "whole", "rest", "buckets"))
    held = rows.join(F.broadcast(plan) if few else plan, list(LEVELS))
    held = held.withColumn("place", _place(mix.seed, F.col("whole"), F.col("doc_id"))).withColumn("bucket", _bucket(F.col("place"), F.col("buckets")))
    sums = held.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket"))
    last = sums.withColumn("upto", upto).where("upto > rest AND upto - n <= rest").select(*LEVELS, "bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    within = F.sum("n_tokens").over(W.partitionBy(*LEVELS, "bucket").orderBy("place", "doc_id"))
    ends = held.drop("rest").join(F.broadcast(last) if few else last, [*LEVELS, "bucket"]).groupBy(*LEVELS, "bucket", "left", "place", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    ends = ends.withColumn("within", within).where("within <= left")
    ends = ends.groupBy(*LEVELS).agg(F.max(F.struct("place", "doc_id")).alias("end"))
    joined = plan.join(last.select(*LEVELS, "bucket"), list(LEVELS), "left").join(ends, list(LEVELS), "left")
    return cut(joined.select(*LEVELS, "whole", "buckets", "bucket", F.col("end.place").alias("end_place"), F.col("end.doc_id").alias("end_id")))


def _leafed(docs: DataFrame, id_col: str, text_col: str, domain: Column | None) -> DataFrame:
    empty = F.lit("")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(domain if domain is not None else domain_of(F.col("source")), empty).alias("domain"),
        F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"),
        token_count(F.col(text_col)).alias("n_tokens"),
    )


def _picked(rows: DataFrame, ends: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` once for each epoch that uses them, with ``epoch``: a test of each row against its leaf."""
    few = ends.count() <= BROADCAST_LEAVES
    at = rows.join(F.broadcast(ends) if few else ends, list(LEVELS))
    place = _place(mix.seed, F.col("whole"), F.col("doc_id"))
    before = F.struct(place, F.coalesce(F.col("doc_id"), F.lit(-(2**63)))) <= F.struct("end_place", F.coalesce(F.col("end_id"), F.lit(-(2**63))))
    partly = (_bucket(place, F.col("buckets")) < F.col("bucket")) | ((_bucket(place, F.col("buckets")) == F.col("bucket")) & F.col("end_place").isNotNull() & before)
    uses = F.col("whole") + F.when(F.col("bucket").isNotNull() & partly, 1).otherwise(0)
    at = at.withColumn("uses", uses.cast("int")).where("uses > 0")
    return at.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))


def mixture(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None) -> DataFrame:
    """One row per use of a document: ``doc_id, domain, lang, source, n_tokens, epoch``.

    A leaf's documents are used in full for as many epochs as its budget covers; of the next epoch it
    uses the longest prefix, in an order seeded by that epoch's number, that fits the rest.

    Defined cases: null lang and source are values of their own (empty); a null text has no tokens; a
    leaf without tokens is not used; documents of equal place and id stand or fall together; rows are
    not told apart by id; an empty table gives an empty result; other columns are ignored.
    """
    rows = cut(_leafed(docs, id_col, text_col, domain))
    return _picked(rows, cuts(rows, mix), mix).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents that the mixture uses, once for each use; columns as they are.

    The texts are not shuffled: each row is tested against its leaf's cut.
    """
    names = docs.columns
    rows = cut(_leafed(docs, "doc_id", "text", None))
    ends = cuts(rows, mix)
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("__doc"), F.col("doc_id").cast("long").alias("doc_id"),
        domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    )
    return _picked(whole, ends, mix).select(*(F.col(f"__doc.`{c}`").alias(c) for c in names))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"))


def mixture_sql(documents: str = "documents", mix: Mix = Mix()) -> str:
    """The same for DuckDB, over the table or query named ``documents``."""

    def case(level: str) -> str:
        whens = " ".join(f"WHEN '{v}' THEN {float(w)}" for v, w in getattr(mix, level).items())
        return f"CASE {level} {whens} ELSE {float(mix.other)} END" if whens else f"{float(mix.other)}"

    levels, parts = "", "top"
    for depth, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: depth + 1])
        parent = ", ".join(LEVELS[:depth])
        over = f"PARTITION BY {parent} " if parent else ""
        join = f"JOIN {parts} USING ({parent})" if parent else "CROSS JOIN top"
        levels += f"""
r{depth} AS (SELECT {keys}, sum(tokens * {float(mix.epochs)}) AS room, any_value({case(level)}) AS weight FROM leaf GROUP BY {keys}),
v{depth} AS (SELECT {keys}, room, weight, (budget - coalesce(sum(room) OVER ({over}ORDER BY room / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER ({over}ORDER BY room / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r{depth} {join}),
b{depth} AS (SELECT {keys}, least(room, max(lv) OVER ({over}) * weight) AS budget FROM v{depth}),"""
        parts = f"b{depth}"
    return f"""
WITH src AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN substr(md5(coalesce(source, '')), 1, 1) IN ('0','1','2','3') THEN 'web' WHEN substr(md5(coalesce(source, '')), 1, 1) IN ('4','5','6','7') THEN 'books'
         WHEN substr(md5(coalesce(source, '')), 1, 1) IN ('8','9','a','b') THEN 'code' ELSE 'papers' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {documents}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM src GROUP BY ALL),
top AS (SELECT sum(tokens) * {mix.share} AS budget FROM leaf),{levels}
plan AS (SELECT domain, lang, source, tokens, floor(budget + 1e-6)::BIGINT AS give FROM leaf JOIN b2 USING (domain, lang, source) WHERE tokens > 0),
cuts AS (SELECT *, give // tokens AS whole, give % tokens AS rest FROM plan),
ord AS (SELECT s.*, whole, rest, ('0x' || substr(md5('{mix.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS place FROM src s JOIN cuts USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST) <= rest AS partly FROM ord),
use AS (SELECT *, whole + CASE WHEN partly THEN 1 ELSE 0 END AS uses FROM run)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(uses))::INTEGER AS epoch FROM use
"""


SQL = mixture_sql()
