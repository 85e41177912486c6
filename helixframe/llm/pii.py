"""Personal data: base patterns, and contextual extraction bootstrapped from what they find."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, read_table

KINDS = ("email", "ip", "card", "phone")
#: Rounds of the pattern-instance graph, and what a pattern needs to be trusted.
ROUNDS = 3
PATTERN_SCORE = 0.8
PATTERN_SEEDS = 3
#: An instance that patterns alone support counts as known in the next round from this score on.
INSTANCE_SCORE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match cannot begin inside a run of digits, as it would have begun with the run; so each run is read once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A token that could be an identifier has a digit or an at sign among these characters.
_MARK = re.compile(r"[0-9@]")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@()-")
_TOKEN_REST = re.compile(r"[A-Za-z0-9._%+@()-]*")
_WORDS_BEFORE = re.compile(r"([^\W\d_]+)[^\w\n]+(?:([^\W\d_]+)[^\w\n]+)?\Z")
#: Code points before a span in which its context is looked for.
_CONTEXT = 80


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every at sign has one possible start, the run of local characters before it; so texts are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _only(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base patterns in code points, by kind and start; failing matches go."""
    text, out = text or "", []
    out += [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _only(m[0])) <= 19 and luhn(d)]
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only(m[0])) <= 15]
    return out


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at sign, found from those characters outwards."""
    done, m = 0, _MARK.search(text)
    while m:
        start = m.start()
        while start > done and text[start - 1] in _TOKEN:
            start -= 1
        done = _TOKEN_REST.match(text, m.end()).end()
        yield start, done
        m = _MARK.search(text, done)


def shape(token: str) -> str:
    """The form of a token: runs of letters, digits and signs."""
    return re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", token))[:24]


def context(text: str, start: int) -> list[str]:
    """Up to two lexical patterns: the word, and the two words, before a span on its line."""
    m = _WORDS_BEFORE.search(text[max(0, start - _CONTEXT) : start])
    if not m:
        return []
    first, second = m[1].lower(), (m[2] or "").lower()
    return [first] if not second else [second, f"{first} {second}"]


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row, doc_id, base, seen``.

    ``base`` holds the base spans; ``seen`` holds, for seeds and for candidates that no base pattern
    finds, the place, the kind (-1 for candidates), the patterns around it, and the instance's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, seen = [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                bases.append([{"k": k, "s": s, "e": e} for k, s, e in spans])
                here = [(k, s, e) for k, s, e in spans]
                taken, at = sorted((s, e) for _, s, e in spans), 0
                for s, e in candidates(text):
                    while at < len(taken) and taken[at][1] <= s:
                        at += 1
                    if (at == len(taken) or taken[at][0] >= e) and e - s >= 5:
                        here.append((-1, s, e))
                rows = []
                for k, s, e in here:
                    own = text[s:e]
                    form = shape(own)
                    name = int.from_bytes(hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    if patterns := context(text, s):
                        rows.append({"k": k, "s": s, "e": e, "patterns": patterns, "form": form, "name": name})
                seen.append(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(bases, pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))),
                    pa.array(seen, pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("patterns", pa.list_(pa.string())), ("form", pa.string()), ("name", pa.int64())]))),
                ],
                names=["doc_id", "base", "seen"],
            )

    kind = "array<struct<k:int,s:int,e:int>>"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(run, f"doc_id long, base {kind}, seen array<struct<k:int,s:int,e:int,patterns:array<string>,form:string,name:bigint>>")
    return cut(out.select(F.monotonically_increasing_id().alias("row"), "*"))


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, k, p)``: patterns that may name new instances of a kind, with their scores.

    The graph has an edge for each pattern-instance pair that occurs.  A pattern's score for a kind is
    the part of its distinct instances, weighted by their own scores, that are of the kind; instances of
    unknown kind speak against it unless they have the form (``shape``) of a known instance of the kind.
    A pattern needs ``PATTERN_SEEDS`` instances of the kind.  An instance's score is the probability that
    one of its trusted patterns is right.  Seeds have the score one.  Sums per pattern and per instance
    are combined before their shuffles, so a pattern on a third of all rows costs one row per task; the
    forms are written before they are joined, so that a common form's partition can be split.
    """
    edges = cut(seen.select(F.explode("patterns").alias("pattern"), "name", "form", "k").groupBy("pattern", "name").agg(F.max("k").alias("k"), F.max("form").alias("form")))
    base = cut(edges.where("k >= 0").select("name", "k", F.lit(1.0).alias("score")).distinct())
    known, out = base, None
    for _ in range(rounds):
        tagged = edges.select("pattern", "name", "form").join(known, "name", "left")
        hits = tagged.where("k IS NOT NULL").groupBy("pattern", "k").agg(F.sum("score").alias("hit"))
        every = tagged.groupBy("pattern").agg(F.sum(F.coalesce("score", F.lit(1.0))).alias("n"))
        forms = cut(tagged.where("k IS NOT NULL").select("form", "k").distinct())
        other = tagged.where("k IS NULL").groupBy("pattern", "form").agg(F.count("*").alias("n"))
        alike = other.join(forms, "form").groupBy("pattern", "k").agg(F.sum("n").alias("alike"))
        rated = hits.join(every, "pattern").join(alike, ["pattern", "k"], "left").withColumn("p", F.col("hit") / (F.col("n") - F.coalesce("alike", F.lit(0))))
        out = cut(rated.where((F.col("p") >= PATTERN_SCORE) & (F.col("hit") >= PATTERN_SEEDS)).select("pattern", "k", "p"))
        new = edges.where("k < 0").select("pattern", "name").join(out, "pattern").groupBy("name", "k").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("score"))
        best = new.where(F.col("score") >= INSTANCE_SCORE).groupBy("name").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
        best = best.select("name", (-F.col("b.k")).alias("k"), "b.score").join(base.select("name"), "name", "left_anti")
        known = cut(base.unionByName(best))
    return out


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, base, spans`` (arrays of ``(k, s, e)``, ``k`` an index of ``KINDS``).

    ``spans`` adds to the base spans the candidates that a trusted pattern discovers.  The texts are read
    in one pass and not shuffled.  Defined cases: a null text counts as empty; a text without personal
    data has empty arrays; repeated rows and null ids are rows of their own; without seeds nothing is
    added; an empty table gives an empty result; other columns are ignored.
    """
    rows = occurrences(docs, id_col, text_col)
    seen = rows.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    trusted = trusted_patterns(seen)
    found = seen.where("k < 0").select("row", "s", "e", F.explode("patterns").alias("pattern")).join(trusted.select("pattern", "k", "p"), "pattern")
    best = found.groupBy("row", "s", "e").agg(F.max(F.struct("p", (-F.col("k")).alias("k"))).alias("b"))
    added = best.groupBy("row").agg(F.collect_list(F.struct((-F.col("b.k")).cast("int").alias("k"), "s", "e")).alias("added"))
    out = rows.select("row", "doc_id", "base").join(added, "row", "left")
    more = F.coalesce("added", F.expr("cast(array() AS array<struct<k:int,s:int,e:int>>)"))
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", more)).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    out = find_personal(read_table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
