"""Language identification by a bit-sliced Bloom filter of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, read_table

#: Positions of the filter (powers of two, least and most): about ``SPARE`` for each n-gram that it holds.
POSITIONS = (1 << 18, 1 << 24)
SPARE = 8
#: The filter has half the positions while it would be larger than this, in bytes.
FILTER_BYTES = 1 << 28
#: Positions an n-gram sets.
HASHES = 3
#: A language contains an n-gram that it has so often, both as a count and as a part of all its n-grams, and at
#: least this part as often as the language that has it most.
LEAST_COUNT = 2
LEAST_RATE = 1e-7
LEAST_PART = 0.2
#: Bytes of an n-gram.
N = 4
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Odd multipliers of the hash functions.
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def grams(text: str) -> np.ndarray:
    """The n-grams of a text's words: bytes of the lower-cased UTF-8 text, with one space around each word."""
    words = text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    if not words or len(data) < N:
        return np.empty(0, dtype=np.uint32)
    return data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24


def places(codes: np.ndarray, positions: int = POSITIONS) -> list[np.ndarray]:
    """The filter positions of each n-gram, one array per hash function."""
    shift = np.uint64(64 - (positions.bit_length() - 1))
    wide = codes.astype(np.uint64)
    out = []
    for m in _MIX[:HASHES]:
        h = (wide + np.uint64(1)) * np.uint64(m * 0x9E3779B97F4A7C15 % 2**64 | 1)
        out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift)
    return out


class Filter:
    """Row ``p`` of the filter is the set of languages, as bits of one or more words, that have set position ``p``."""

    def __init__(self, table: np.ndarray, languages: list[str]):
        self.table, self.languages = table.reshape(len(table), -1), languages
        self.bits = self.table.dtype.itemsize * 8
        fill = np.array([np.count_nonzero(self.of(self.table, k)) for k in range(len(languages))]) / len(table)
        #: The rate at which a language claims an n-gram that it has not stored.
        self.false = fill**HASHES

    def of(self, rows: np.ndarray, language: int) -> np.ndarray:
        """The bit of a language in rows of the table."""
        return rows[:, language // self.bits] & self.table.dtype.type(1 << language % self.bits)

    def containing(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits of words."""
        out = None
        for p in places(codes, len(self.table)):
            got = self.table[p]
            out = got if out is None else out & got
        return out

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """Per language the number of n-grams it contains, corrected for false positives."""
        n, got = len(self.languages), self.containing(codes)
        if self.bits <= 16 and self.table.shape[1] == 1:
            masks = np.bincount(got[:, 0].astype(np.int64), minlength=1)
            at = np.flatnonzero(masks)
            hits = np.array([masks[at[(at >> k) & 1 == 1]].sum() for k in range(n)], dtype=float)
        else:
            hits = np.array([np.count_nonzero(self.of(got, k)) for k in range(n)], dtype=float)
        return np.maximum(0.0, (hits - len(codes) * self.false) / np.maximum(1e-9, 1 - self.false))

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and a score from 0 to 1: its corrected count's lead, as a part of all n-grams' claims."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        codes = grams(text)
        c = self.counts(codes) if len(codes) else np.zeros(len(self.languages))
        best = int(np.argmax(c))
        return self.languages[best], float(c[best] / c.sum()) if c.sum() > 0 else 0.0


def learn(docs: DataFrame, positions: int | None = None) -> Filter:
    """A filter of the n-grams of ``docs`` (``text``, ``lang``; rows with a null in either are left out).

    N-grams are counted per language over all rows: each task adds up what it has seen and gives partial
    counts, which are combined by language and n-gram.  The n-grams a language contains are spread over
    the filter's positions and combined by ``bit_or``.  There are as many positions as those n-grams ask
    for, within ``POSITIONS`` and ``FILTER_BYTES``; each holds a bit per language, in as many words as
    the languages need.  Only the filter and the list of languages with their sizes reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def settle():
            for lang, parts in held.items():
                c, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in kept:
                    both = np.concatenate([kept[lang][0], c])
                    c, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([kept[lang][1], n])).astype(np.int64)
                kept[lang] = (c, n)
            held.clear()

        def give():
            for lang, (c, n) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            kept.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = grams(text)
                held.setdefault(lang, []).append(codes)
                size += len(codes)
                if size > 4_000_000:
                    settle()
                    size = 0
            if sum(len(c) for c, _ in kept.values()) > 2_000_000:
                settle()
                yield from give()
        settle()
        yield from give()

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counted = cut(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = sorted((r.lang, r.total) for r in counted.groupBy("lang").agg(F.sum("n").alias("total")).collect())
    languages = [lang for lang, _ in sizes]
    n = len(languages)
    if not n:
        return Filter(np.zeros(POSITIONS[0], np.uint8), [])
    kind = next(t for t in (np.uint8, np.uint16, np.uint64) if n <= np.iinfo(t).bits or t is np.uint64)
    words = -(-n // 64)
    # one row per language: the same bound as the list that reaches the driver
    known = docs.sparkSession.createDataFrame([(lang, total, k // 64, 1 << k % 64 if k % 64 < 63 else -(2**63)) for k, (lang, total) in enumerate(sizes)], "lang string, total long, word int, bit long")
    rated = counted.join(F.broadcast(known), "lang").withColumn("rate", F.col("n") / F.col("total"))
    per_gram = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("n", "rate", "word", "bit")).alias("of"))  # one entry per language
    has = F.filter("of", lambda x: (x["n"] >= LEAST_COUNT) & (x["rate"] >= LEAST_RATE) & (x["rate"] >= LEAST_PART * F.col("top")))
    per_word = per_gram.select("gram", has.alias("has")).where(F.size("has") > 0)
    per_word = per_word.select("gram", "has", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word")) if words > 1 else per_word.withColumn("word", F.lit(0))
    own = F.filter("has", lambda x: x["word"] == F.col("word"))
    masks = cut(per_word.select("gram", "word", F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["bit"])).alias("mask")).where("mask <> 0"))
    if positions is None:
        positions = POSITIONS[0]
        while positions < min(POSITIONS[1], SPARE * masks.select("gram").count()):
            positions *= 2
        while positions > POSITIONS[0] and positions * words * np.dtype(kind).itemsize > FILTER_BYTES:
            positions //= 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in places(b.column(0).to_numpy().astype(np.uint32), positions):
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), b.column(1), b.column(2)], names=["p", "word", "mask"])

    filled = masks.mapInArrow(spread, "p long, word int, mask long").groupBy("p", "word").agg(F.bit_or("mask").alias("mask"))
    got = filled.toArrow()
    table = np.zeros((positions, words), dtype=kind)
    table[got.column("p").to_numpy(), got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64).astype(kind)
    return Filter(table, languages)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3))


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``; one narrow pass over the whole texts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.table, model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(*sent.value)
        for b in batches:
            got = [own.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learned from the documents that are not held out.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if
    there is nothing to learn from; a text whose n-grams no language contains gets the first language
    and score 0; of languages with equal counts the first by name is taken; a null id belongs to the fold
    of the empty text; rows that repeat an id or a text are rows of their own, each learned from; very
    long texts are read whole; an empty table gives an empty result; other columns are ignored.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(fold_of(F.col("doc_id")) != 1))
    out = identify(docs, model)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
