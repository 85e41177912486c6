"""Toxicity by a classifier chain of linear models over words and word beginnings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, read_table

#: The categories in the order of the chain, and when a row of ``labels`` has them.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
#: Labelled documents that the models are fitted on, at most (those with the smallest hashes of the id).
SAMPLE = 12_000
#: Features a category's model may use.
FEATURES = 1024
FOLDS = 5
THRESHOLD = 0.5
#: Words whose features a worker remembers, and documents whose features it holds at once.
REMEMBERED = 200_000
AT_ONCE = 1000

WORD = re.compile(r"[^\W\d_]+")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SIGN = re.compile(r"[^\w\s]")


def shape(text: str) -> list[str]:
    """Features of how a text is written: its capitals, its signs and its length, in steps."""
    n = len(text) or 1
    upper = len(CAPITAL.findall(text))
    signs = len(SIGN.findall(text))
    return [f" up{min(9, 10 * upper // n)}", f" sign{min(9, 20 * signs // n)}", f" long{n.bit_length()}"]


def word_features(word: str) -> list[str]:
    """A word and its beginnings of 3 to 8 letters."""
    return [word, *(word[:k] + "*" for k in range(3, min(9, len(word))))]


def features(text: str | None) -> set[str]:
    text = text or ""
    out = set(shape(text))
    for w in set(WORD.findall(text.lower())):
        out.update(word_features(w))
    return out


# ---------------------------------------------------------------- one linear model


def fit_logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, l2: float = 0.5, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression: ``width`` binary features, ``extra`` dense columns, a constant.

    ``rows`` and ``cols`` are the places of the ones.  Newton steps, each solved by conjugate gradients
    and halved while it does not lower the loss.
    """
    n, k = len(y), extra.shape[1]
    w = np.zeros(width + k + 1)
    if not n:
        return w
    ridge = np.append(np.full(width + k, l2), 1e-6)

    def forward(u):
        return np.bincount(rows, weights=u[cols], minlength=n) + extra @ u[width : width + k] + u[-1]

    def backward(r):
        return np.concatenate([np.bincount(cols, weights=r[rows], minlength=width), extra.T @ r, [r.sum()]])

    def loss(u, z):
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * u * u).sum()

    z = forward(w)
    now = loss(w, z)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, curve = backward(p - y) + ridge * w, p * (1 - p) + 1e-9
        step, left = np.zeros_like(w), -g
        way, size = left.copy(), left @ left
        first = size
        for _ in range(30):
            if size <= 1e-4 * first:
                break
            bent = backward(curve * forward(way)) + ridge * way
            far = size / (way @ bent)
            step += far * way
            left -= far * bent
            size, was = left @ left, size
            way = left + (size / was) * way
        t = 1.0
        while t > 1e-4 and loss(w + t * step, forward(w + t * step)) > now:
            t /= 2
        w = w + t * step
        z = forward(w)
        was, now = now, loss(w, z)
        if was - now < 1e-4 * abs(was):
            break
    return w


def predict(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
    width = len(w) - 1 - extra.shape[1]
    z = np.bincount(rows, weights=w[cols], minlength=n) + extra @ w[width:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# ---------------------------------------------------------------- the chain


@dataclass
class Chain:
    """Linear models in sequence; each sees the probabilities of the ones before it."""

    categories: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    held_out: list[np.ndarray] = field(default_factory=list)

    def fit(self, rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, known: np.ndarray, folds: np.ndarray, run=map) -> Chain:
        """``labels`` and ``known``: documents x categories.  Earlier probabilities that a later model is
        trained with come from models that have not seen the document (one per fold).  ``run(f, items)``
        maps a category's fits, which do not depend on each other."""
        n, width = len(labels), len(self.vocabulary)
        extra = np.zeros((n, 0))
        for c in range(len(self.categories)):
            y, ok = labels[:, c].astype(float), known[:, c]

            def fit_without(fold, y=y, ok=ok, extra=extra):
                mask = ok & (folds != fold)
                at = np.flatnonzero(mask)
                new = np.full(n, -1)
                new[at] = np.arange(len(at))
                own = mask[rows] if len(rows) else np.zeros(0, bool)
                return fit_logistic(new[rows[own]], cols[own], extra[at], y[at], width)

            whole, *parts = run(fit_without, [-1, *range(FOLDS)])
            self.weights.append(whole)
            out = np.zeros(n)
            for f, w in enumerate(parts):
                out[folds == f] = predict(w, rows, cols, extra, n)[folds == f]
            self.held_out.append(out)
            extra = np.column_stack([extra, out])
        return self

    def score(self, texts: list[str | None], memory: dict) -> np.ndarray:
        """Probabilities, documents x categories."""
        rows, cols, vocabulary = [], [], self.vocabulary
        for i, text in enumerate(texts):
            text = text or ""
            found = {vocabulary[s] for s in shape(text) if s in vocabulary}
            for w in set(WORD.findall(text.lower())):
                got = memory.get(w)
                if got is None:
                    got = tuple(vocabulary[s] for s in word_features(w) if s in vocabulary)
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    if len(w) <= 64:
                        memory[w] = got
                if got:
                    found.update(got)
            cols.extend(found)
            rows.extend([i] * len(found))
        r, c, n = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), len(texts)
        extra = np.zeros((n, 0))
        for w in self.weights:
            extra = np.column_stack([extra, predict(w, r, c, extra, n)])
        return extra


def on_executors(spark: SparkSession):
    """``map`` over a few items, one task each, of a function that gives an array of doubles."""

    def run(f, items: list) -> list[np.ndarray]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f(items[i]).tolist()], pa.list_(pa.float64()))], names=["id", "w"])

        got = spark.range(0, len(items), 1, len(items)).mapInArrow(each, "id long, w array<double>").collect()
        return [np.array(r.w) for r in sorted(got, key=lambda r: r.id)]

    return run


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> Chain:
    """Fit a chain on at most ``sample`` labelled documents.

    The sampled labels (ids and bits, bounded by ``sample``) are broadcast to the documents; of documents
    that repeat an id the one whose text has the smallest hash, then the smallest text, is learned from
    (a null text only if there is no other), so at most ``sample`` rows are written and gathered.  Features are counted per category by Spark over that sample, the most
    telling ones by chi-square are kept, and the fits, some thousand features wide, each run in a task
    that is sent the sample's features.  Labels that repeat a document are joined by "any"; null labels are not learned from.
    """
    names = [c for c, _ in chain]
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(*(F.max(F.expr(rule).cast("int")).alias(c) for c, rule in chain))
    one = one.where(" OR ".join(f"{c} IS NOT NULL" for c in names)).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("__d"), F.col("text").alias("__t"), F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t")).alias("__o"))
    texts = texts.withColumn("__o", F.when(F.col("__t").isNotNull(), F.col("__o")))
    told = texts.join(F.broadcast(one), F.col("__d") == F.col("__id")).groupBy("__d").agg(F.min("__o").alias("__o"), *(F.first(c).alias(c) for c in names))
    rows = cut(told.select("__d", F.col("__o.t").alias("__t"), *names))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, counts = np.zeros((len(names), 2), dtype=np.int64), [(Counter(), Counter()) for _ in names]
        for b in batches:
            got = b.to_pydict()
            for i, t in enumerate(got["__t"]):
                found = features(t)
                for k, c in enumerate(names):
                    if (y := got[c][i]) is not None:
                        sizes[k, y] += 1
                        counts[k][y].update(found)
        for k in range(len(names)):
            for y in (0, 1):
                items = [("", int(sizes[k, y])), *((f, n) for f, n in counts[k][y].items())]
                for at in range(0, len(items), 10_000):
                    part = items[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(part), pa.int32()), pa.array([y] * len(part), pa.int32()), pa.array([p[0] for p in part]), pa.array([p[1] for p in part], pa.int64())],
                        names=["k", "y", "feature", "n"],
                    )

    counted = rows.mapInArrow(tally, "k int, y int, feature string, n long")
    counted = cut(counted.groupBy("k", "feature").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b")))
    model = Chain(names)
    wanted: set[str] = set()
    totals = {r.k: (r.a, r.b) for r in counted.where("feature = ''").collect()}
    for k in range(len(names)):
        pos, neg = totals.get(k, (0, 0))
        if not pos or not neg:
            continue
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        top = a * (neg - b) - b * (pos - a)
        chi = top * top * (pos + neg) / ((a + b) * (pos + neg - a - b) * pos * neg)
        best = counted.where((F.col("k") == k) & (F.col("feature") != "") & (F.col("a") + F.col("b") >= 3) & (F.col("a") + F.col("b") < pos + neg))
        wanted |= {r.feature for r in best.orderBy(chi.desc(), "feature").limit(FEATURES).collect()}
    model.vocabulary = {f: i for i, f in enumerate(sorted(wanted))}
    vocabulary = model.vocabulary

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(vocabulary[f] for f in features(t) if f in vocabulary) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), *b.columns[2:]], names=["d", "at", *names])

    # bounded: at most `sample` rows of at most len(chain) * FEATURES small integers
    got = rows.mapInArrow(places, "d long, at array<int>, " + ", ".join(f"{c} int" for c in names)).orderBy("d", *names).collect()
    lens = [len(r["at"]) for r in got]
    r = np.repeat(np.arange(len(got), dtype=np.int32), lens)
    c = np.array([x for row in got for x in row["at"]], dtype=np.int16)
    y = np.array([[row[n] or 0 for n in names] for row in got]).reshape(len(got), len(names))
    known = np.array([[row[n] is not None for n in names] for row in got], dtype=bool).reshape(len(got), len(names))
    folds = np.array([hash((row["d"], 11)) % FOLDS for row in got], dtype=np.int64)
    return model.fit(r, c, y, known, folds, on_executors(docs.sparkSession))


def scorer(model: Chain):
    """A function of a text column that gives a struct of one probability per category."""

    @F.pandas_udf(", ".join(f"{c} double" for c in model.categories))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory: dict = {}
        for s in batches:
            parts = [model.score(s.iloc[at : at + AT_ONCE].tolist(), memory) for at in range(0, len(s), AT_ONCE)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.empty((0, len(model.categories))), columns=model.categories)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, low_quality, toxic`` (probabilities) and ``rejected``.

    Whole texts are scored in one narrow pass.  Defined cases: a null text counts as empty and gets the
    probabilities of a text without features; without labels of both kinds no document is rejected, nor
    is one whose probability equals the threshold; repeated rows and null ids are rows of their own; very
    long texts are scored whole; an empty table gives an empty result; other columns are ignored.
    """
    score = scorer(train(docs, labels))
    src = docs.select(F.col("doc_id"), score(F.coalesce("text", F.lit(""))).alias("p"))
    return src.select("doc_id", "p.low_quality", "p.toxic", (F.col("p.toxic") > threshold).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the chain rejects; columns as they are."""
    score = scorer(train(docs, labels))
    return docs.where(score(F.coalesce("text", F.lit(""))).getField("toxic") <= threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
