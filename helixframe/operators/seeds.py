"""Seeds: table-valued extraction of windows with their places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def uniform(length: Column, q: int, interval: int | Column) -> Column:
    """Start places 0, interval, 2 * interval ... of the full windows of ``q`` symbols; null if none fits."""
    step = interval if isinstance(interval, Column) else F.lit(interval)
    return F.when(length >= q, F.sequence(F.lit(0), length - q, step))


def seeds(strings: DataFrame, q: int, interval: int | Column = 1, id_col: str = "string_id", seq_col: str = "seq", where: Callable[[Column], Column] | None = None, sequences: bool = True) -> DataFrame:
    """``string_id, begin, end, seed``: one row per seed.

    ``where`` is a seeding function of one's own: it takes the length column and returns an array of
    start places.  Places that leave no full window give no seed.
    """
    length = F.length(seq_col)
    starts = where(length) if where else uniform(length, q, interval)
    rows = strings.select(F.col(id_col), F.col(seq_col).alias("__s"), F.explode(starts).alias("begin")).where((F.col("begin") >= 0) & (F.col("begin") + q <= F.length("__s")))
    out = rows.withColumn("end", F.col("begin") + q)
    if sequences:
        out = out.withColumn("seed", S.infix(F.col("__s"), F.col("begin"), F.col("end")))
    return out.drop("__s")


def reseeds(strings: DataFrame, q: int, interval: int, rounds: int, id_col: str = "string_id", seq_col: str = "seq") -> DataFrame:
    """Seeds of ``rounds`` rounds; round r starts r * (interval div rounds) symbols in.  Adds ``retry``."""
    many = strings.withColumn("retry", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    start = F.col("retry") * (interval // rounds)
    length = F.length(seq_col)
    rows = many.withColumn("begin", F.explode(F.when(length >= q + start, F.sequence(start, length - q, F.lit(interval)))))
    return rows.select(F.col(id_col), "retry", "begin", (F.col("begin") + q).alias("end"), S.infix(F.col(seq_col), F.col("begin"), F.col("begin") + q).alias("seed"))
