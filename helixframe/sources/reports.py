"""Run statistics of alignments, and their report as HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that a report shows.
ROWS = 1000


def run_statistics(alignments: DataFrame, mapq: str = "mapq", flag: str = "flag", second: str = "second_score", score: str = "score") -> DataFrame:
    """``section, bin, n`` of a run: reads, mapped, unique and ambiguous ones, and reads by mapping quality
    and by the difference of the best two scores (bins of powers of two).  One pass, combined before its shuffle."""
    from ..operators.diff import log_bin

    mapped = F.col(flag).bitwiseAND(4) == 0
    gap = F.col(score) - F.col(second)
    row = lambda section, test, bin_: F.when(test, F.struct(F.lit(section).alias("section"), bin_.cast("long").alias("bin")))
    zero = F.lit(0)
    marks = F.array(
        row("reads", F.lit(True), zero), row("mapped", mapped, zero), row("unique", mapped & F.col(second).isNull(), zero),
        row("ambiguous", mapped & F.coalesce(gap == 0, F.lit(False)), zero), row("mapq", mapped, F.col(mapq)), row("score_gap", mapped & gap.isNotNull(), log_bin(gap)),
    )
    return alignments.select(F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("x")).groupBy("x.section", "x.bin").agg(F.count("*").alias("n"))


def html_table(rows: DataFrame, title: str, *order: str) -> str:
    """A table of a small result, at most ``ROWS`` rows in the order asked for, with a bar for the last column."""
    got = rows.orderBy(*order).limit(ROWS).collect()
    most = max((r[-1] for r in got if isinstance(r[-1], int | float)), default=0) or 1
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape('' if c is None else str(c))}</{tag}>" for c in cells)
    bar = lambda v: f'<td><div class="bar" style="width:{100 * v / most:.1f}%"></div></td></tr>' if isinstance(v, int | float) else "<td></td></tr>"
    body = "\n".join(line("td", r) + bar(r[-1]) for r in got)
    return f"<h2>{html.escape(title)}</h2>\n<table>\n{line('th', rows.columns)}<th></th></tr>\n{body}\n</table>\n"


def write_html(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], path: str, title: str = "Report") -> None:
    """A page of titled tables (frame and order), as a one-part text folder at ``path``."""
    style = "table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px;text-align:left}.bar{background:#48c;height:8px;min-width:1px}"
    parts = [html_table(df, name, *order) for name, (df, order) in tables.items()]
    page = f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title><style>{style}</style></head>\n<body>\n<h1>{html.escape(title)}</h1>\n{''.join(parts)}</body></html>"
    spark = next(iter(tables.values()))[0].sparkSession
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.text(path)
