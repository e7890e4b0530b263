"""Interval overlap joins on time cells, so one long recording spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.plans.scan import with_carry

CELL_S = 60.0
KEY_SPANS = 16
LONG_CELLS = 1024


def overlap_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], scale: float = 1.0, cell: float = CELL_S, key_spans: int = 0) -> DataFrame:
    """Pairs with ``p_end > s_start and p_start < s_end``.

    ``points`` carries ``p_start, p_end`` and ``spans`` carries ``s_start, s_end``. Both sides are copied
    to every cell they touch; a pair is kept only in the cell of its later start, so no distinct is
    needed. ``scale`` converts the columns' unit to seconds.

    With ``key_spans`` a job over ``spans`` looks at them first. Where no key has more, both sides meet by key alone: points
    that lie together by key are not shuffled, and a span costs the same however long it is. Else, if a span is very long,
    spans go no further than the last point of their key; and where no key has spans in more than ``LONG_CELLS`` cells, a key's
    cells travel together and points find their own cell among them, which moves no point that lies by key either.
    """
    width = F.lit(cell / scale)
    meets = (F.col("p_end") > F.col("s_start")) & (F.col("p_start") < F.col("s_end"))
    reach = F.greatest("s_end", "s_start")
    held = spans
    if key_spans:
        counted = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max((reach - F.col("s_start")) / width).alias("cells"))
        most = counted.agg(F.max("n").alias("n"), F.max("cells").alias("cells")).first()
        if (most.n or 0) <= key_spans:
            return points.join(spans, list(keys)).filter(meets)
        if most.cells > LONG_CELLS:
            held = spans.join(points.groupBy(*keys).agg(F.max(F.greatest("p_start", "p_end")).alias("_last")), list(keys)).filter("s_start <= _last")
            reach = F.least(reach, "_last")

    def cells(frame: DataFrame, start: Column, end: Column) -> DataFrame:
        return frame.withColumn("_cell", F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))))

    pointed = cells(points, F.col("p_start"), F.greatest("p_end", "p_start"))
    offered = cells(held, F.col("s_start"), reach).select(*spans.columns, "_cell")
    if key_spans:
        own = [c for c in spans.columns if c not in keys]
        by_cell = offered.groupBy(*keys, F.col("_cell").alias("_block")).agg(F.collect_list(F.struct(*own)).alias("_spans"))
        met = with_carry(pointed.withColumnRenamed("_cell", "_block"), by_cell, by_cell, keys, most=LONG_CELLS)
        names = [*keys, *[c for c in points.columns if c not in keys]]
        found = met.select(*names, F.col("_block").alias("_cell"), F.explode("_spans").alias("_s")).select(*names, "_cell", "_s.*")
    else:
        found = pointed.join(offered, [*keys, "_cell"])
    return (
        found.filter(meets)
        .filter(F.col("_cell") == F.floor(F.greatest("p_start", "s_start") / width).cast("long"))
        .drop("_cell")
    )
