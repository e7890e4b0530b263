"""Ordered prefix scans that survive a hot key.

A plain ``Window.partitionBy(stream)`` sorts a whole recording in one task. Here the
ordering is cut into blocks first: the window runs inside (key, block), each block is
summarised to one row, and the summaries are scanned the same way over groups of blocks.
A key holding a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_S = 600.0
BLOCK_ROWS = 4096
BLOCK_FAN = 1024
KEY_BLOCKS = 64


def time_block(time: Column, seconds: float = BLOCK_S) -> Column:
    """Block number of a time in seconds."""
    return F.floor(time / F.lit(seconds)).cast("long")


def row_block(ordinal: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of an ordinal."""
    return F.floor(ordinal / F.lit(rows)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session in one process gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessitura-"))
    return context.getCheckpointDir()


def summary(frame: DataFrame) -> DataFrame:
    """Materialises a per-block or per-group summary and cuts its lineage.

    Several later steps read it, and plans that nest one scan in another would otherwise repeat the
    pass over the rows for each. The checkpoint goes to the cluster's shared folder, so a lost
    executor costs nothing.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def dealt_once(frame: DataFrame, parts: int, key: str) -> DataFrame:
    """Rows dealt over ``parts`` by ``key`` and sorted by it, for all jobs that read them.

    Each job over a frame that holds a shuffle writes that shuffle anew; this one is written by the first job and read by the
    others. Later steps still see how the rows lie. Nothing is kept beside the shuffle itself, and what a lost executor
    held of it is made again.
    """
    spark = frame.sparkSession
    dealt = frame.repartition(parts, key).sortWithinPartitions(key)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    # An adaptive plan does not tell how its rows lie.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        classes = spark.sparkContext._jvm.org.apache.spark.sql
        rows = getattr(getattr(classes.execution, "LogicalRDD$"), "MODULE$").fromDataset(dealt._jdf.queryExecution().toRdd(), dealt._jdf, False)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return DataFrame(classes.classic.Dataset.ofRows(spark._jsparkSession, rows), spark)


def block_prefix(
    blocks: DataFrame,
    keys: Sequence[str],
    block: str,
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    maxs: Sequence[str] = (),
    fan: int = BLOCK_FAN,
    reverse: bool = False,
) -> DataFrame:
    """Exclusive prefix of per-block summaries, in place.

    ``blocks`` has one row per (keys, block). Sums become the total of earlier blocks, lasts the
    newest non-null earlier value, maxs the earlier maximum. ``reverse`` scans from the far end.
    """
    group = F.floor(F.col(block) / F.lit(fan)).cast("long")
    step = F.desc if reverse else F.asc
    inner = Window.partitionBy(*keys, "_grp").orderBy(step(block)).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(step("_grp")).rowsBetween(Window.unboundedPreceding, -1)
    grouped = blocks.withColumn("_grp", group)
    newest = F.min_by if reverse else F.max_by
    tops = grouped.groupBy(*keys, "_grp").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[newest(F.col(c), F.when(F.col(c).isNotNull(), F.col(block))).alias(c) for c in lasts],
        *[F.max(c).alias(c) for c in maxs],
    )
    tops = tops.select(
        *keys,
        "_grp",
        *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_t_{c}") for c in sums],
        *[F.last(c, ignorenulls=True).over(outer).alias(f"_t_{c}") for c in lasts],
        *[F.max(c).over(outer).alias(f"_t_{c}") for c in maxs],
    )
    local = grouped.select(
        *[c for c in grouped.columns if c not in {*sums, *lasts, *maxs}],
        *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(c) for c in sums],
        *[F.last(c, ignorenulls=True).over(inner).alias(c) for c in lasts],
        *[F.max(c).over(inner).alias(c) for c in maxs],
    )
    joined = local.join(tops, [*keys, "_grp"], "left")
    return joined.select(
        *[c for c in local.columns if c not in {*sums, *lasts, *maxs, "_grp"}],
        *[(F.col(c) + F.col(f"_t_{c}")).alias(c) for c in sums],
        *[F.coalesce(F.col(c), F.col(f"_t_{c}")).alias(c) for c in lasts],
        *[F.greatest(F.col(c), F.col(f"_t_{c}")).alias(c) for c in maxs],
    )


def with_carry(
    rows: DataFrame, carried: DataFrame, heads: DataFrame, keys: Sequence[str], how: str = "inner", most: int = KEY_BLOCKS
) -> DataFrame:
    """Joins each row to the carry of its (keys, ``_block``); ``heads`` is the materialised summary behind ``carried``.

    Where no key has more than ``most`` blocks, a key's carries travel as one map and rows meet it by key, so rows that
    lie together by key already are not shuffled again; by the first key alone where that has few blocks. Else rows meet
    their block's carry, so a hot key spreads.
    """
    names = [c for c in carried.columns if c not in {*keys, "_block"}]
    for near in [list(keys[:n]) for n in sorted({1, len(keys)})]:
        if not heads.groupBy(*near).count().filter(F.col("count") > most).isEmpty():
            continue
        place = [*[k for k in keys if k not in near], "_block"]
        spot = F.struct(*place) if len(place) > 1 else F.col("_block")
        sound = reduce(and_, [F.col(k).isNotNull() for k in place])
        packed = carried.filter(sound).groupBy(*near).agg(
            F.map_from_entries(F.collect_list(F.struct(spot.alias("k"), F.struct(*names).alias("v")))).alias("_carry")
        )
        joined = rows.join(packed, near, how).withColumn("_at", F.when(sound, F.col("_carry")[spot]))
        if how == "inner":
            joined = joined.filter(F.col("_at").isNotNull())
        return joined.select(*rows.columns, *[F.col("_at")[n].alias(n) for n in names])
    return rows.join(carried, [*keys, "_block"], how)


def _one_block(heads: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every key lies in the same single block, so that nothing is carried from one to another."""
    whole = reduce(and_, [F.col(c).isNotNull() for c in [*keys, "_block"]])
    found = heads.agg(F.min("_block").alias("low"), F.max("_block").alias("high"), F.min(whole).alias("whole")).first()
    return bool(found["whole"]) and found["low"] == found["high"]


def prefix_scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Adds exclusive prefixes over ``order`` within ``keys`` to every row.

    ``block`` must be monotone in ``order``. ``lasts`` gives the newest earlier non-null value, which
    is ``lag`` (or ``lead`` when ``reverse``) for a column that is never null.
    """
    sums, lasts, maxs = dict(sums or {}), dict(lasts or {}), dict(maxs or {})
    direction = [F.desc(c) if reverse else F.asc(c) for c in order]
    window = (
        Window.partitionBy(*keys, "_block").orderBy(*direction).rowsBetween(Window.unboundedPreceding, -1)
    )
    source = rows.withColumn("_block", block)
    position = F.struct(*order)
    newest = F.min_by if reverse else F.max_by
    heads = summary(
        source.groupBy(*keys, "_block").agg(
            *[F.sum(e).alias(f"_h_{n}") for n, e in sums.items()],
            *[newest(e, F.when(e.isNotNull(), position)).alias(f"_h_{n}") for n, e in lasts.items()],
            *[F.max(e).alias(f"_h_{n}") for n, e in maxs.items()],
        )
    )
    local = source.select(
        "*",
        *[F.coalesce(F.sum(e).over(window), F.lit(0)).alias(f"_l_{n}") for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(window).alias(f"_l_{n}") for n, e in lasts.items()],
        *[F.max(e).over(window).alias(f"_l_{n}") for n, e in maxs.items()],
    )
    if _one_block(heads, keys):
        return local.select(*rows.columns, *[F.col(f"_l_{n}").alias(n) for n in [*sums, *lasts, *maxs]])
    # Only blocks with others before them are carried anything, so keys of one block send nothing.
    carried = block_prefix(
        heads.withColumn("_before", F.lit(1).cast("long")),
        keys,
        "_block",
        sums=["_before", *[f"_h_{n}" for n in sums]],
        lasts=[f"_h_{n}" for n in lasts],
        maxs=[f"_h_{n}" for n in maxs],
        reverse=reverse,
    ).filter(F.col("_before") > 0).drop("_before")
    placed = reduce(and_, [F.col(c).isNotNull() for c in [*keys, "_block"]])
    return with_carry(local, carried, carried, keys, "left").select(
        *rows.columns,
        *[F.when(placed, F.col(f"_l_{n}") + F.coalesce(f"_h_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_h_{n}")).alias(n) for n in lasts],
        *[F.greatest(F.col(f"_l_{n}"), F.col(f"_h_{n}")).alias(n) for n in maxs],
    )


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """0-based position of each row in ``order`` within ``keys``."""
    return prefix_scan(rows, keys, order, block, sums={name: F.lit(1).cast("long")})


def dense_bins(maxima: DataFrame, keys: Sequence[str], top: str, name: str, chunk: int = 4096) -> DataFrame:
    """Every integer 0..top per key, without one giant array row for a long key."""
    chunks = maxima.select(
        *keys, top, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(top) / chunk).cast("long"))).alias("_c")
    )
    return chunks.select(
        *keys,
        F.explode(
            F.sequence(F.col("_c") * chunk, F.least(F.col(top), F.col("_c") * chunk + (chunk - 1)))
        ).alias(name),
    )


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, name: str, width: float) -> DataFrame:
    """Exact median per key by locating the middle ranks in value cells of ``width``.

    Only the one or two cells that hold the middle ranks are sorted, so no task sees a whole hot key.
    """
    cells = rows.select(*keys, F.col(value).alias("_v"), F.floor(F.col(value) / F.lit(width)).cast("long").alias("_cell"))
    counts = summary(cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")))
    before = block_prefix(counts.withColumn("_before", F.col("_n")), keys, "_cell", sums=["_before"])
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = before.join(totals, list(keys)).select(
        *keys,
        "_cell",
        "_before",
        F.floor((F.col("_total") - 1) / 2).cast("long").alias("_lo"),
        F.floor(F.col("_total") / 2).cast("long").alias("_hi"),
        "_n",
    )
    middle = ranked.filter(
        ((F.col("_lo") >= F.col("_before")) & (F.col("_lo") < F.col("_before") + F.col("_n")))
        | ((F.col("_hi") >= F.col("_before")) & (F.col("_hi") < F.col("_before") + F.col("_n")))
    ).select(*keys, "_cell", "_before", "_lo", "_hi")
    distinct = (
        cells.join(middle, [*keys, "_cell"])
        .groupBy(*keys, "_cell", "_before", "_lo", "_hi", "_v")
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = distinct.withColumn("_end", F.col("_before") + F.sum("_k").over(inside)).withColumn(
        "_begin", F.col("_end") - F.col("_k")
    )
    low = F.max(F.when((F.col("_lo") >= F.col("_begin")) & (F.col("_lo") < F.col("_end")), F.col("_v")))
    high = F.max(F.when((F.col("_hi") >= F.col("_begin")) & (F.col("_hi") < F.col("_end")), F.col("_v")))
    return placed.groupBy(*keys).agg(((low + high) / 2).alias(name))
