"""Running totals, running maxima and dense numbering without a one-task window.

A window over a whole table, or over one group that holds much of it, sorts everything in one task. Here the order of
such a table or group is cut into *blocks*: a block is any expression that never decreases along the order. Every block
is reduced on its own, the block totals - one row per block - are accumulated, and each block adds what lies before it.
Groups of ordinary size take a plain window, which needs a single shuffle; only the groups counted above ``HOT_ROWS``
are cut, so a group holding a third of the table is spread over many tasks and the others pay nothing for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandline.plans.lookup import by_size
from strandline.session import written

LINES_PER_BLOCK = 1 << 14
BLOCKS_PER_STRETCH = 1 << 12
HASH_BLOCK_DIGITS = 3
HOT_ROWS = 1 << 20
ROWS_PER_TASK = 1 << 19

Measures = dict[str, tuple[str, Column]]


class Blocks(NamedTuple):
    """Block expression, and a coarser one over the block when there may be very many blocks."""

    block: Column
    stretch: Callable[[Column], Column] | None = None


def line_block(order_col: str = "line_id", size: int = LINES_PER_BLOCK) -> Blocks:
    """Blocks of a dense integer order column."""
    return Blocks(
        F.floor(F.col(order_col) / F.lit(size)).cast("long"), lambda b: F.floor(b / F.lit(BLOCKS_PER_STRETCH)).cast("long")
    )


def running(
    df: DataFrame,
    order: Sequence[Column | str],
    block: Column | Blocks,
    measures: Measures,
    within: Sequence[str] = (),
    totals: dict[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
    task_rows: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add running measures along ``order`` inside each ``within`` group.

    ``measures`` maps an output column to ``("sum" | "max", expression)``. ``totals`` maps an output column to the
    measure whose group total it holds. ``order`` must be total inside a group.
    """
    totals, within = totals or {}, list(within)
    blocks = block if isinstance(block, Blocks) else Blocks(block)
    if not within:
        return _by_block(df, order, blocks, measures, within, totals)
    seen = Observation()
    counted = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("rows"))
    hot = written(counted.filter(F.col("_n") > hot_rows).select(*within))
    parts = -(-(seen.get["rows"] or 0) // task_rows)
    if hot.isEmpty():
        return _by_group(_spread(df, parts, within), order, measures, within, totals)
    # At most rows / hot_rows groups can be hot.
    match = _same(within, "_hot_")
    named = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in within]))
    cold_rows = _by_group(_spread(df.join(named, match, "left_anti"), parts, within), order, measures, within, totals)
    hot_part = _by_block(df.join(named, match, "left_semi"), order, blocks, measures, within, totals)
    return cold_rows.unionByName(hot_part)


_REDUCE = {"sum": F.sum, "max": F.max}


def _same(keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for name in keys:
        condition = condition & F.col(name).eqNullSafe(F.col(f"{prefix}{name}"))
    return condition


def _spread(df: DataFrame, parts: int, within: list[str]) -> DataFrame:
    """Groups dealt to tasks by their counted rows, where one task would hold too many: a shuffle by its setting is joined up again
    by compressed bytes, which leave a task millions of narrow rows."""
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *within) if parts > 1 else df


def _by_group(
    df: DataFrame, order: Sequence[Column | str], measures: Measures, within: list[str], totals: dict[str, str]
) -> DataFrame:
    group = Window.partitionBy(*within)
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        *[_REDUCE[kind](expr).over(upto).alias(name) for name, (kind, expr) in measures.items()],
        *[_REDUCE[measures[m][0]](measures[m][1]).over(group).alias(out) for out, m in totals.items()],
    )


def _by_block(
    df: DataFrame, order: Sequence[Column | str], blocks: Blocks, measures: Measures, within: list[str], totals: dict[str, str]
) -> DataFrame:
    keys = [*within, "_block"]
    tagged = df.withColumn("_block", blocks.block)
    for name, (_, expr) in measures.items():
        tagged = tagged.withColumn(f"_in_{name}", expr)
    per_block = tagged.groupBy(*keys).agg(
        *[_REDUCE[kind](f"_in_{name}").alias(f"_blk_{name}") for name, (kind, _) in measures.items()]
    )
    # By their compressed files the rows may look smaller than the blocks. A table has few blocks; those of hot groups are counted.
    carried = _carry(per_block, blocks, measures, within, totals)
    carried = by_size(written(carried)) if within else F.broadcast(carried)
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tagged.select(
        "*", *[_REDUCE[kind](f"_in_{name}").over(local).alias(f"_local_{name}") for name, (kind, _) in measures.items()]
    )
    right = carried.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in carried.columns if c not in keys])
    joined = rows.join(right, (F.col("_block") == F.col("_r__block")) & _same(within, "_r_"))
    out = []
    for name, (kind, _) in measures.items():
        before, here = F.col(f"_before_{name}"), F.col(f"_local_{name}")
        out.append((F.coalesce(before, F.lit(0)) + here if kind == "sum" else F.greatest(before, here)).alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *out, *totals)


def _carry(
    per_block: DataFrame, blocks: Blocks, measures: Measures, within: list[str], totals: dict[str, str]
) -> DataFrame:
    """What lies before each block of its group, and the group totals."""
    if blocks.stretch is None:
        return _accumulate(per_block, within, "_block", "_blk_", "_before_", measures, totals)
    stretched = per_block.withColumn("_stretch", blocks.stretch(F.col("_block")))
    per_stretch = stretched.groupBy(*within, "_stretch").agg(
        *[_REDUCE[kind](f"_blk_{name}").alias(f"_str_{name}") for name, (kind, _) in measures.items()]
    )
    outer = _accumulate(per_stretch, within, "_stretch", "_str_", "_far_", measures, totals)
    inner = _accumulate(stretched, [*within, "_stretch"], "_block", "_blk_", "_near_", measures, {})
    right = outer.select(
        *[F.col(k).alias(f"_o_{k}") for k in [*within, "_stretch"]], *[c for c in outer.columns if c not in [*within, "_stretch"]]
    )
    joined = inner.join(right, (F.col("_stretch") == F.col("_o__stretch")) & _same(within, "_o_"))
    before = []
    for name, (kind, _) in measures.items():
        far, near = F.col(f"_far_{name}"), F.col(f"_near_{name}")
        before.append(
            (F.coalesce(far, F.lit(0)) + F.coalesce(near, F.lit(0)) if kind == "sum" else F.greatest(far, near)).alias(f"_before_{name}")
        )
    return joined.select(*within, "_block", *before, *totals)


def _accumulate(
    pieces: DataFrame, within: list[str], piece: str, source: str, target: str, measures: Measures, totals: dict[str, str]
) -> DataFrame:
    group = Window.partitionBy(*within)
    before = group.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(
        *within, piece,
        *[_REDUCE[kind](f"{source}{name}").over(before).alias(f"{target}{name}") for name, (kind, _) in measures.items()],
        *[_REDUCE[measures[m][0]](f"{source}{m}").over(group).alias(out) for out, m in totals.items()],
    )


def numbered(
    df: DataFrame,
    order: Sequence[Column | str],
    block: Column | Blocks,
    out: str,
    within: Sequence[str] = (),
    total: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based row number along ``order`` inside each group, and optionally the group size."""
    return running(
        df, order, block, {out: ("sum", F.lit(1).cast("long"))}, within, {total: out} if total else None, hot_rows
    )


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` written in ranges of ``order``, numbered by ``_range``: blocks for orders whose values say nothing about how
    many rows share them, such as frequencies of rare keys. Spark samples the order for even ranges, and the table fixes
    them for all later passes."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def hash_order(seed: int | str | Column, id_col: str) -> Column:
    """Reproducible shuffle key: md5 of seed and id."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(id_col).cast("string")))


def shuffled(
    df: DataFrame, id_col: str, seed: int | str | Column, out: str, within: Sequence[str] = (), total: str | None = None
) -> DataFrame:
    """Number the rows of ``df`` in a seeded random order. The blocks are the leading hash digits."""
    keyed = df.withColumn("_hash", hash_order(seed, id_col))
    block = F.substring("_hash", 1, HASH_BLOCK_DIGITS)
    return numbered(keyed, ["_hash", id_col], block, out, within, total).drop("_hash")


def value_blocks(value: str, per_octave: int = 256) -> Column:
    """Block of a non-negative or negative number: its sign and binary logarithm in steps. Never decreases with it."""
    x = F.col(value).cast("double")
    return (
        F.when(x > 0, F.floor(F.log2(x) * per_octave) + F.lit(1 << 40))
        .when(x < 0, -F.floor(F.log2(-x) * per_octave) - F.lit(1 << 40))
        .otherwise(F.lit(0).cast("long"))
    )
