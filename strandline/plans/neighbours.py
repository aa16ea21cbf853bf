"""Look-behind and look-ahead along a sequence, safe when one sequence is most of the table.

``lag`` or a row frame partitioned by sequence puts a hot sequence in one task. Positions are cut into blocks and the
rows next to a block edge are copied into the neighbouring block, so every frame is complete inside its block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

POSITIONS_PER_BLOCK = 1 << 14


def over_neighbours(
    df: DataFrame,
    seq: Sequence[str],
    pos: str,
    before: int,
    after: int,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    block_size: int = POSITIONS_PER_BLOCK,
) -> DataFrame:
    """Add window expressions that look at most ``before`` rows back and ``after`` rows ahead.

    ``pos`` must be dense inside a sequence. Each expression is built from the window of one block, ordered by ``pos``.
    """
    if max(before, after) > block_size:
        raise ValueError("the look-around must fit in one block")
    home = F.floor(F.col(pos) / F.lit(block_size)).cast("long")
    inside = F.pmod(F.col(pos).cast("long"), F.lit(block_size))
    copies = [home]
    if after:
        copies.append(F.when((inside < after) & (home > 0), home - 1))
    if before:
        copies.append(F.when(inside >= block_size - before, home + 1))
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.array_compact(F.array(*copies)))
    )
    spec = Window.partitionBy(*seq, "_block").orderBy(pos)
    seen = spread.select("*", *[build(spec).alias(name) for name, build in exprs.items()])
    return seen.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")
