"""Merkle manifest of a dataset: one tree of ternary nodes a source, and one over the sources, by window functions.

A leaf is the digest of a row's columns, each written as its length and value. In a group's order every three neighbours make
a parent until one node is left. A level needs no join: the nodes of a level sit on the rows that are their first leaves, so
``lag`` and ``lead`` by the level's fixed gap, masked by the slot in the run and by the run's length, give a node's siblings;
rows in slot 0 hash the parent, and the last value seen along the order carries a node's siblings to all leaves below it.

Groups are cut into blocks of ``BLOCK`` positions, whole subtrees of ``LEVELS`` levels, so a window never holds more rows,
whatever share of the table a source has; the block roots are the leaves of the next, ``BLOCK`` times smaller table, until each
group is one block. What is above a block is joined to its rows by ``(group, block)``. Positions come from ranges of the order
and counts of each range.

Defined cases: a null is written ``-``, an empty text ``0:``; documents without id come first, equal ids follow their leaf, so
repeated rows are leaves of their own; a null source is a source, the first one; a text of any length is one digest; an empty table
has no root and gives no rows; columns other than the five are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, placed

FAN, LEVELS = 3, 7
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def written_out(value: Column) -> Column:
    """A value as its number of bytes, a colon and itself; a null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[written_out(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _levels(nodes: DataFrame) -> DataFrame:
    """The levels inside the blocks: adds ``block``, ``path`` and, in ``h`` of a block's first row, the block's root."""
    order = Window.partitionBy("g", "block").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [c for c in nodes.columns if c != "h"]
    at = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    steps: list[str] = []
    none = F.lit("")
    for level in range(LEVELS):
        gap = FAN**level
        # Window expressions of one pass: the neighbours of this level and the siblings found one level below.
        seen = {f"{side}{k}": move("h", k * gap).over(order) for side, move in (("lag", F.lag), ("lead", F.lead)) for k in (1, 2)}
        filled = [F.last(s, ignorenulls=True).over(so_far).alias(s) if s == steps[-1] and level > 1 else F.col(s) for s in steps]
        at = at.select(*kept, "block", "h", *filled, *[c.alias(name) for name, c in seen.items()])
        slot = F.expr(f"(pos div {gap}) % {FAN}")
        count = F.expr(f"(n + {gap - 1}) div {gap}")
        run = F.least(F.lit(FAN).cast("long"), count - F.expr(f"pos div {gap}") + slot)
        left = F.concat(F.when(slot == 2, F.col("lag2")).otherwise(none), F.when(slot >= 1, F.col("lag1")).otherwise(none))
        right = F.concat(
            F.when((slot < 2) & (slot + 1 < run), F.col("lead1")).otherwise(none),
            F.when((slot == 0) & (run == 3), F.col("lead2")).otherwise(none),
        )
        here = (F.expr(f"pos % {gap}") == 0) & (count > 1)
        step = F.when(here, F.struct(left.alias("before"), right.alias("after")))
        parent = F.when(F.expr(f"pos % {gap * FAN}") == 0, F.when(count > 1, digest(F.col("h"), right)).otherwise(F.col("h")))
        at = at.select(*kept, "block", *steps, step.alias(f"s{level}"), parent.alias("h"))
        steps.append(f"s{level}")
    last = F.last(steps[-1], ignorenulls=True).over(so_far).alias(steps[-1])
    at = at.select(*kept, "block", "h", *steps[:-1], last)
    return at.select(*kept, "block", "h", F.array_compact(F.array(*steps)).alias("path"))


def climbed(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], shared: Shared, name: str) -> DataFrame:
    """``nodes`` (``g, pos, n, h`` and others) without ``h``, with the ``path`` to the top and what ``above`` says of it.

    ``above`` gets ``g, h`` of every group's root and returns ``g, pos`` (0), ``path`` and further columns.
    """
    inside = shared.write(_levels(nodes), name)
    roots = inside.where(F.expr(f"pos % {BLOCK}") == 0)
    if inside.where(F.col("n") > BLOCK).limit(1).count():
        higher = roots.select("g", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), "h")
        top = climbed(higher, above, shared, f"{name}-up").drop("n")
    else:
        top = above(roots.select("g", "h"))
    top = top.withColumnsRenamed({"pos": "block", "path": "_higher"})
    joined = inside.drop("h").join(top, ["g", "block"])
    return joined.withColumn("path", F.concat("path", "_higher")).drop("block", "_higher")


def manifest(leaves: DataFrame, order: Sequence[Column], shared: Shared) -> DataFrame:
    """``leaves`` (``source``, ``leaf`` and others) with ``path``, ``subroot`` (of the source) and ``root`` (of the table)."""
    # Group names that are never null and keep the order of the sources' bytes, a null first.
    grouped = leaves.withColumn("g", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    nodes = placed(grouped, order, shared, "leaves").withColumn("h", F.col("leaf"))

    def over_sources(subroots: DataFrame) -> DataFrame:
        named = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h", F.col("h").alias("subroot"))
        numbered = placed(named, [F.col("name").asc()], shared, "sources")
        made = climbed(numbered, lambda top: top.select("g", F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("path"), F.col("h").alias("root")), shared, "source-tree")
        return made.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")

    return climbed(nodes, over_sources, shared, "tree").drop("g", "pos", "n")


def report(docs: DataFrame) -> DataFrame:
    """The manifest of all documents and the check of a copy in which half of them lost their line ends.

    ``doc_id``, ``source``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.
    """
    shared = Shared(docs.sparkSession)
    columns = {name: F.col(name) for name in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    altered = leaf_of([*list(columns.values())[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    leaves = docs.select("doc_id", "source", leaf_of(list(columns.values())).alias("leaf"), F.when(hit & F.col("text").contains("\n"), altered).alias("altered"))
    leaves = shared.write(leaves.withColumn("altered", F.coalesce("altered", "leaf")), "digests")
    made = manifest(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], shared)
    folded = made.withColumn("folded_root", fold(F.col("altered"), F.col("path")))
    return folded.select(
        "doc_id", "source", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
