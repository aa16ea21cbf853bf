"""Text form of sequences for interchange: elements and the features inside an element joined by fixed marks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Marks(NamedTuple):
    feature: str
    element: str


# The marks of the two text formats.
STANDARD = Marks(feature="!;!", element="!|!")
LEGACY = Marks(feature=",", element=" ")


def encode_sequence(columns: Sequence[str], marks: Marks = STANDARD) -> Column:
    """One line per sequence from parallel arrays; every element ends with the element mark."""
    def element(e: Column) -> Column:
        return F.concat(F.concat_ws(marks.feature, *[e[c].cast("string") for c in columns]), F.lit(marks.element))

    return F.array_join(F.transform(F.arrays_zip(*columns), element), "")


def encode_elements(elements: DataFrame, columns: Sequence[str], marks: Marks = STANDARD, piece: int = 4096) -> DataFrame:
    """``seq_id, line``: the text of whole sequences from rows of elements, joined from pieces of ``piece`` elements.

    No element is dropped; only the finished line of a sequence is held in one row.
    """
    own = F.concat(F.concat_ws(marks.feature, *[F.col(c).cast("string") for c in columns]), F.lit(marks.element))
    ordered = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), "_t"))), lambda e: e["_t"]), "")
    pieces = elements.select("seq_id", "pos", F.floor(F.col("pos") / F.lit(piece)).alias("_piece"), own.alias("_t")).groupBy("seq_id", "_piece").agg(ordered("pos").alias("_t"))
    return pieces.groupBy("seq_id").agg(ordered("_piece").alias("line"))


def decode_sequence(lines: DataFrame, line: str, columns: Sequence[str], marks: Marks = STANDARD) -> DataFrame:
    """Back to elements: all features as text, ``pos`` from 0; the empty piece after the last mark is dropped."""
    pieces = F.split(line, re.escape(marks.element))
    kept = F.slice(pieces, 1, F.size(pieces) - 1)
    others = [c for c in lines.columns if c != line]
    opened = lines.select(*others, F.posexplode(kept).alias("pos", "_e"))
    features = F.split("_e", re.escape(marks.feature))
    return opened.select(
        *others, F.col("pos").cast("long").alias("pos"), *[features.getItem(i).alias(c) for i, c in enumerate(columns)]
    )
