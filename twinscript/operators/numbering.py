"""Consecutive numbers and neighbours of rows without collecting a group, or the whole table,
into one task.

``row_number`` or ``lag`` over an unpartitioned window, or over a group that holds a third of the
rows, puts all those rows into one task.  Here rows are range-sorted once and kept as sorted
chunks, one per sort partition.  Windows run over the rows of a group within one chunk, and what
crosses a chunk's border is worked out from one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.session import cut_lineage

CHUNK = "_chunk"
PLACE = "_place"


def sorted_chunks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in total order with its chunk and its place there, fixed in the shared folder.

    Kept there, the rows have the same chunk and place for every later reader, also after the
    loss of an executor.
    """
    placed = df.orderBy(*order).withColumn(PLACE, F.monotonically_increasing_id())
    return cut_lineage(placed.withColumn(CHUNK, F.shiftright(PLACE, 33))
                       .withColumn(PLACE, F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))))


def _offsets(chunks: DataFrame) -> DataFrame:
    """Rows before each chunk; one row per chunk, that is per sort partition."""
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    return sizes.select(CHUNK, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))


def _borders(chunks: DataFrame, group: list[str]) -> DataFrame:
    """Per chunk its first group, and how many rows of that group earlier chunks hold.

    Groups are contiguous in the sort, so earlier chunks with rows of the group end with it.
    """
    key = F.struct(*group)
    runs = chunks.groupBy(CHUNK, *group).agg(F.count(F.lit(1)).alias("_n"), F.min(PLACE).alias("_p"))
    ends = runs.groupBy(CHUNK).agg(F.min_by(key, "_p").alias("_head"), F.max_by(key, "_p").alias("_tail"),
                                   F.max_by("_n", "_p").alias("_tail_n"))
    # from here on one row per chunk
    earlier = Window.partitionBy("_tail").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_same", F.coalesce(F.sum("_tail_n").over(earlier), F.lit(0)))
    ended = ends.groupBy(F.col("_tail").alias("_group")).agg(F.sum("_tail_n").alias("_all"))
    joined = ends.join(ended, ends["_head"].eqNullSafe(ended["_group"]), "left")
    whole = F.col("_head").eqNullSafe(F.col("_tail"))
    return joined.select(CHUNK, "_head", F.when(whole, F.col("_same")).otherwise(
        F.coalesce("_all", F.lit(0))).alias("_carried"))


def number_rows(df: DataFrame, order: list[str], group: list[str] | None = None,
                name: str = "row_no") -> DataFrame:
    """Add ``name`` = 1, 2, … in ``order``, restarting for each ``group``.

    ``order`` must be a total order within the group.  The result keeps its chunk and place, for
    ``renumber``; ``plain`` drops them.
    """
    group = list(group or [])
    chunks = sorted_chunks(df, [*group, *order])
    if not group:
        return (chunks.join(F.broadcast(_offsets(chunks)), CHUNK)
                .withColumn(name, F.col("_before") + F.col(PLACE) + 1).drop("_before"))
    here = F.row_number().over(Window.partitionBy(CHUNK, *group).orderBy(PLACE))
    carried = F.when(F.struct(*group).eqNullSafe(F.col("_head")), F.col("_carried")).otherwise(0)
    return (chunks.withColumn("_here", here).join(F.broadcast(_borders(chunks, group)), CHUNK)
            .withColumn(name, F.col("_here") + carried).drop("_here", "_head", "_carried"))


def renumber(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Number the surviving rows of a filtered ``number_rows`` result, in the same order."""
    here = F.row_number().over(Window.partitionBy(CHUNK).orderBy(PLACE))
    return (df.withColumn("_here", here).join(F.broadcast(_offsets(df)), CHUNK)
            .withColumn(name, F.col("_before") + F.col("_here")).drop("_before", "_here"))


def with_neighbours(df: DataFrame, group: list[str], order: list[str], value: str,
                    previous: str = "previous", last: str = "is_last") -> DataFrame:
    """Add the value of the row before in the group, and whether the row is the group's last."""
    chunks = sorted_chunks(df, [*group, *order])
    key: Column = F.struct(*group)
    ends = chunks.groupBy(CHUNK).agg(
        F.min_by(key, PLACE).alias("_head"), F.max_by(key, PLACE).alias("_tail"),
        F.max_by(F.struct(F.col(value).alias("v")), PLACE).alias("_v"))
    # one row per chunk
    line = Window.orderBy(CHUNK)
    borders = ends.select(CHUNK, F.lag("_tail").over(line).alias("_left"), F.lag("_v").over(line)["v"].alias("_left_value"),
                          F.lead("_head").over(line).alias("_right"))
    w = Window.partitionBy(CHUNK, *group).orderBy(PLACE)
    first, final = F.row_number().over(w) == 1, F.lead(PLACE).over(w).isNull()
    out = (chunks.withColumn("_first", first).withColumn("_final", final).withColumn(previous, F.lag(value).over(w))
           .join(F.broadcast(borders), CHUNK))
    across = F.col("_first") & key.eqNullSafe(F.col("_left"))
    return (out.withColumn(previous, F.when(across, F.col("_left_value")).otherwise(F.col(previous)))
            .withColumn(last, F.col("_final") & ~key.eqNullSafe(F.col("_right")))
            .drop("_first", "_final", "_left", "_left_value", "_right", CHUNK, PLACE))


def plain(df: DataFrame) -> DataFrame:
    """Drop the bookkeeping columns of ``number_rows``."""
    return df.drop(CHUNK, PLACE)
