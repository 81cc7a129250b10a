"""Row positions, lags, rolling and trailing windows over one long ordered series.

A window without partition keys would move the whole series into one task.  Instead the series is
range-partitioned on its order columns, numbered, cut into blocks of consecutive rows, and each
block borrows the last rows of the block before it (its halo), so every frame is local.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.session import materialize, with_scalars

BLOCK_ROWS = 8192
_POSITION_BITS = 33


def with_row_id(df: DataFrame, order_by: list[str], name: str = "series") -> DataFrame:
    """Add a dense 1-based ``row_id`` in the order of ``order_by`` (which should be unique).

    Rows are range-partitioned, sorted inside each partition and written once together with
    (partition, position); the number of rows of every partition before it then gives each
    partition its offset.  A hot leading key is split as long as the later order columns tell
    its rows apart.
    """
    ordered = [F.asc_nulls_last(c) for c in order_by]
    placed = (
        df.repartitionByRange(*ordered)
        .sortWithinPartitions(*ordered)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = materialize(placed, name)
    part = F.shiftrightunsigned("_place", _POSITION_BITS).cast("int")
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    # One count per write task; the running sums become a constant array in the plan.
    sizes = dict(stored.groupBy(part).agg(F.count(F.lit(1))).collect())
    starts = accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0))), initial=0)
    offsets = F.expr(f"array({', '.join(f'{n}L' for n in starts)})")
    return stored.withColumn("row_id", offsets[part] + position + 1).drop("_place")


class HaloFrames:
    """Numbered rows in blocks with a halo of ``halo`` earlier rows.

    ``frames.rows`` holds the rows to add window columns to, ``frames.window(a, b)`` a frame over
    them, and ``frames.own(df)`` drops the borrowed rows again.
    """

    def __init__(self, numbered: DataFrame, halo: int, block_rows: int = BLOCK_ROWS):
        if block_rows < halo:
            raise ValueError("a block must be at least as long as the halo")
        offset = F.col("row_id") - 1
        block = F.floor(offset / block_rows)
        lent = offset % block_rows >= block_rows - halo
        self.rows = numbered.withColumn("_own", block).withColumn(
            "_block",
            F.explode(F.when(lent, F.array(block, block + 1)).otherwise(F.array(block))),
        )
        self._ordered = Window.partitionBy("_block").orderBy("row_id")

    def ordered(self):
        return self._ordered

    def window(self, start: int, end: int):
        return self._ordered.rowsBetween(start, end)

    @staticmethod
    def own(df: DataFrame) -> DataFrame:
        return df.where(F.col("_own") == F.col("_block")).drop("_own", "_block")


def lagged(
    numbered: DataFrame, lags: dict[str, tuple[str, int]], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``name → (column, rows back)`` lags."""
    frames = HaloFrames(numbered, max(k for _, k in lags.values()), block_rows)
    added = {name: F.lag(c, k).over(frames.ordered()) for name, (c, k) in lags.items()}
    return frames.own(frames.rows.withColumns(added))


def full_mean(c: str, frames: HaloFrames, width: int, shift: int = 0) -> Column:
    """Mean of ``width`` consecutive rows ending ``shift`` rows back; NULL unless all are there."""
    w = frames.window(-(width - 1) - shift, -shift)
    return F.when(F.count(c).over(w) == width, F.avg(c).over(w))


def rolling_means(
    numbered: DataFrame,
    columns: dict[str, str],
    width: int = 7,
    leak_free: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``name → column`` right-aligned rolling means.

    The current row is part of its own mean; ``leak_free`` ends the window one row earlier.
    """
    shift = 1 if leak_free else 0
    frames = HaloFrames(numbered, width - 1 + shift, block_rows)
    added = {name: full_mean(c, frames, width, shift) for name, c in columns.items()}
    return frames.own(frames.rows.withColumns(added))


def chronological_split(numbered: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Add ``n_rows`` and ``is_train`` (the first ``floor(fraction · n)`` rows)."""
    total = numbered.agg(F.count(F.lit(1)).alias("n_rows"))
    return with_scalars(numbered, total).withColumn(
        "is_train", F.col("row_id") <= F.floor(F.lit(fraction) * F.col("n_rows"))
    )


def first_rows(numbered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of an ordered series with their index."""
    return numbered.where(F.col("row_id") <= n)
