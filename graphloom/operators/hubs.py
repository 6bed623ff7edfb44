"""Joins whose keys may hold a large share of all rows.

A join's work for a key is the product of its rows on both sides.  Keys with more work
than a task should have are cut in a grid: the rows of the left side are dealt to its
lines, those of the right side to its columns, each row is copied along its own line or
column, and each cell meets in a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is cut if its work exceeds the mean work of this many cells for each shuffle partition.
CELLS = 8


def _dealt(rows: DataFrame, key: str, grid: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
    """rows with their line (or column) by a hash of the whole row, once for each column (or line); those of other keys stay alone."""
    parts = lambda c: F.coalesce(F.col(c), F.lit(1))
    known = rows.join(F.broadcast(grid), key, "left")
    dealt = known.withColumn(own, F.pmod(F.xxhash64(*rows.columns), parts(own_parts)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), parts(other_parts) - 1))).drop(own_parts, other_parts)


def grid_of(left: DataFrame, right: DataFrame, key: str, least: int) -> DataFrame:
    """(key, _lines, _columns) of the keys that are cut: fewer than CELLS for each shuffle partition, as each has more than such a share of all work.

    Keys with at most ``least`` pairs are never cut.
    """
    sides = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    work = sides.withColumn("_w", F.col("_l").cast("double") * F.col("_r"))
    total = work.agg(F.sum("_w")).first()[0] or 0.0
    share = max(float(least), total / (CELLS * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cells = F.ceil(F.col("_w") / F.lit(share))
    # Copies are fewest where lines and columns stand to each other as the two sides do.
    lines = F.least("_l", F.greatest(F.lit(1), F.ceil(F.sqrt(cells * F.col("_l") / F.col("_r"))))).cast("int")
    heavy = work.filter(F.col("_w") > F.lit(share)).withColumn("_cells", cells).withColumn("_lines", lines)
    return heavy.select(key, "_lines", F.least("_r", F.ceil(F.col("_cells") / F.col("_lines"))).cast("int").alias("_columns"))


def grid_join(left: DataFrame, right: DataFrame, key: str, least: int = 0) -> DataFrame:
    """left joined with right on key, heavy keys cut in grids.  Both should be written tables, as they are read twice.

    The same rows as the plain join: a pair of rows shares exactly one cell.  Null keys
    join with nothing; repeated rows are joined as often as they occur.  Rows are few
    beside pairs here, so partitions are as many as the setting says, and Spark does not
    put small ones together.
    """
    grid = grid_of(left, right, key, least)
    a = _dealt(left, key, grid, "_line", "_lines", "_column", "_columns")
    b = _dealt(right, key, grid, "_column", "_columns", "_line", "_lines")
    cell = [key, "_line", "_column"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(parts, *cell).join(b.repartition(parts, *cell), cell).drop("_line", "_column")
