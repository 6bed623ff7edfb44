"""Data-parallel primitives over ordered rows.

Scans, runs and differences need a total order.  Rows are range-partitioned and sorted by
it once, and written in buckets by their partition, so each partition works alone where
it is; only one summary row for each partition is combined, so no task ever holds the
whole input, and a run of any length is spread like other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.sources.shared import in_buckets

#: For each aggregate that a scan may use, what combines two of its results.  None needs an inverse.
COMBINE: dict[Callable, Callable[[Column, Column], Column]] = {
    F.sum: lambda a, b: a + b,
    F.max: F.greatest,
    F.min: F.least,
    F.product: lambda a, b: a * b,
    F.bool_and: lambda a, b: a & b,
    F.bool_or: lambda a, b: a | b,
    F.bit_xor: lambda a, b: a.bitwiseXOR(b),
    F.bit_or: lambda a, b: a.bitwiseOR(b),
    F.bit_and: lambda a, b: a.bitwiseAND(b),
}


class Ordered:
    """Rows in a total order, kept with the number of their range partition.

    Rows that tie are ordered by a hash of all their columns and numbered once, when they
    are written, so that every step sees them in the same order; all rows stay.
    """

    def __init__(self, df: DataFrame, *order: str | Column):
        tied = df.withColumn("_tie", F.xxhash64(*df.columns))
        ranged = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
        numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
        # More buckets than partitions, so that few partitions share one.
        self.rows = in_buckets(numbered, "ordered", 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_part")
        self.inside = Window.partitionBy("_part").orderBy("_row")
        #: Over one row for each partition.
        self.parts = Window.orderBy("_part")

    def scan(self, value: Column, name: str, inclusive: bool = True) -> DataFrame:
        """The rows with the running sum of value, their own included or not."""
        return self.scan_by(value, name, F.sum, inclusive)

    def scan_by(self, value: Column, name: str, reduce=F.max, inclusive: bool = True, combine=None) -> DataFrame:
        """The rows with the running result of an aggregate; before the first, where their own is not included, null (0 for a sum).

        Any aggregate will do whose results can be aggregated again, with ``combine`` for
        two of them (``COMBINE`` knows the usual ones).
        """
        return self._scan(self.rows.withColumn("_run", F.lit(0).cast("bigint")), value, name, reduce, inclusive, combine)

    def scan_by_key(self, key: str, value: Column, name: str, inclusive: bool = True, reduce=F.sum, combine=None) -> DataFrame:
        """The same within each run of equal keys."""
        return self._scan(self._headed(key).withColumn("_run", F.sum("_head").over(self.inside)).drop("_head"), value, name, reduce, inclusive, combine)

    def _scan(self, rows: DataFrame, value: Column, name: str, reduce, inclusive: bool, combine) -> DataFrame:
        """_run counts the runs that began in the row's own partition: 0 is one that comes from before."""
        combine = combine or COMBINE[reduce]
        frame = Window.partitionBy("_part", "_run").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        last = rows.groupBy("_part", "_run").agg(reduce(value).alias("_t")).groupBy("_part").agg(F.max_by("_t", "_run").alias("_t"), F.max("_run").alias("_run"))
        # A partition's last run goes on from the one before unless it began here.
        since = last.withColumn("_from", F.sum((F.col("_run") > 0).cast("int")).over(self.parts))
        out = since.withColumn("_out", reduce("_t").over(Window.partitionBy("_from").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
        carried = out.select("_part", F.lag("_out").over(self.parts).alias("_carry"))
        own = reduce(value).over(frame)
        whole = F.when(F.col("_run") == 0, F.coalesce(combine(F.col("_carry"), F.col("_own")), "_carry", "_own")).otherwise(F.col("_own"))
        if reduce is F.sum:
            whole = F.coalesce(whole, F.lit(0))
        return rows.withColumn("_own", own).join(carried, "_part").withColumn(name, whole).drop("_own", "_carry", "_run", "_part", "_row")

    def position(self, name: str) -> DataFrame:
        return self.scan(F.lit(1).cast("bigint"), name)

    def before(self, value: Column, name: str) -> DataFrame:
        """The rows with the value of the row before, null for the first."""
        last = self.rows.groupBy("_part").agg(F.max_by(value, "_row").alias("_v"))
        edge = last.select("_part", F.lag("_v").over(self.parts).alias("_edge"))
        first = F.row_number().over(self.inside) == 1
        out = self.rows.join(edge, "_part").withColumn(name, F.when(first, F.col("_edge")).otherwise(F.lag(value).over(self.inside)))
        return out.drop("_edge")

    def after(self, value: Column, name: str) -> DataFrame:
        """The rows with the value of the row after, null for the last."""
        first = self.rows.groupBy("_part").agg(F.min_by(value, "_row").alias("_v"))
        edge = first.select("_part", F.lead("_v").over(self.parts).alias("_edge"))
        end = F.lead(F.lit(1)).over(self.inside).isNull()
        return self.rows.join(edge, "_part").withColumn(name, F.when(end, F.col("_edge")).otherwise(F.lead(value).over(self.inside))).drop("_edge")

    def _headed(self, key: str) -> DataFrame:
        """The rows with ``_head``: 1 where a run of equal values begins, else 0."""
        # The value before travels in a struct, so that a null is told from no row at all.
        marked = self.before(F.struct(F.col(key).alias("v")), "_before")
        same = F.col("_before").isNotNull() & F.col("_before")["v"].eqNullSafe(F.col(key))
        return marked.withColumn("_head", F.when(same, 0).otherwise(1).cast("bigint")).drop("_before")

    def runs(self, key: str, name: str = "run") -> DataFrame:
        """The rows with the number of their run of equal values, from 1 on."""
        return self._numbered_runs(key, name).drop("_head")

    def _numbered_runs(self, key: str, name: str) -> DataFrame:
        return self._scan(self._headed(key).withColumn("_run", F.lit(0).cast("bigint")), F.col("_head"), name, F.sum, True, None)


def unique(o: Ordered, value: str) -> DataFrame:
    """The first row of each run of equal values, with the run's number."""
    return o._numbered_runs(value, "run").filter("_head = 1").drop("_head")


def run_lengths(o: Ordered, value: str) -> DataFrame:
    return o.runs(value).groupBy("run").agg(F.first(value).alias("value"), F.count("*").alias("length"))


def reduce_by_key(o: Ordered, key: str, value: Column) -> DataFrame:
    """The sum over each run of equal keys."""
    return o.runs(key).groupBy("run").agg(F.first(key).alias("key"), F.sum(value).alias("total"))


def histogram_even(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    inside = df.select(value.alias("v")).filter((F.col("v") >= low) & (F.col("v") < high))
    return inside.groupBy((F.width_bucket(F.col("v"), F.lit(low), F.lit(high), F.lit(bins)) - 1).alias("bin")).agg(F.count("*").alias("n"))


def histogram_range(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """Counts between successive bounds, lower ones included."""
    v = df.select(value.alias("v")).filter((F.col("v") >= bounds[0]) & (F.col("v") < bounds[-1]))
    bin_ = sum((F.when(F.col("v") >= b, 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))
    return v.groupBy(bin_.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def histogram_multi(df: DataFrame, channels: dict[str, tuple[Column, float, float, int]]) -> DataFrame:
    """(channel, bin, n): even histograms of several values of the same rows, in one pass."""
    each = []
    for name, (value, low, high, bins) in channels.items():
        bin_ = F.when((value >= low) & (value < high), F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)) - 1)
        each.append(F.struct(F.lit(name).alias("channel"), bin_.cast("bigint").alias("bin")))
    return df.select(F.explode(F.array(*each)).alias("x")).filter("x.bin is not null").groupBy("x.channel", "x.bin").agg(F.count("*").alias("n"))


def select_flagged(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose flag is set; a null is not."""
    return df.filter(F.col(flag) != 0).drop(flag)


def partition_flagged(df: DataFrame, flag: str) -> DataFrame:
    """The rows with their part: 0 where the flag is set, else 1."""
    return df.withColumn("part", F.when(F.col(flag) != 0, 0).otherwise(1)).drop(flag)


def segmented_arg(df: DataFrame, segment: str, value: str, tie: str) -> DataFrame:
    """(segment, argmin, argmax): ``tie`` of the rows with the least and the greatest value; its least where they tie."""
    low, high = F.min_by(tie, F.struct(F.col(value), F.col(tie))), F.max_by(tie, F.struct(F.col(value), -F.col(tie)))
    return df.groupBy(segment).agg(low.alias("argmin"), high.alias("argmax"))


def partition3(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """The rows with the number (0, 1, 2) of the first predicate that holds."""
    return df.withColumn("part", F.when(first, 0).when(second, 1).otherwise(2))


def segmented_sort(df: DataFrame, segment: str, *order: str | Column) -> DataFrame:
    """The rows with their position within their segment; a segment of any size is spread over ranges of its order."""
    return Ordered(df, segment, *order).scan_by_key(segment, F.lit(1), "position")


def spmv(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, y): matrix(i, j, a) times vector(j, x)."""
    return matrix.join(vector, "j").groupBy("i").agg(F.sum(F.col("a") * F.col("x")).alias("y"))
