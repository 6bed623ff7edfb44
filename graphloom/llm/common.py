"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import new_path, remove, shared_dir, written

__all__ = ["HOT_KEYS", "move_into_place", "new_path", "one_task_each", "remove", "shared_dir", "shuffle_partitions", "spread_join", "table", "tokenizer_path", "written"]

#: Most keys that ``spread_join`` broadcasts.
HOT_KEYS = 1_000


def spread_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", hot: int | None = None) -> DataFrame:
    """rows joined with few, which has one row for a key and the number ``k`` of its rows in rows.

    A key with more than one in ``hot`` (``HOT_KEYS`` unless given) of all rows would fill a task.  There are fewer
    than ``hot`` such keys, which proves the bound of the broadcast; the other keys are
    shuffled as usual.  k is dropped.  Both tables should be written, as they are read twice.
    """
    hot = hot or HOT_KEYS
    total = few.agg(F.sum("k")).first()[0] or 0
    many = few.filter(F.col("k") > total / hot).drop("k")
    rest = rows.join(F.broadcast(many.select(key)), key, "left_anti")
    return rows.join(F.broadcast(many), key).unionByName(rest.join(few.filter(F.col("k") <= total / hot).drop("k"), key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def one_task_each(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """About n short rows, sorted ``by`` and dealt one after another to n tasks."""
    return rows.repartitionByRange(max(1, n), *by)


def move_into_place(store: fs.FileSystem, own: str, name: str) -> None:
    """Gives a whole file its name.  Where a task ran twice, the first whole file stays."""
    try:
        store.move(own, name)
    except OSError:
        # Some stores refuse to replace a file; the one that is there has the same rows.
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(own)
