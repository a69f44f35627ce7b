"""Small relational helpers: current rows, first matches, positions within a key without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def current_rows(df: DataFrame, key: str, order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the one whose ``order`` is greatest (nulls least).

    It is an aggregate, so a key with any number of rows is reduced before the shuffle. Rows that tie on
    ``order`` are told apart by nothing: pass enough order columns to make the choice definite. Null keys
    form one key. An empty table gives an empty table.
    """
    columns = columns or [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in columns]), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in columns])


def first_by(df: DataFrame, keys: list[str], order: list[Column], name: str | None = None) -> DataFrame:
    """The first row of each group of ``keys`` in ``order`` (row_number = 1; Spark keeps one row per group before the shuffle)."""
    n = name or "_n"
    out = df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1)
    return out.drop(n)


def positions(df: DataFrame, key: str, order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """``name``: the row's place (from 1) within its ``key`` in the order of ``order``, ascending.

    The rows are cut into ranges of (key, order), so that a key with a third of all rows is spread over
    many tasks; each task numbers its own rows of a key, and the counts of the earlier ranges are added.
    ``order`` must tell all rows of a key apart (ranges cut between equal rows would still be numbered, in
    an arbitrary but complete way). Null keys form a key of their own.
    """
    keys = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged = cut(ranged.withColumn("_slice", F.spark_partition_id()))  # the cut must be the same for both uses below
    w = Window.partitionBy(key, "_slice").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("_n", F.row_number().over(w))
    counts = ranged.groupBy(key, "_slice").agg(F.count("*").alias("_c"))
    before = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_c").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), "_before")
    joined = numbered.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")))
    return joined.withColumn(name, (F.col("_n") + F.col("_before")).cast("int")).drop("_k", "_s", "_before", "_slice", "_n")


def running_sums(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the row and those before it within its ``key``, in the order of ``order``.

    As ``positions``: each task sums its own slice of a key, and the totals of the earlier slices are added.
    """
    keys = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = cut(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()))
    w = Window.partitionBy(key, "_slice").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(key, "_slice").agg(F.sum(value).alias("_c"))
    w2 = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_c").over(w2), F.lit(0)).alias("_before"))
    joined = ranged.withColumn("_n", F.sum(value).over(w)).join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")))
    return joined.withColumn(name, F.col("_n") + F.col("_before")).drop("_k", "_s", "_before", "_slice", "_n")
