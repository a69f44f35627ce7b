"""Joins whose key may be hot on the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

HOT = 100_000  # left rows of a key from which the key is spread
SALTS = 32


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """``left`` join ``right`` on ``key``, where ``right`` has at most few rows of a key.

    Keys with more than ``hot`` left rows are spread over ``salts`` tasks, and only their right rows are
    copied to each. Their number is at most the left rows divided by ``hot``. Null keys join nothing.
    Without a hot key it is the plain join. Both sides may share no other column.
    """
    keys = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > hot).select(F.col(key).alias("_hot"))
    keys = cut(keys)  # few: at most the left rows divided by ``hot``
    if not keys.take(1):
        return left.join(right, key, how)
    spread = left.join(keys, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.lit(salts))).cast("int")).drop("_hot")
    copied = right.join(keys, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop("_hot")
    return spread.join(copied, [key, "_salt"], how).drop("_salt")
