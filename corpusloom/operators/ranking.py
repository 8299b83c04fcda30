"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], key: Column, ties: list[str], out: str, per_bucket: int = 200_000) -> DataFrame:
    """Rank from 0 of each row within ``group``, in the order of the hash ``key`` (unsigned) and then of ``ties``.

    No group is sorted in one task: rows are ranked within (group, bucket) and shifted by the sizes of the buckets before.
    Buckets are ranges of the hash, so their number, which follows the size of the largest group, doesn't change the order.
    """
    top = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    n = max(1, -(-top // per_bucket))
    df = df.withColumn("__h", F.shiftrightunsigned(key, 1))
    df = df.withColumn("__b", F.floor(F.shiftrightunsigned("__h", 32) * n / float(1 << 31)).cast("int"))
    inner = Window.partitionBy(*group, "__b").orderBy("__h", *ties)
    df = df.withColumn("__r", F.row_number().over(inner) - 1)
    if n == 1:
        return df.withColumn(out, F.col("__r").cast("long")).drop("__h", "__b", "__r")
    sizes = df.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    sizes = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__sb"), "__off")
    same = F.col("__b") == F.col("__sb")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    keep = [c for c in df.columns if c not in ("__h", "__b", "__r")]
    return df.join(sizes, same).select(*keep, (F.col("__off") + F.col("__r")).cast("long").alias(out))
