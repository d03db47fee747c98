"""Tables between steps and joins on keys of uneven size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreforge.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back; cuts lineage between rounds."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_one(rows: DataFrame, per_key: DataFrame, key: str, n: str, share: int = 1000) -> DataFrame:
    """rows joined (inner) to a stored table of one row for each key, whose column `n` tells how many rows the key has; `n` is dropped.

    Keys of more than a 1 / share of all rows are fewer than `share`, whatever the input: they are broadcast, and their rows
    stay where they are. The others meet by shuffle. Keys aren't null.
    """
    total = per_key.agg(F.coalesce(F.sum(n), F.lit(0))).collect()[0][0]
    bound = max(total // share, 1000)
    cold = rows.join(per_key.where(F.col(n) <= bound).hint("merge"), key)
    if not per_key.where(F.col(n) > bound).limit(1).count():
        return cold.drop(n)
    hot = rows.join(F.broadcast(per_key.where(F.col(n) > bound)), key)
    return hot.unionByName(cold).drop(n)


def sums_before(df: DataFrame, key: str, order: list[str], value: Column, out: str, rows_each: int = 100_000) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the key before this one, without a task for a whole key.

    Rows are dealt by range and written; each range's sums are moved by those of the ranges before it.
    """
    n_parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_each))
    part, own, moved = "_part", "_own", "_moved"
    dealt = stored(df.withColumn(own, value).repartitionByRange(n_parts, key, *order).withColumn(part, F.spark_partition_id()), "sums")
    sums = dealt.groupBy(key, part).agg(F.sum(own).alias(moved))
    earlier = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn(moved, F.coalesce(F.sum(moved).over(earlier), F.lit(0)))
    inside = W.partitionBy(part, key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumn(out, F.coalesce(F.sum(own).over(inside), F.lit(0)))
    both = rows.join(sums.hint("shuffle_hash"), [part, key])
    return both.select(*df.columns, (F.col(out) + F.col(moved)).alias(out))
