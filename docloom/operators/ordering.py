"""Numbers for rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.staging import staged


def numbered(rows: DataFrame, order: list[Column], name: str = "nth") -> DataFrame:
    """rows with their number in the order, from 1; hand in slim rows.

    Rows are range-partitioned by the order and staged, so that the partitions
    stand still; a number is the rank within the partition behind the sizes of
    those before, of which there are as many as partitions.
    """
    keys = [f"order_{i}" for i in range(len(order))]
    keyed = rows.select("*", *[c.alias(k) for c, k in zip(order, keys)])
    ranged = staged(keyed.repartitionByRange(*keys).withColumn("range_no", F.spark_partition_id()))
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("range_no", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("range_no").orderBy(*keys))
    return ranged.withColumn("rank", rank).join(offsets, "range_no").withColumn(name, F.col("rank") + F.col("before")).drop("rank", "before", "range_no", *keys)
