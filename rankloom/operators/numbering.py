"""Dense numbers in an order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.store import written


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place from 0 in that (total) order: ranges are sorted apart, and each begins where those before it end."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    first = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_first"))  # one row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(first), "_range").withColumn(name, F.col("_first") + F.col("_own")).drop("_range", "_own", "_first")
