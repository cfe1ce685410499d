"""Exact quantiles by groups, by refining histograms in rounds.

No task ever holds the values of a group.  Each round counts the values of a range in
`BINS` bins and keeps only the bin that holds the wanted rank, until that bin holds one
value, or the rank is the first or the last of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.store import written

BINS = 1_024


def order_statistics(rows: DataFrame, by: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """wanted (by, rank from 0) with the value at each rank; rows and wanted hold no null values."""
    span = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    open_ = written(wanted.join(span, by).withColumn("_below", F.lit(0).cast("long")), "ranks")
    done = None
    while True:
        # Ranges are few (two a group), rows are many: each row meets its group's ranges.
        ranges = open_.select(*by, "_lo", "_hi").distinct()
        inside = rows.select(*by, F.col(value).cast("double").alias("_v")).join(ranges, by).where("_v >= _lo and _v <= _hi")
        at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * BINS), F.lit(BINS - 1))).otherwise(0)
        bins = inside.groupBy(*by, "_lo", "_hi", at.cast("int").alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        along = Window.partitionBy(*by, "_lo", "_hi").orderBy("_bin")  # BINS rows at most
        bins = bins.withColumn("_to", F.sum("_n").over(along)).withColumn("_from", F.col("_to") - F.col("_n"))
        hit = open_.join(bins, [*by, "_lo", "_hi"]).where("rank - _below >= _from and rank - _below < _to")
        found = F.when((F.col("_a") == F.col("_b")) | (F.col("rank") - F.col("_below") == F.col("_from")), F.col("_a")).when(F.col("rank") - F.col("_below") == F.col("_to") - 1, F.col("_b"))
        step = written(hit.select(*by, "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_from")).alias("_below"), found.alias("value")), "ranks")
        part = step.where("value is not null").select(*by, "rank", "value")
        done = part if done is None else done.unionByName(part)
        open_ = step.where("value is null").drop("value")
        if not open_.limit(1).count():
            return done


def quantile(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, q): the quantile of the values that are not null, interpolated between neighbours."""
    if not 0 <= share <= 1:
        raise ValueError("share must be within [0, 1]")
    some = written(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, value), "values")
    place = some.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, ((F.col("_n") - 1) * share).alias("_p"))
    low = F.floor("_p").cast("long")
    ranks = place.select(*by, F.explode(F.array_distinct(F.array(low, F.ceil("_p").cast("long")))).alias("rank"))
    found = order_statistics(some, by, value, ranks)
    both = place.join(found, by).groupBy(*by, "_p").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    return both.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_p") - F.floor("_p"))).alias("q"))
