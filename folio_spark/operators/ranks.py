"""Places in one order over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.sources.stores import checkpointed


def global_rank(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their place (from 1) in the order: sorted by ranges, numbered in each, and moved by the counts before."""
    laid = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for p, n in sorted(laid.groupBy(part.alias("p")).count().collect()):  # a row a partition
        before.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_p long, _before long")
    return laid.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, at + F.col("_before") + 1).drop("_id", "_p", "_before")


def rank_within(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """The place (from 1) among the rows with the same keys. A key with most of the rows is spread over many tasks."""
    placed = checkpointed(global_rank(rows, [*keys, *order], "_at"))
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return placed.join(first, keys).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")
