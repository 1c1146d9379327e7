"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are put in one order, equal texts side by side; every row learns how many bytes stand before it from the
running sum in its partition plus the totals of the partitions before. Cuts at equal byte targets then give
contiguous shards. A cut that falls inside a group of equal texts moves to the nearer end of the group if the
group has at most `whole` of a shard's bytes; a larger group is split, since sizes must stay near equal. So a shard differs
from its target by at most `whole` of it (half of that at each end) and one row; with whole=0 every cut stays where it falls.

Defined results: a null text counts as no bytes (size 1) and equals an empty one; repeated rows are rows of
their own, each with its own slot; null ids are placed like any other; an empty table gives no rows; a text of any length
is one row, never cut; columns beyond id and text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize


def _running(size_at: int):
    """Adds the bytes and rows that stand before each row in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = rows = 0
        for b in batches:
            size = b.column(size_at).to_numpy()
            ends = total + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - size), pa.array(rows + np.arange(len(size)))], [*b.schema.names, "_start", "_row"])
            total, rows = int(ends[-1]) if len(ends) else total, rows + len(size)

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", whole: float = 1 / 64) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of docs; shards are contiguous and of near equal size."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_group"), F.monotonically_increasing_id().alias("_tie"))
    in_order = sizes.repartitionByRange("_group", id_col, "_tie").sortWithinPartitions("_group", id_col, "_tie").drop("_tie").withColumn("_pid", F.spark_partition_id())
    schema = T.StructType([*in_order.schema, T.StructField("_start", T.LongType()), T.StructField("_row", T.LongType())])
    placed = materialize(in_order.mapInArrow(_running(in_order.columns.index("size")), schema), "shards")

    # One row for each partition: all that the driver sees of the table, apart from one row for each cut.
    parts = sorted(placed.groupBy("_pid").agg(F.sum("size"), F.count("*")).collect())
    before, total, rows = [], 0, 0
    for pid, size, n in parts:
        before.append((pid, total, rows))
        total, rows = total + size, rows + n
    offsets = spark.createDataFrame(before, "_pid int, _bytes long, _rows long")
    laid = placed.join(F.broadcast(offsets), "_pid").select(id_col, "size", "text_crc32", "_group", (F.col("_start") + F.col("_bytes")).alias("_start"), (F.col("_row") + F.col("_rows")).alias("_row"))

    targets = [total * j // shards for j in range(1, shards)]
    cuts = list(targets)
    if total:
        inside = F.lit(False)
        for t in targets:
            inside = inside | ((F.col("_start") < t) & (F.col("_start") + F.col("size") > t))
        crossed = laid.where(inside).select("_group", "_start", "size").collect()  # a row for each cut at most
        groups = {r["_group"]: r for r in laid.where(F.col("_group").isin([r["_group"] for r in crossed])).groupBy("_group").agg(F.min("_start").alias("lo"), F.max(F.col("_start") + F.col("size")).alias("hi")).collect()} if crossed else {}
        for j, t in enumerate(targets):
            for r in crossed:
                if r["_start"] < t < r["_start"] + r["size"]:
                    g = groups[r["_group"]]
                    lo, hi = (g["lo"], g["hi"]) if g["hi"] - g["lo"] <= whole * total / shards else (r["_start"], r["_start"] + r["size"])
                    cuts[j] = lo if t - lo <= hi - t else hi
    firsts = laid.agg(*(F.count_if(F.col("_start") < c).alias(f"c{j}") for j, c in enumerate(cuts))).first() if cuts else []
    firsts = [0, *firsts]
    shard = sum(((F.col("_start") >= c).cast("int") for c in cuts), F.lit(0))
    first = F.element_at(F.array(*(F.lit(int(x)).cast("long") for x in firsts)), F.col("shard") + 1)
    return laid.withColumn("shard", shard).select(id_col, "size", "text_crc32", "shard", (F.col("_row") - first).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_by_bytes(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
