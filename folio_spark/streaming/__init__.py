"""Structured Streaming forms of the incremental operators. State is bounded by watermarks; rows later than that are
dropped and counted in the query's progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen_stream(rows: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each key while its state lasts."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def caching_counters(rows: DataFrame, key: str, outcome: str) -> DataFrame:
    """Running counts of outcomes by key, for update mode."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(outcome) == x).alias(x) for x in ("cached", "success", "failed")))


def coalesced_progress(rows: DataFrame, keys: list[str], time: str = "ts", interval: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """One save for each key and interval: the latest."""
    rest = [c for c in rows.columns if c not in (*keys, time)]
    w = rows.withWatermark(time, delay).groupBy(F.window(time, interval), *keys).agg(F.max(F.struct(time, *rest)).alias("last"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "last.*")


def latest_into(store, keys: list[str], time: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the latest row of each key of a batch goes into a store unless the store's is newer.
    Doing a batch again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, time)]
        new = batch.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("x")).select(*keys, "x.*")
        old = store.read()
        if old is not None:
            seen = old.select(*keys, F.col(time).alias("_t"))
            new = new.join(seen, keys, "left").where(F.col("_t").isNull() | (F.col(time) > F.col("_t"))).drop("_t")
        store.put(new)

    return write


def new_articles(feeds: DataFrame, time: str = "ts", delay: str = "1 day", body: str = "body") -> DataFrame:
    """Articles of a stream of feed bodies (origin, body, time), each (origin, link) once while its state lasts."""
    from folio_spark.sources.catalogs import feed_articles

    rows = feed_articles(feeds.select("origin", time, body), body).where("link is not null")
    return first_seen_stream(rows, ["origin", "link"], time, delay)


def knowledge_into(store, merge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch's rows (book, idx of the chapter, ord and more) of chapters beyond a book's
    high-water mark are merged behind what the store holds of the book. Doing a batch again changes nothing.

    store: keyed by book and key, with the mark in `processed`. merge: one of the merges of knowledge tables.
    """
    from folio_spark.operators.knowledge import in_order

    def write(batch: DataFrame, _: int) -> None:
        old = store.read()
        rows = batch
        if old is not None:
            marks = old.groupBy("book").agg(F.max("processed").alias("_mark"))
            rows = batch.join(marks, "book", "left").where(F.col("_mark").isNull() | (F.col("idx") > F.col("_mark"))).drop("_mark")
        mark = rows.groupBy("book").agg(F.max("idx").alias("processed"))
        if old is None:
            merged = merge(rows)
        else:
            touched = old.join(mark.select("book"), "book", "left_semi")
            known = touched.withColumn("ord", F.lit(0)).drop("processed", "key")
            merged = merge(in_order(known, rows.select(*(c for c in rows.columns if c in (*known.columns, "ord")))))
        store.put(merged.join(mark, "book"))

    return write
