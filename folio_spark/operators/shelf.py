"""Shelves, groups, progress, history and stores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import global_rank, rank_within


def in_group(group: Column, wanted: int) -> Column:
    """-1: every book, 0: books without a group, else those with the group's bit."""
    return F.lit(True) if wanted == -1 else group == 0 if wanted == 0 else group.bitwiseAND(wanted) != 0


def set_bit(group: Column, bit: int, on: Column) -> Column:
    return F.when(on, group.bitwiseOR(bit)).otherwise(group.bitwiseAND(~bit))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Incoming rows win by key; the `keep` columns fall back to the stored value where the incoming one is null. Of incoming rows
    of one key the last by `order` (or else by their values) is taken. A null key is a key."""
    new = F.col("_new")
    own = [c for c in stored.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.max_by(F.struct(*own), F.struct(*([order] if order else []), *own)).alias("_r")).select(*keys, "_r.*", F.lit(True).alias("_new"))
    same = functools.reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep else F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in own]
    both = stored.alias("o").join(once.alias("n"), same, "full_outer")
    return both.select(*(F.when(new, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys), *(v.alias(c) for v, c in zip(cols, own)))


#: Origins and schemes of books that were imported from files.
LOCAL = ("local-txt", "local-epub")
#: What a saved book keeps of the stored one where it has nothing itself.
KEPT = ("dur_chapter_index", "dur_chapter_title", "dur_chapter_time", "dur_chapter_pos", "total_chapter_num", "last_check_time", "group")


def is_local(origin: Column, url: Column) -> Column:
    return F.coalesce(F.trim(origin).isin(*LOCAL), F.lit(False)) | F.coalesce(F.trim(url).rlike("^(local-txt|local-epub):"), F.lit(False))


def save_books(shelf: DataFrame, incoming: DataFrame, keep: tuple[str, ...] = KEPT) -> DataFrame:
    """A shelf after incoming books: each replaces the first stored one of its URL, or of its name and author if neither is
    local, in its place; others go to the end in their own order. Both tables: book_url, origin, name, author, place
    and more. Of incoming books for one place the last wins."""
    new = incoming.withColumn("_local", is_local(F.col("origin"), F.col("book_url")))
    # One incoming row for each URL, and for each name and author of remote ones: the last, at the first one's place.
    for keys, some in ((["book_url"], F.lit(True)), (["name", "author"], ~F.col("_local") & (F.coalesce("name", F.lit("")) != ""))):
        group = F.when(some, F.struct(*keys)).otherwise(F.struct(*(F.concat(F.lit("\0"), F.col("place").cast("string")).alias(k) for k in keys)))
        cols = [c for c in new.columns if c != "place"]
        new = new.groupBy(group.alias("_g")).agg(F.max_by(F.struct(*cols), "place").alias("_r"), F.min("place").alias("place")).select("_r.*", "place")
    old = shelf.withColumn("_local", is_local(F.col("origin"), F.col("book_url")))
    by_url = new.select("book_url", F.col("place").alias("_new")).join(old.select("book_url", F.col("place").alias("_old")), "book_url").select("_new", "_old")
    named = lambda t, c: t.where("not _local and name <> ''").select("name", F.coalesce("author", F.lit("")).alias("author"), F.col("place").alias(c))
    by_name = named(new, "_new").join(named(old, "_old"), ["name", "author"]).select("_new", "_old")
    target = by_url.unionByName(by_name).groupBy("_new").agg(F.min("_old").alias("_old"))
    taken = target.groupBy("_old").agg(F.max("_new").alias("_new"))
    last = shelf.agg(F.coalesce(F.max("place"), F.lit(0)).alias("_last"))  # one row
    fresh = new.join(target, new["place"] == target["_new"], "left_anti").crossJoin(F.broadcast(last)).withColumn("place", F.col("_last") + F.col("place")).select(shelf.columns)
    pairs = taken.join(new.alias("n"), F.col("_new") == F.col("n.place")).join(shelf.alias("o"), F.col("_old") == F.col("o.place"))
    cols = [F.col("o.place") if c == "place" else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep else F.col(f"n.{c}") for c in shelf.columns]
    replaced = pairs.select(*(v.alias(c) for v, c in zip(cols, shelf.columns)))
    rest = shelf.join(taken.select(F.col("_old").alias("place")), "place", "left_anti").select(shelf.columns)
    return rest.unionByName(replaced).unionByName(fresh)


def switch_source(shelf: DataFrame, choice: DataFrame, detail: DataFrame, fields: list[str]) -> DataFrame:
    """A shelf after books change their source. choice: book_url (the old one), new_url, new_origin and candidate fields;
    detail: book_url (the new one) and fields. Candidate fields that say something win, then the book's own; what
    is still missing is filled from the detail. toc_url starts empty; another row at the new URL goes."""
    c = choice.select(F.col("book_url"), "new_url", "new_origin", *(F.col(f).alias(f"_c_{f}") for f in fields))
    d = detail.select(F.col("book_url").alias("new_url"), *(F.col(f).alias(f"_d_{f}") for f in fields), F.col("toc_url").alias("_d_toc")).dropDuplicates(["new_url"])
    said = lambda x: F.nullif(F.trim(F.col(x)), F.lit(""))
    moved = shelf.join(c, "book_url").join(d, "new_url", "left")
    cols = {"book_url": F.col("new_url"), "origin": F.col("new_origin"), "toc_url": said("_d_toc"), **{f: F.coalesce(said(f"_c_{f}"), said(f), said(f"_d_{f}")) for f in fields}}
    moved = moved.select(*(cols.get(x, F.col(x)).alias(x) for x in shelf.columns))
    rest = shelf.join(choice.select("book_url"), "book_url", "left_anti").join(choice.select(F.col("new_url").alias("book_url")), "book_url", "left_anti")
    return rest.select(shelf.columns).unionByName(moved)


def chapter_books(chapters: DataFrame, shelf: DataFrame) -> DataFrame:
    """chapter_url and the place of the first book on the shelf whose URL begins it, or whose path, at the same host,
    begins its path or is begun by it. chapters: chapter_url. shelf: book_url, place.

    Each side's beginnings are written out and met by equality, so a host with many books makes no pairs of its own.
    """
    from folio_spark.functions.urls import host

    path = lambda c: F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/")), "/+$", "")
    whole = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    starts = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    c = chapters.select("chapter_url", host(F.col("chapter_url")).alias("host"), whole(F.col("chapter_url")).alias("full"), path(F.col("chapter_url")).alias("path")).where("host <> ''")
    b = shelf.select("book_url", "place", host(F.col("book_url")).alias("host"), path(F.col("book_url")).alias("path")).where("host <> ''")
    books = b.groupBy("host", "path").agg(F.min("place").alias("place"))
    below = c.select("chapter_url", "host", F.explode(starts(F.col("full"))).alias("path")).join(books, ["host", "path"]).select("chapter_url", "place")
    above = books.select("host", "place", F.explode(starts(F.col("path"))).alias("path")).groupBy("host", "path").agg(F.min("place").alias("place"))
    above = c.select("chapter_url", "host", "path").join(above, ["host", "path"]).select("chapter_url", "place")
    return below.unionByName(above).groupBy("chapter_url").agg(F.min("place").alias("place"))


def recent_matches(kind: Column, wanted: str, keyword: str, *fields: str) -> Column:
    """The recent list's filter: 'book' (all but feed items), 'rss' or any kind; a keyword within one of the fields."""
    of_kind = {"book": ~F.coalesce(kind == "rss", F.lit(False)), "rss": F.coalesce(kind == "rss", F.lit(False))}.get(wanted, F.lit(True))
    word = keyword.strip().lower()
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(F.lower(f), F.lit(word)), F.lit(False))
    return of_kind & found if word else of_kind


def in_scope(scope: str, name: str, groups: Column, url: Column, enabled: Column) -> Column:
    """Enabled feeds of a scope: all, a group, or one source."""
    hit = F.lit(True) if scope == "all" else F.array_contains(groups, name) if scope == "group" and name else url == name
    return F.coalesce(enabled, F.lit(True)) & F.coalesce(hit, F.lit(False))


def upsert_list(stored: DataFrame, incoming: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """Keyed list upsert: replaced rows keep their place, new ones go to the end in their own order."""
    old = stored.groupBy(*keys).agg(F.min(place).alias("_at"))
    last = stored.agg(F.coalesce(F.max(place), F.lit(0)).alias("_last"))
    fresh = incoming.join(old, keys, "left").crossJoin(F.broadcast(last)).withColumn(place, F.coalesce("_at", F.col("_last") + F.col(place))).select(stored.columns)
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def delete_matching(shelf: DataFrame, gone: DataFrame) -> DataFrame:
    """Without rows of the same URL, or of the same non-empty name and author if neither is local."""
    rest = shelf.join(gone.select("book_url").where("book_url <> ''").distinct(), "book_url", "left_anti")
    named = gone.where("not local and name <> '' and author <> ''").select("name", "author").distinct().withColumn("local", F.lit(False))
    return rest.join(named, ["name", "author", "local"], "left_anti").select(shelf.columns)


def latest_per_key(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    best = rows.groupBy(*keys).agg(F.max(F.struct(time, tie, F.struct(*(c for c in rows.columns if c not in (time, tie, *keys))).alias("_r"))).alias("_b"))
    return best.select(*keys, f"_b.{time}", f"_b.{tie}", "_b._r.*")


def progress(shelf: DataFrame, toc: DataFrame, saves: DataFrame) -> DataFrame:
    """Latest saved chapter of each book with its title, the number of chapters and the last title."""
    at = saves.groupBy("book_url").agg(F.max(F.struct("time", "idx")).alias("s")).select("book_url", "s.*")
    size = toc.groupBy("book_url").agg(F.count("*").alias("total"), F.max(F.struct("idx", "title")).alias("l")).select("book_url", "total", F.col("l.title").alias("last_title"))
    return shelf.join(at, "book_url").join(toc.select("book_url", "idx", "title"), ["book_url", "idx"], "left").join(size, "book_url", "left")


def unread(total: Column, current: Column) -> Column:
    return F.greatest(F.lit(0), total - 1 - current)


def request_rate(requests: DataFrame, window_s: int, limit: int) -> DataFrame:
    """For each request how many of its source fall in the trailing window, and whether that breaks the limit.

    Time is cut into buckets as long as the window. A request counts in its own bucket and the next, and those are the only ones
    that hold requests of its window, so the groups are a source's buckets: a source with most of the requests is many groups."""
    width = window_s * 1_000_000
    at = F.unix_micros("ts")
    bucket = F.floor(at / width)
    rows = requests.withColumn("_at", at).withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).withColumn("_own", F.col("_bucket") == bucket)
    w = W.partitionBy("source", "_bucket").orderBy("_at").rangeBetween(-width, 0)
    counted = rows.withColumn("in_window", F.count("*").over(w)).where("_own").drop("_at", "_bucket", "_own")
    return counted.withColumn("over", F.col("in_window") > limit)


def too_soon(requests: DataFrame, least_ms: int, tie: str) -> DataFrame:
    """For each request whether it comes less than the least gap behind the one before it of the same source.

    Gaps within a day come from windows of a source and day; the first of a day looks back to the last of the days before,
    so a source with most of the requests is many groups."""
    day = F.to_date("ts")
    rows = requests.withColumn("_day", day)
    own = W.partitionBy("source", "_day").orderBy("ts", tie)
    ends = rows.groupBy("source", "_day").agg(F.max("ts").alias("_last"))
    earlier = ends.withColumn("_before", F.max("_last").over(W.partitionBy("source").orderBy("_day").rowsBetween(W.unboundedPreceding, -1))).select("source", "_day", "_before")
    gap = F.unix_micros("ts") - F.unix_micros(F.coalesce("_lag", "_before"))
    return rows.withColumn("_lag", F.lag("ts").over(own)).join(earlier, ["source", "_day"]).withColumn("too_soon", F.coalesce(gap < least_ms * 1000, F.lit(False))).drop("_day", "_lag", "_before")


def neighbours(rows: DataFrame, key: str, idx: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(idx)
    return rows.select(key, idx, F.lead(idx, 1).over(w).alias("next_1"), F.lead(idx, 2).over(w).alias("next_2"), F.lag(idx, 1).over(w).alias("previous"))


def move_to_front(rows: DataFrame, place: str, chosen: Column) -> DataFrame:
    """Places counted anew with the chosen rows first."""
    return global_rank(rows, [F.when(chosen, 0).otherwise(1), place], "new_place")


def move_row(rows: DataFrame, place: str, key: str, moved: str, target: str, after: bool = False) -> DataFrame:
    """Places counted anew with one row before or after another; nothing moves if either is missing."""
    at = rows.where(F.col(key) == target).agg(F.first(place).alias("_t"))  # one row
    has = rows.where(F.col(key) == moved).agg((F.count("*") > 0).alias("_m"))  # one row
    both = rows.crossJoin(F.broadcast(at)).crossJoin(F.broadcast(has))
    goes = F.col("_m") & F.col("_t").isNotNull() & (F.col(key) == moved) & F.lit(moved != target)
    return global_rank(both.withColumn("_o", F.when(goes, F.col("_t")).otherwise(F.col(place))).withColumn("_s", F.when(goes, 1 if after else -1).otherwise(0)), ["_o", "_s", place], "new_place").drop("_o", "_s", "_t", "_m")


def feed_page(articles: DataFrame, source: str, order: list[Column | str], page: int, size: int = 50) -> DataFrame:
    """The rows of a page (from 1) of a scope's feeds: of each source its `size` rows of that page, with their place; has_more tells
    whether any source fills the page."""
    placed = rank_within(articles, [source], order)
    shown = placed.where(F.col("place").between((page - 1) * size + 1, page * size))
    full = shown.groupBy(source).count().agg(F.coalesce(F.max("count") >= size, F.lit(False)).alias("has_more"))  # one row
    return shown.crossJoin(F.broadcast(full))
