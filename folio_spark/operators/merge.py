"""Listings from many sources: merging, dedup, matching, ranking, validation.

A listing has origin, source_ord, item_ix, name, author, book_url and optional fields; (source_ord, item_ix, book_url)
is its order, and 'first' always means the least of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio_spark.functions.text import bare_author, bare_name, merge_key, without_punctuation

ORDER = ("source_ord", "item_ix", "book_url")


def _ord() -> Column:
    return F.struct(*ORDER)


#: The fields of a merged listing that later sources fill.
FILLED = ("cover_url", "intro", "kind", "last_chapter", "update_time")


def merge_listings(rows: DataFrame, fill: tuple[str, ...] = ("kind",), as_array: bool = False) -> DataFrame:
    """One row for each (name, author): the first listing, its empty fields filled from later ones, and the origins in the
    order in which they were first seen (null for a single listing), as one text or an array."""
    first_seen = rows.withColumn("merge_key", merge_key(F.col("name"), F.col("author"))).groupBy("merge_key", "origin").agg(
        F.min(F.struct(_ord().alias("o"), "name", "author", "book_url", *fill)).alias("base"), F.count("*").alias("n"), *(F.min(F.when(F.col(c).isNotNull(), F.struct(_ord().alias("o"), F.col(c).alias("v")))).alias(f"f_{c}") for c in fill)
    )
    out = first_seen.groupBy("merge_key").agg(F.min("base").alias("base"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("base.o", "origin"))).alias("seen"), *(F.min(f"f_{c}").alias(f"f_{c}") for c in fill))
    origins = F.transform("seen", lambda x: x["origin"])
    origins = origins if as_array else F.array_join(origins, ",")
    return out.select("merge_key", "base.name", "base.author", "base.book_url", *(F.coalesce(F.col(f"base.{c}"), F.col(f"f_{c}.v")).alias(c) for c in fill), F.when(F.col("n") > 1, origins).alias("origins"))


def first_seen(rows: DataFrame, *keys: str) -> DataFrame:
    """The first listing of each key, without a shuffle of what a partial minimum can drop."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(*ORDER, F.struct(*(c for c in rows.columns if c not in ORDER)).alias("rest"))).alias("r"))
    return best.select("r.*").select(*ORDER, "rest.*").select(*rows.columns)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k_name", bare_name(F.col("name"))).withColumn("k_author", bare_author(F.col("author")))


def kept_listings(rows: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """k_name, k_author, o, origin and book_url of the listings that the first `limit` alternates of any target come from.

    Targets of one name differ only in the origin that they leave out. So a name keeps `limit` listings of each origin, and of
    these the first 2 * limit, of which at least half are of other origins than any one."""
    keys = _named(targets).select("k_name", "k_author").distinct()
    once = _named(rows).join(keys, ["k_name", "k_author"], "left_semi").groupBy("k_name", "k_author", "origin", "book_url").agg(F.min(F.struct("source_ord", "item_ix")).alias("o"))
    of_origin = W.partitionBy("k_name", "k_author", "origin").orderBy("o", "book_url")
    of_name = W.partitionBy("k_name", "k_author").orderBy("o", "origin", "book_url")
    return once.withColumn("_n", F.row_number().over(of_origin)).where(F.col("_n") <= limit).withColumn("_n", F.row_number().over(of_name)).where(F.col("_n") <= 2 * limit).drop("_n")


def _elsewhere(rows: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """target_id and `found`: structs o, origin, book_url of the first `limit` listings by order that match a target's name and
    author and are of another origin, one a source and URL. Targets meet one row a name, not its listings."""
    lists = kept_listings(rows, targets, limit).groupBy("k_name", "k_author").agg(F.sort_array(F.collect_list(F.struct("o", "origin", "book_url"))).alias("_all"))
    left = _named(targets).select("target_id", "k_name", "k_author", F.col("origin").alias("own"))
    others = F.slice(F.filter("_all", lambda x: x["origin"] != F.col("own")), 1, limit)
    return left.join(lists, ["k_name", "k_author"]).select("target_id", others.alias("found")).where(F.size("found") > 0)


def alternates(rows: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """Listings elsewhere that match a target's name and author: one a source and URL, `limit` a target by order. A target is one row."""
    found = _elsewhere(rows, targets, min(100, max(1, limit))).select("target_id", F.posexplode("found").alias("_at", "f"))
    return found.select("target_id", (F.col("_at") + 1).alias("rank"), "f.origin", "f.book_url")


def bounded_alternates(rows: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """target_id, last_index and has_more of a target's first `limit` alternates, of 100 at most that are looked for."""
    found = _elsewhere(rows, targets, 100).select("target_id", F.size("found").alias("n"))
    last = F.least(F.lit(min(100, max(1, limit))), F.col("n"))
    return found.select("target_id", last.alias("last_index"), (F.col("n") > last).alias("has_more"))


def take_until(rows: DataFrame, size: int) -> DataFrame:
    """All rows of sources up to the one with which `size` rows are reached; sources are in order."""
    counts = rows.groupBy("source_ord").agg(F.count("*").alias("n"))  # a row for each source
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("source_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < size)
    return rows.join(before.select("source_ord"), "source_ord", "left_semi")


def candidate_score(name: Column, author: Column, latest: Column, target_name: Column, target_author: Column, target_latest: Column) -> Column:
    same = lambda a, b: ((without_punctuation(a) == without_punctuation(b)) & (without_punctuation(a) != "")).cast("int")
    return 3 * same(name, target_name) + 3 * same(author, target_author) + 4 * same(latest, target_latest)


def validate_sources(sources: DataFrame, search: DataFrame, explore: DataFrame) -> DataFrame:
    """Per source whether its search and explore listings have rows; valid if either has."""
    s = search.groupBy("origin").agg(F.count("*").alias("n_search"))
    e = explore.groupBy("origin").agg(F.count("*").alias("n_explore"))
    out = sources.join(s, "origin", "left").join(e, "origin", "left")
    out = out.withColumn("search_ok", F.coalesce(F.col("n_search") > 0, F.lit(False))).withColumn("explore_ok", F.coalesce(F.col("n_explore") > 0, F.lit(False)))
    return out.drop("n_search", "n_explore").withColumn("valid", F.col("search_ok") | F.col("explore_ok"))


#: Fixed value: the keyword that a source is tried with if neither the caller nor its rules name one.
KEYWORD = "斗破苍穹"


def marked_report(report: DataFrame, group: str = "group", keyword: Column | None = None, check_keyword: Column | None = None, invalid_name: str = "失效") -> DataFrame:
    """A validation report (source_name, valid and the source's group list) with the keyword tried, the group list after
    invalid sources are marked and valid ones unmarked, and marked_invalid where that changed an invalid one."""
    from folio_spark.functions.text import mark_group, split_groups

    said = lambda c: F.nullif(F.trim(c), F.lit("")) if c is not None else F.lit(None).cast("string")
    has = F.array_contains(split_groups(F.coalesce(F.col(group), F.lit(""))), invalid_name)
    after = F.when(F.col("valid") & has, mark_group(F.col(group), invalid_name, False)).when(~F.col("valid") & ~has, mark_group(F.col(group), invalid_name, True)).otherwise(F.col(group))
    return report.withColumn("keyword", F.coalesce(said(keyword), said(check_keyword), F.lit(KEYWORD))).withColumn("marked_invalid", ~F.col("valid") & ~has).withColumn(group, after)


def report_totals(reports: DataFrame, *by: str) -> DataFrame:
    """total, valid, invalid and marked_invalid of marked reports, for each batch or, without `by`, of all together."""
    return reports.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("marked_invalid").alias("marked_invalid"))


def source_overview(c: dict[str, Column]) -> Column:
    """What a catalog shows of a source, as a struct: its group, three states and six abilities. c: the source's columns."""
    full = lambda *names: sum((F.coalesce(c[n] != "", F.lit(False)).cast("int") for n in names), F.lit(0)) > 0
    off = lambda name: F.coalesce(~c[name], F.lit(False))
    return F.struct(
        F.coalesce(F.nullif(F.trim(c["group"]), F.lit("")), F.lit("未分组")).alias("group"),
        F.when(off("enabled"), "停用").otherwise("启用").alias("status_text"),
        F.when(off("enabled_explore"), "发现停用").otherwise("发现可用").alias("explore_text"),
        F.when(F.coalesce(c["cookie_jar"], F.lit(False)), "Cookie 独立").otherwise("默认 Cookie").alias("cookie_text"),
        full("search_url", "rule_search").alias("has_search"),
        full("explore_url", "rule_explore").alias("has_explore"),
        full("rule_book_info").alias("has_book_info"),
        full("rule_toc").alias("has_toc"),
        full("rule_content").alias("has_content"),
        F.coalesce(F.trim(c["login_url"]) != "", F.lit(False)).alias("has_login"),
    )
