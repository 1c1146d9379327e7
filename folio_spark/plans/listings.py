"""Queries over listings (part x lineitem x supplier), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.functions import text as X
from folio_spark.operators import merge
from folio_spark.operators.ranks import global_rank


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").join(part, "l_partkey")
    return rows.select(
        F.col("l_suppkey").alias("source_ord"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_ix"),
        F.concat(F.lit("src"), F.col("l_suppkey").cast("string")).alias("origin"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("author"),
        F.concat(F.lit("/b/"), F.col("l_partkey").cast("string")).alias("book_url"),
        F.when(F.col("l_linenumber") > 1, F.col("p_type")).alias("kind"),
    )


L = """WITH l AS (SELECT l_suppkey AS source_ord, l_orderkey * 10 + l_linenumber AS item_ix, 'src' || l_suppkey AS origin, p_name AS name, p_brand AS author,
  '/b/' || l_partkey AS book_url, CASE WHEN l_linenumber > 1 THEN p_type END AS kind FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def a01(spark, sf):
    return merge.merge_listings(listings(spark, sf))


def a02(spark, sf):
    return merge.first_seen(listings(spark, sf), "origin", "book_url")


def sources(spark, sf):
    return table(spark, sf, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("origin"), F.col("s_name").alias("source_name"), F.col("s_nationkey"))


def a03(spark, sf):
    rows = listings(spark, sf)
    return merge.validate_sources(sources(spark, sf), rows.where("kind = 'LARGE'"), rows.where("author = 'Brand#7'")).select("origin", "source_name", "search_ok", "explore_ok", "valid")


def a04(spark, sf):
    report = a03(spark, sf).groupBy(F.expr("length(origin) % 2").alias("batch")).agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    return report.agg(F.sum("total").alias("total"), F.sum("valid").alias("valid"), F.sum("invalid").alias("invalid"))


def catalog(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    groups = F.concat(F.col("n_name"), F.lit(", "), F.col("r_name"), F.lit(";;"), F.col("n_name"), F.when(F.col("s_acctbal") < 0, "、失效").otherwise(""))
    return rows.select(F.col("s_suppkey").alias("source_ord"), F.col("s_name").alias("source_name"), groups.alias("groups"), F.when(F.col("s_suppkey") % 7 == 0, F.lit(None)).otherwise(F.col("s_suppkey") % 3 == 0).alias("enabled"), F.col("s_acctbal").alias("acctbal"))


C = """WITH c AS (SELECT s_suppkey AS source_ord, s_name AS source_name, n_name || ', ' || r_name || ';;' || n_name || CASE WHEN s_acctbal < 0 THEN '、失效' ELSE '' END AS groups,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 3 = 0 END AS enabled, s_acctbal AS acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 g AS (SELECT *, list_filter(list_transform(regexp_split_to_array(groups, '[,;；、]'), lambda x: trim(x)), lambda x: x <> '') AS raw FROM c),
 d AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS names FROM g)"""


def p01(spark, sf):
    return catalog(spark, sf).select("source_ord", F.array_join(X.split_groups(F.col("groups")), "|").alias("names"))


def p02(spark, sf):
    c = catalog(spark, sf)
    return c.select("source_ord", F.array_contains(X.split_groups(F.col("groups")), "NATION_1").alias("exact"), F.contains("groups", F.lit("NATION_1")).alias("within"))


def p03(spark, sf):
    c = catalog(spark, sf)
    marked = F.when(F.col("acctbal") < 1000, X.mark_group(F.col("groups"), "失效", True)).otherwise(X.mark_group(F.col("groups"), "失效", False))
    return c.select("source_ord", marked.alias("names"), (marked != F.array_join(X.split_groups(F.col("groups")), ",")).alias("changed"))


def p04(spark, sf):
    c = catalog(spark, sf)
    return c.where(F.contains(F.lower("source_name"), F.lit("00001")) & F.array_contains(X.split_groups(F.col("groups")), "NATION_2")).select("source_ord", "source_name")


def p05(spark, sf):
    c = catalog(spark, sf)
    return c.select("source_ord", F.coalesce("enabled", F.lit(True)).alias("enabled"), (F.col("acctbal") > 0).alias("has_search"), F.when(~F.coalesce("enabled", F.lit(True)), "off").when(F.col("acctbal") < 0, "invalid").otherwise("ready").alias("status"))


def a05(spark, sf):
    c = catalog(spark, sf)
    return c.agg(F.count("*").alias("total"), F.count_if(F.coalesce("enabled", F.lit(True))).alias("enabled"), F.count_if(F.contains("groups", F.lit("NATION_3"))).alias("filtered"))


def a06(spark, sf):
    return catalog(spark, sf).select(F.explode(X.split_groups(F.col("groups"))).alias("group_name")).distinct()


def targets(spark, sf):
    part = table(spark, sf, "part").where("p_partkey % 20 = 0")
    return part.select(F.col("p_partkey").alias("target_id"), F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("name"), F.concat(F.lit("作者："), F.col("p_brand")).alias("author"), F.concat(F.lit("src"), (F.col("p_partkey") % 10).cast("string")).alias("origin"))


def j08(spark, sf):
    return merge.alternates(listings(spark, sf), targets(spark, sf), 20)


def j11(spark, sf):
    c = catalog(spark, sf).select(F.concat(F.lit("src"), F.col("source_ord").cast("string")).alias("origin"), "source_name", "groups").where("length(source_name) > 0")
    out = listings(spark, sf).join(c, "origin", "left")
    return out.select("origin", "item_ix", "book_url", F.coalesce("source_name", "origin").alias("origin_name"), F.coalesce("groups", F.lit("")).alias("origin_group"))


def t05(spark, sf):
    return merge.bounded_alternates(listings(spark, sf), targets(spark, sf), 5)


def t06(spark, sf):
    return merge.take_until(listings(spark, sf), 5000).groupBy("source_ord").agg(F.count("*").alias("n"))


def t07(spark, sf):
    part = table(spark, sf, "part")
    first = part.where("p_partkey = 0").select(F.col("p_name").alias("tn"), F.col("p_brand").alias("ta"), F.col("p_type").alias("tl"))  # one row
    score = merge.candidate_score(F.concat("p_name", F.lit("!")), F.col("p_brand"), F.lower("p_type"), F.col("tn"), F.col("ta"), F.col("tl"))
    return part.join(F.broadcast(first)).select("p_partkey", score.alias("score"))


def t08(spark, sf):
    rows = global_rank(table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"])
    return rows.select("s_suppkey", F.floor((F.col("place") - 1) / 100).alias("batch"))


def t02(spark, sf):
    own = F.coalesce(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")), F.lit(0))
    return global_rank(table(spark, sf, "supplier").select("s_suppkey", "s_name"), [own, "s_name"]).select("s_suppkey", "place")


def t02_latest(spark, sf):
    """Sources with the last changed first."""
    return global_rank(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("updated_at")), [F.desc("updated_at"), "o_orderkey"]).select("o_orderkey", "place")


def o04(spark, sf):
    shown = table(spark, sf, "part").where("p_size > 25").select("p_partkey")
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(shown, "p_partkey", "left_semi")


QUERIES = {
    "a01_merge_listings": a01, "a02_first_seen": a02, "a03_validate_sources": a03, "a04_merge_reports": a04, "a05_catalog_stats": a05, "a06_group_names": a06,
    "p01_split_groups": p01, "p02_has_group": p02, "p03_mark_group": p03, "p04_catalog_filter": p04, "p05_catalog_overview": p05,
    "j08_alternates": j08, "j11_listing_source": j11, "t02_catalog_order": t02, "t02_latest_first": t02_latest, "t05_bounded_alternates": t05, "t06_take_until": t06, "t07_candidate_score": t07, "t08_batches": t08, "o04_visible_selection": o04,
}

_ALT = L + """, t AS (SELECT p_partkey AS target_id, p_name AS name, p_brand AS author, 'src' || (p_partkey % 10) AS origin FROM part WHERE p_partkey % 20 = 0),
 r AS (SELECT regexp_replace(name, '\\s+', '', 'g') AS kn, regexp_replace(author, '\\s+', '', 'g') AS ka, origin, book_url, min((source_ord, item_ix)) AS o FROM l GROUP BY ALL),
 m AS (SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY o, r.origin, book_url) AS rank, r.origin, book_url
       FROM t JOIN r ON regexp_replace(t.name, '\\s+', '', 'g') = kn AND regexp_replace(t.author, '\\s+', '', 'g') = ka AND t.origin <> r.origin)"""

SQL = {
    "a01_merge_listings": L + """, k AS (SELECT *, lower(trim(name)) || '|' || lower(trim(author)) AS merge_key FROM l),
 o AS (SELECT merge_key, origin, min((source_ord, item_ix, book_url)) AS f FROM k GROUP BY ALL),
 s AS (SELECT merge_key, string_agg(origin, ',' ORDER BY f, origin) AS origins FROM o GROUP BY 1)
SELECT k.merge_key, arg_min(name, (source_ord, item_ix, book_url)) AS name, arg_min(author, (source_ord, item_ix, book_url)) AS author, arg_min(book_url, (source_ord, item_ix, book_url)) AS book_url,
  coalesce(arg_min(kind, (source_ord, item_ix, book_url)) FILTER (kind IS NOT NULL)) AS kind, CASE WHEN count(*) > 1 THEN any_value(origins) END AS origins FROM k JOIN s USING (merge_key) GROUP BY 1""",
    "a02_first_seen": L + " SELECT source_ord, item_ix, book_url, origin, name, author, kind FROM l QUALIFY row_number() OVER (PARTITION BY origin, book_url ORDER BY source_ord, item_ix, kind NULLS FIRST) = 1",
    "a03_validate_sources": L + """, v AS (SELECT 'src' || s_suppkey AS origin, s_name AS source_name, EXISTS (SELECT 1 FROM l WHERE l.source_ord = s_suppkey AND kind = 'LARGE') AS search_ok,
  EXISTS (SELECT 1 FROM l WHERE l.source_ord = s_suppkey AND author = 'Brand#7') AS explore_ok FROM supplier) SELECT *, search_ok OR explore_ok AS valid FROM v""",
    "a04_merge_reports": L + """, v AS (SELECT EXISTS (SELECT 1 FROM l WHERE l.source_ord = s_suppkey AND (kind = 'LARGE' OR author = 'Brand#7')) AS ok FROM supplier)
 SELECT count(*) AS total, count_if(ok) AS valid, count_if(NOT ok) AS invalid FROM v""",
    "a05_catalog_stats": C + " SELECT count(*) AS total, count_if(coalesce(enabled, true)) AS enabled, count_if(contains(groups, 'NATION_3')) AS filtered FROM c",
    "a06_group_names": C + " SELECT DISTINCT unnest(names) AS group_name FROM d",
    "p01_split_groups": C + " SELECT source_ord, array_to_string(names, '|') AS names FROM d",
    "p02_has_group": C + " SELECT source_ord, list_contains(names, 'NATION_1') AS exact, contains(groups, 'NATION_1') AS within FROM d",
    "p03_mark_group": C + """, e AS (SELECT *, list_filter(names, lambda x: x <> '失效') AS rest FROM d), f AS (SELECT *, array_to_string(CASE WHEN acctbal < 1000 THEN list_append(rest, '失效') ELSE rest END, ',') AS m FROM e)
 SELECT source_ord, m AS names, m <> array_to_string(f.names, ',') AS changed FROM f""",
    "p04_catalog_filter": C + " SELECT source_ord, source_name FROM d WHERE contains(lower(source_name), '00001') AND list_contains(names, 'NATION_2')",
    "p05_catalog_overview": C + " SELECT source_ord, coalesce(enabled, true) AS enabled, acctbal > 0 AS has_search, CASE WHEN NOT coalesce(enabled, true) THEN 'off' WHEN acctbal < 0 THEN 'invalid' ELSE 'ready' END AS status FROM c",
    "j08_alternates": _ALT + " SELECT target_id, rank, origin, book_url FROM m WHERE rank <= 20",
    "j11_listing_source": L + """, c AS (SELECT 'src' || s_suppkey AS origin, s_name AS source_name, n_name || ', ' || r_name || ';;' || n_name || CASE WHEN s_acctbal < 0 THEN '、失效' ELSE '' END AS groups
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT l.origin, item_ix, book_url, coalesce(source_name, l.origin) AS origin_name, coalesce(groups, '') AS origin_group FROM l LEFT JOIN c ON l.origin = c.origin""",
    "t02_latest_first": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders",
    "t02_catalog_order": "SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey ELSE 0 END, s_name) AS place FROM supplier",
    "t05_bounded_alternates": _ALT + " SELECT target_id, CAST(least(5, max(rank)) AS INTEGER) AS last_index, least(100, max(rank)) > least(5, max(rank)) AS has_more FROM m GROUP BY 1",
    "t06_take_until": L + ", n AS (SELECT source_ord, count(*) AS n FROM l GROUP BY 1), b AS (SELECT *, sum(n) OVER (ORDER BY source_ord) - n AS before FROM n) SELECT source_ord, n FROM b WHERE before < 5000",
    "t07_candidate_score": """WITH t AS (SELECT p_name AS tn, p_brand AS ta, p_type AS tl FROM part WHERE p_partkey = 0)
 SELECT p_partkey, 3 * CAST(lower(p_name) = lower(tn) AS INT) + 3 * CAST(lower(p_brand) = lower(ta) AS INT) + 4 * CAST(lower(p_type) = lower(tl) AS INT) AS score FROM part, t""",
    "t08_batches": "SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 100 AS batch FROM supplier",
    "o04_visible_selection": "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)",
}
