"""Queries of knowledge tables (part x lineitem as characters and relations), frontiers and prefix joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio_spark.functions import urls as U
from folio_spark.operators import knowledge as K

from .listings import table


def characters(spark, sf):
    p = table(spark, sf, "part")
    return p.select((F.col("p_partkey") % 50).alias("book"), F.col("p_partkey").alias("ord"), F.concat(F.lit(" "), F.col("p_brand")).alias("name"), F.array("p_type").alias("aliases"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("status"), F.col("p_name").alias("description"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("p_size") % 3 + 1).cast("int")).alias("importance"))


def relations(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") % 20).alias("book"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("ord"), F.concat(F.lit("n"), (F.col("l_partkey") % 30).cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("l_suppkey") % 30).cast("string")).alias("target"), F.col("l_returnflag").alias("relation"), F.lit("").alias("status"), F.col("l_linestatus").alias("description"))


def a08(spark, sf):
    return K.merge_characters(characters(spark, sf)).select("book", "key", F.trim("name").alias("name"), F.array_join("aliases", ",").alias("aliases"), "status", "description", "importance")


def a09(spark, sf):
    return K.merge_relations(relations(spark, sf)).select("book", "x", "y", "relation")


def a14(spark, sf):
    return K.degrees(K.graph_links(relations(spark, sf)))


def g03(spark, sf):
    links = K.graph_links(relations(spark, sf))
    chosen = links.groupBy("book").agg(F.min("a").alias("node"))
    return K.neighbourhood(links, chosen)


def a13(spark, sf):
    c = K.merge_characters(characters(spark, sf)).where("importance <> 'low'")
    order = F.element_at(F.create_map(F.lit("high"), F.lit(1), F.lit("medium"), F.lit(2)), F.col("importance"))
    names = F.array_join(F.array_sort(F.collect_list(F.trim("name"))), ",")
    return c.groupBy("book", order.alias("place")).agg(names.alias("names"))


def g04(spark, sf):
    n = table(spark, sf, "nation").select(F.lit(1).alias("book"), F.col("n_name").alias("name"), F.concat(F.lit("NATION_"), F.floor((F.col("n_nationkey") - 1) / 3).cast("string")).alias("parent_name"))
    return K.place_rows(n).select("name", "depth", "path", "has_children")


def j14(spark, sf):
    """Sources x keywords x pages as requests; the keywords are a benchmark's first words, few by nature."""
    words = table(spark, sf, "benchmark").select("item_id", F.element_at(F.split("text", " "), 1).alias("keyword"))
    rule = F.lit('/search?q={{key}}&p=<1,2,last> , {"method":"GET"}')
    url, options = U.split_options(rule)
    paged = words.withColumn("page", F.explode(F.array(F.lit(1), F.lit(5))))
    filled = U.page_choice(U.fill_placeholders(url, U.encode_component(F.col("keyword")), F.col("page")), F.col("page"))
    made = paged.select("item_id", "page", filled.alias("filled"), F.get_json_object(options, "$.method").alias("method"))  # once for all sources
    sources = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("http://src"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("home"))
    rows = sources.repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey").crossJoin(F.broadcast(made))
    return rows.select("s_suppkey", "item_id", "page", F.concat("home", "filled").alias("url"), "method")


def j02(spark, sf):
    """Pages to shelf books by the longest prefix rule: same host, and one path begins with the other; first on the shelf."""
    p = table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"), F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1), "[0-9]+$", "").alias("path"))
    shelf = p.groupBy("host").agg(F.min(F.struct("page_id", "path")).alias("b")).select("host", F.col("b.page_id").alias("place"), F.col("b.path").alias("book_path"))
    hit = p.join(shelf, "host").where(F.col("path").startswith(F.col("book_path")) | F.col("book_path").startswith(F.col("path")))
    return hit.groupBy("page_id").agg(F.min("place").alias("book"))


QUERIES = {"a08_merge_characters": a08, "a09_merge_relations": a09, "a13_note_groups": a13, "a14_degrees": a14, "g03_neighbourhood": g03, "g04_place_tree": g04, "j14_frontier": j14, "j02_chapter_book": j02}

_C = """WITH c AS (SELECT p_partkey % 50 AS book, p_partkey AS ord, p_brand AS name, p_type, CASE WHEN p_size % 3 <> 0 THEN 's' || p_size END AS status, p_name AS description, p_size % 3 AS rank FROM part),
 m AS (SELECT book, lower(regexp_replace(name, '\\s+', '', 'g')) AS key, arg_min(name, ord) AS name, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS aliases, arg_max(status, ord) FILTER (status IS NOT NULL) AS status,
  arg_max(description, (length(description), -ord)) AS description, CASE max(rank) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS importance FROM c GROUP BY 1, 2)"""
_R = """WITH r AS (SELECT l_orderkey % 20 AS book, 'n' || (l_partkey % 30) AS s, 'n' || (l_suppkey % 30) AS t, l_returnflag AS relation FROM lineitem),
 k AS (SELECT DISTINCT book, least(s, t) AS a, greatest(s, t) AS b FROM r WHERE s <> t)"""
SQL = {
    "a08_merge_characters": _C + " SELECT * FROM m",
    "a09_merge_relations": _R + " SELECT DISTINCT book, least(s, t) AS x, greatest(s, t) AS y, relation FROM r WHERE s <> t",
    "a13_note_groups": _C + " SELECT book, CASE importance WHEN 'high' THEN 1 ELSE 2 END AS place, array_to_string(list_sort(list(name)), ',') AS names FROM m WHERE importance <> 'low' GROUP BY 1, 2",
    "a14_degrees": _R + " SELECT book, node, count(*) AS degree FROM (SELECT book, a AS node FROM k UNION ALL SELECT book, b FROM k) x GROUP BY 1, 2",
    "g03_neighbourhood": _R + ", c AS (SELECT book, min(a) AS node FROM k GROUP BY 1) SELECT DISTINCT book, node, other FROM (SELECT book, a AS node, b AS other FROM k UNION ALL SELECT book, b, a FROM k) x JOIN c USING (book, node)",
    "g04_place_tree": """WITH RECURSIVE n AS (SELECT n_name AS name, 'NATION_' || CAST(floor((n_nationkey - 1) / 3) AS INT) AS parent FROM nation),
 t AS (SELECT name, 0 AS depth, name AS path FROM n WHERE parent NOT IN (SELECT name FROM n) UNION ALL SELECT n.name, depth + 1, path || '/' || n.name FROM n JOIN t ON n.parent = t.name)
 SELECT name, depth, path, name IN (SELECT parent FROM n) AS has_children FROM t""",
    "j14_frontier": """SELECT s_suppkey, item_id, page, 'http://src' || s_suppkey || '.example.com/search?q=' || url_encode(string_split(text, ' ')[1]) || '&p=' || CASE page WHEN 1 THEN '1' ELSE 'last' END AS url, 'GET' AS method
 FROM supplier, benchmark, (VALUES (1), (5)) v(page)""",
    "j02_chapter_book": """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '[0-9]+$', '') AS path FROM pages),
 b AS (SELECT host, min((page_id, path)) AS b FROM p GROUP BY 1) SELECT page_id, min(b[1]) AS book FROM p JOIN b USING (host) WHERE starts_with(path, b[2]) OR starts_with(b[2], path) GROUP BY 1""",
}
