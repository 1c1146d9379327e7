"""Queries over shelves (orders, customer) and progress (events), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio_spark.operators import shelf as S

from .listings import table


def shelf(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("book_url"), F.concat(F.lit("book "), (F.col("o_orderkey") % 500).cast("string")).alias("name"), F.concat(F.lit("author "), (F.col("o_custkey") % 20).cast("string")).alias("author"),
        (F.col("o_custkey") % 8).alias("group"), (F.col("o_orderstatus") == "F").alias("local"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("kind"), (F.col("o_totalprice") / 1000).cast("int").alias("total"), (F.col("o_custkey") % 300).cast("int").alias("current"),
    )


S_ = """WITH s AS (SELECT '/o/' || o_orderkey AS book_url, 'book ' || (o_orderkey % 500) AS name, 'author ' || (o_custkey % 20) AS author, o_custkey % 8 AS "group", o_orderstatus = 'F' AS local,
  o_orderkey AS place, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS kind, CAST(trunc(o_totalprice / 1000) AS INT) AS total, CAST(o_custkey % 300 AS INT) AS current FROM orders)"""


def events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


E_ = "WITH e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def p06(spark, sf):
    s = shelf(spark, sf)
    return s.select("book_url", S.in_group(F.col("group"), -1).alias("all_"), S.in_group(F.col("group"), 0).alias("none_"), S.in_group(F.col("group"), 4).alias("four_"))


def o03(spark, sf):
    s = shelf(spark, sf)
    return s.select("book_url", S.set_bit(F.col("group"), 2, F.col("local")).alias("group_after"))


def a16(spark, sf):
    return shelf(spark, sf).select("book_url", S.unread(F.col("total"), F.col("current")).alias("unread"))


def p09(spark, sf):
    origin = F.when(F.col("local"), " local-txt ").otherwise("http://o/")
    return shelf(spark, sf).where(~S.is_local(origin, F.col("book_url")) & F.col("book_url").startswith("/o/1")).select("book_url")


def p07(spark, sf):
    s = shelf(spark, sf)
    return s.where(S.recent_matches(F.lit("book"), "book", " Author 7", "name", "author", "book_url", "kind")).select("book_url", "name")


def p10(spark, sf):
    marks = events(spark, sf).select(F.concat(F.lit("book "), (F.col("event_id") % 500).cast("string")).alias("name"), F.concat(F.lit("author "), (F.col("user_id") % 20).cast("string")).alias("author")).distinct()
    return shelf(spark, sf).join(marks, ["name", "author"], "left_semi").select("book_url")


def j06(spark, sf):
    s = shelf(spark, sf)
    return S.delete_matching(s, s.where("place % 97 = 0")).select("book_url", "name", "author", "local")


def j07(spark, sf):
    s = shelf(spark, sf).select("book_url", "name", "kind", "total")
    new = s.where("total % 5 = 0").select("book_url", F.upper("name").alias("name"), F.lit(None).cast("string").alias("kind"), (F.col("total") + 1).alias("total")).unionByName(s.where("total % 7 = 0 and total % 5 > 0").select(F.concat("book_url", F.lit("x")).alias("book_url"), "name", "kind", "total"))
    return S.upsert(s, new, ["book_url"], keep=("kind",))


def o02(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"), F.col("s_suppkey").alias("place"))
    new = s.where("place % 10 = 3").select("name", F.lit(0.0).alias("value"), F.col("place")).unionByName(s.where("place % 50 = 1").select(F.concat("name", F.lit("+")).alias("name"), "value", "place"))
    return S.upsert_list(s, new, ["name"])


def j09(spark, sf):
    s = shelf(spark, sf)
    other = table(spark, sf, "customer").select((F.col("c_custkey") % 300).cast("int").alias("current"), F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("new_url")).groupBy("current").agg(F.min("new_url").alias("new_url"))
    return s.join(other, "current", "left").select(F.coalesce("new_url", "book_url").alias("book_url"), "name", F.lit(None).cast("string").alias("toc_url"), "kind")


def j10(spark, sf):
    e = events(spark, sf)
    saves = e.select(F.concat(F.lit("/o/"), F.col("user_id").cast("string")).alias("book_url"), F.unix_micros("ts").alias("time"), F.col("k").alias("idx"))
    lines = table(spark, sf, "lineitem").withColumn("book_url", F.concat(F.lit("/o/"), F.col("l_orderkey").cast("string"))).join(saves.select("book_url").distinct(), "book_url", "left_semi")
    toc = lines.groupBy("book_url", F.expr("cast(l_partkey % 100 as int)").alias("idx")).agg(F.min(F.concat(F.lit("Chapter "), F.col("l_partkey").cast("string"))).alias("title"))
    return S.progress(shelf(spark, sf).select("book_url", "name"), toc, saves).select("book_url", "name", "time", "idx", "title", "total", "last_title")


def j05(spark, sf):
    cached = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.md5(F.col("l_orderkey").cast("string")).alias("book"), F.md5(F.col("l_linenumber").cast("string")).alias("chapter"))
    toc = table(spark, sf, "lineitem").select("l_orderkey", F.md5(F.col("l_orderkey").cast("string")).alias("book"), F.md5(F.col("l_linenumber").cast("string")).alias("chapter")).distinct()
    counts = toc.join(cached, ["book", "chapter"], "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(F.coalesce("n", F.lit(0))).alias("cached"))


def j12(spark, sf):
    server = table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("server"))
    local = table(spark, sf, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("local"))
    s = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select("o_orderkey").join(server, "o_orderkey", "left").join(local, "o_orderkey", "left")
    return s.select("o_orderkey", F.coalesce("server", F.lit(0)).alias("server"), F.coalesce("local", F.lit(0)).alias("local"))


def a15(spark, sf):
    e = events(spark, sf)
    return e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "view", F.floor("value")).otherwise(0)).alias("seconds"), F.countDistinct(F.when(F.col("event_type") == "click", F.col("k"))).alias("opened"), F.countDistinct("event_type", "k").alias("chapters"), F.countDistinct(F.when(F.col("k") >= 90, F.col("k"))).alias("completed"))


def a17(spark, sf):
    return events(spark, sf).groupBy("k").agg(F.count_if(F.col("event_type") == "purchase").alias("cached"), F.count_if(F.col("event_type").isin("view", "click")).alias("success"), F.count_if(F.col("event_type") == "error").alias("failed"))


def a19(spark, sf):
    r = table(spark, sf, "region")
    top = r.agg((F.max("r_regionkey") + 1).alias("next_id"))
    return r.crossJoin(F.broadcast(top)).select("r_name", F.when(F.col("r_regionkey") == 0, F.col("next_id")).otherwise(F.col("r_regionkey")).cast("long").alias("group_id"))


def w06(spark, sf):
    e = events(spark, sf).withColumn("feed", F.col("event_type") == "signup")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    live = e.where(~F.col("feed") | (F.col("ts") >= now - F.expr("interval 7 days")))
    last = S.latest_per_key(live.select("event_type", "k", "ts", "event_id"), ["event_type", "k"], "ts", "event_id")
    return last.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_type", "k", "event_id")


def w08(spark, sf):
    return S.neighbours(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


def w09(spark, sf):
    return S.move_to_front(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", F.col("s_suppkey") % 17 == 5).select("s_suppkey", F.col("new_place").cast("long").alias("new_place"))


def w09_moves(spark, sf):
    """Two tables' rows after one has gone before and one behind another."""
    rows = lambda t, k: table(spark, sf, t).select(F.lit(t).alias("t"), F.col(k).cast("string").alias("k"), F.col(k).alias("place"))
    before = S.move_row(rows("supplier", "s_suppkey"), "place", "k", "9", "3")
    after = S.move_row(rows("customer", "c_custkey"), "place", "k", "2", "11", after=True)
    return before.unionByName(after).select("t", "k", "new_place")


def w10(spark, sf):
    e = events(spark, sf)
    key = F.concat_ws("::", F.col("user_id").cast("string"), "event_type", F.when(F.col("k") % 3 > 0, F.concat(F.lit("/c/"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("index:"), F.col("k").cast("string"))))
    return e.select(key.alias("read_key")).distinct()


def w07(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    start = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("at"))
    return c.join(start, "conv_id", "left").where((F.col("turn") >= F.coalesce("at", F.lit(0))) & (F.col("turn") < F.coalesce("at", F.lit(0)) + 3)).select("conv_id", "turn")


def st7(spark, sf):
    e = events(spark, sf).select("event_id", "ts", F.col("event_type").alias("source"))
    return S.request_rate(e, 600, 2).select("event_id", "in_window", "over")


def p16(spark, sf):
    done = events(spark, sf).where("k < 50").groupBy("user_id").agg(F.max("k").alias("processed"))
    return events(spark, sf).join(done, "user_id", "left").where(F.coalesce(F.col("k") > F.col("processed"), F.lit(True))).select("event_id", "k")


def p17(spark, sf):
    o = table(spark, sf, "orders").withColumn("local", F.col("o_orderstatus") == "F")
    n = o.groupBy("o_custkey").agg(F.count_if("local").alias("n_local"))
    limit = F.col("o_custkey") % 4
    return o.join(n, "o_custkey").select("o_orderkey", ((limit > 0) & (F.col("n_local") > limit) & ~F.col("local")).alias("exceeded"))


def j15(spark, sf):
    gone = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(gone, "s_nationkey", "left_anti").select("s_suppkey", "s_nationkey")


def j16(spark, sf):
    wanted = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, sf, "supplier").join(wanted, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


QUERIES = {
    "p06_group_filter": p06, "p07_recent_filter": p07, "p09_remote_books": p09, "p10_bookmarks": p10, "p16_incremental_gate": p16, "p17_quota": p17, "o02_list_upsert": o02, "o03_group_bits": o03,
    "j05_cached_chapters": j05, "j06_delete_matching": j06, "j07_shelf_upsert": j07, "j09_switch_source": j09, "j10_progress": j10, "j12_cache_library": j12, "j15_delete_by_url": j15, "j16_requested_sources": j16,
    "a15_reading_statistics": a15, "a16_unread": a16, "a17_caching_counters": a17, "a19_next_id": a19, "w06_recent": w06, "w07_caching_slice": w07, "w08_neighbours": w08, "w09_move_to_front": w09, "w09_move_rows": w09_moves, "w10_read_history": w10, "st7_request_rate": st7,
}

SQL = {
    "p06_group_filter": S_ + ' SELECT book_url, true AS all_, "group" = 0 AS none_, ("group" & 4) <> 0 AS four_ FROM s',
    "p07_recent_filter": S_ + " SELECT book_url, name FROM s WHERE contains(lower(concat_ws(' ', name, author, book_url, coalesce(kind, ''))), 'author 7')",
    "p09_remote_books": S_ + " SELECT book_url FROM s WHERE NOT local AND starts_with(book_url, '/o/1')",
    "p10_bookmarks": S_ + " SELECT book_url FROM s WHERE (name, author) IN (SELECT ('book ' || (event_id % 500), 'author ' || (user_id % 20)) FROM events)",
    "p16_incremental_gate": E_ + ", d AS (SELECT user_id, max(k) AS processed FROM e WHERE k < 50 GROUP BY 1) SELECT event_id, k FROM e LEFT JOIN d USING (user_id) WHERE coalesce(k > processed, true)",
    "p17_quota": "WITH n AS (SELECT o_custkey, count_if(o_orderstatus = 'F') AS n FROM orders GROUP BY 1) SELECT o_orderkey, o_custkey % 4 > 0 AND n > o_custkey % 4 AND o_orderstatus <> 'F' AS exceeded FROM orders JOIN n USING (o_custkey)",
    "o02_list_upsert": """WITH s AS (SELECT s_name AS name, s_acctbal AS value, s_suppkey AS place FROM supplier)
 SELECT name, CASE WHEN place % 10 = 3 THEN 0 ELSE value END AS value, place FROM s UNION ALL SELECT name || '+', value, place + (SELECT max(place) FROM s) FROM s WHERE place % 50 = 1""",
    "o03_group_bits": S_ + ' SELECT book_url, CASE WHEN local THEN "group" | 2 ELSE "group" & ~2 END AS group_after FROM s',
    "j05_cached_chapters": """WITH n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1)
 SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE coalesce(n, 0) END AS cached FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""",
    "j06_delete_matching": S_ + """, g AS (SELECT * FROM s WHERE place % 97 = 0)
 SELECT book_url, name, author, local FROM s WHERE book_url NOT IN (SELECT book_url FROM g) AND (local OR (name, author) NOT IN (SELECT (name, author) FROM g WHERE NOT local))""",
    "j07_shelf_upsert": S_ + """ SELECT book_url, CASE WHEN total % 5 = 0 THEN upper(name) ELSE name END AS name, kind, CASE WHEN total % 5 = 0 THEN total + 1 ELSE total END AS total FROM s
 UNION ALL SELECT book_url || 'x', name, kind, total FROM s WHERE total % 7 = 0 AND total % 5 > 0""",
    "j09_switch_source": S_ + ", o AS (SELECT CAST(c_custkey % 300 AS INT) AS current, min('/c/' || c_custkey) AS new_url FROM customer GROUP BY 1) SELECT coalesce(new_url, book_url) AS book_url, name, CAST(NULL AS VARCHAR) AS toc_url, kind FROM s LEFT JOIN o USING (current)",
    "j10_progress": E_ + """, v AS (SELECT '/o/' || user_id AS book_url, max((epoch_us(ts), k)) AS m FROM e GROUP BY 1),
 t AS (SELECT '/o/' || l_orderkey AS book_url, CAST(l_partkey % 100 AS INT) AS idx, min('Chapter ' || l_partkey) AS title FROM lineitem GROUP BY 1, 2),
 z AS (SELECT book_url, count(*) AS total, arg_max(title, idx) AS last_title FROM t GROUP BY 1)
 SELECT '/o/' || o_orderkey AS book_url, 'book ' || (o_orderkey % 500) AS name, m[1] AS time, m[2] AS idx, title, total, last_title
 FROM orders JOIN v ON v.book_url = '/o/' || o_orderkey LEFT JOIN t ON t.book_url = v.book_url AND t.idx = m[2] LEFT JOIN z ON z.book_url = v.book_url""",
    "j12_cache_library": """SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS server, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AS local
 FROM orders WHERE o_orderstatus <> 'F'""",
    "j15_delete_by_url": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "j16_requested_sources": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "a15_reading_statistics": E_ + """ SELECT user_id, CAST(sum(CASE WHEN event_type = 'view' THEN floor(value) ELSE 0 END) AS BIGINT) AS seconds, count(DISTINCT k) FILTER (event_type = 'click') AS opened,
 count(DISTINCT (event_type, k)) AS chapters, count(DISTINCT k) FILTER (k >= 90) AS completed FROM e GROUP BY 1""",
    "a16_unread": S_ + " SELECT book_url, greatest(0, total - 1 - current) AS unread FROM s",
    "a17_caching_counters": E_ + " SELECT k, count_if(event_type = 'purchase') AS cached, count_if(event_type IN ('view', 'click')) AS success, count_if(event_type = 'error') AS failed FROM e GROUP BY 1",
    "a19_next_id": "SELECT r_name, CAST(CASE WHEN r_regionkey = 0 THEN (SELECT max(r_regionkey) + 1 FROM region) ELSE r_regionkey END AS BIGINT) AS group_id FROM region",
    "w06_recent": E_ + """, l AS (SELECT * FROM e WHERE event_type <> 'signup' OR ts >= TIMESTAMP '2024-01-24 00:00:00'), m AS (SELECT event_type, k, max((ts, event_id)) AS b FROM l GROUP BY 1, 2)
 SELECT event_type, k, b[2] AS event_id FROM m ORDER BY b DESC LIMIT 100""",
    "w07_caching_slice": """WITH a AS (SELECT conv_id, min(turn) AS first_ FROM conversations WHERE role = 'assistant' GROUP BY 1)
 SELECT c.conv_id, turn FROM conversations c LEFT JOIN a USING (conv_id) WHERE turn >= coalesce(first_, 0) AND turn < coalesce(first_, 0) + 3""",
    "w08_neighbours": "SELECT conv_id, turn, lead(turn, 1) OVER w AS next_1, lead(turn, 2) OVER w AS next_2, lag(turn, 1) OVER w AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "w09_move_to_front": "SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 17 = 5 THEN 0 ELSE 1 END, s_suppkey) AS new_place FROM supplier",
    "w09_move_rows": """SELECT 'supplier' AS t, CAST(s_suppkey AS VARCHAR) AS k, row_number() OVER (ORDER BY CASE WHEN s_suppkey = 9 THEN 2.5 ELSE s_suppkey END) AS new_place FROM supplier
 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), row_number() OVER (ORDER BY CASE WHEN c_custkey = 2 THEN 11.5 ELSE c_custkey END) FROM customer""",
    "w10_read_history": E_ + " SELECT DISTINCT user_id || '::' || event_type || '::' || CASE WHEN k % 3 > 0 THEN '/c/' || k ELSE 'index:' || k END AS read_key FROM e",
    "st7_request_rate": """SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 2 AS over FROM events
 WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW)""",
}
