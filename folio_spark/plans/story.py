"""Queries of chapters, knowledge tables, shelves and scopes with every case of their rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio_spark.functions import text as X
from folio_spark.operators import chapters as C
from folio_spark.operators import knowledge as K
from folio_spark.operators import merge
from folio_spark.operators import shelf as S
from folio_spark.plans import listings as base
from folio_spark.plans.listings import C as _CATALOG
from folio_spark.plans.listings import L, listings, table
from folio_spark.sources import catalogs

#: Titles of all kinds, one an event by its number.
TITLES = [
    "番外 一", "外传", "新书预告", "新番外", "公告", "通知", "说明", "完本感言", "请假一天", "断更", "恢复更新", "更新时间", "求票", "求月票", "推荐票", "打赏名单", "推书", "书友群", "群号", "活动", "抽奖活动", "实体书", "出版", "完本", "上架",
    "序章", "楔子", "引子", "序", "前言", "（序章）", "序章 一", "推荐信", "第1章 推荐", "加更", "", "  ", "第三章", "Chapter 4", "【公 告】",
]
ORDINALS = [("第十二集", 12), ("第3部", 3), ("第二十一卷", 21), ("第7篇", 7), ("第123456章", None), ("第99999章", 99999), ("第一百零五回", 105), ("12 x", 12), ("123456", None), ("Chapter 8", 8), ("第五话", 5), ("x", None)]


def _nth(values: list, n) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def p13(spark, sf):
    t = table(spark, sf, "events").select("event_id", _nth(TITLES, F.col("event_id")).alias("title"))
    return t.where(C.is_story(F.col("title")))


def w04(spark, sf):
    return table(spark, sf, "events").select("event_id", X.chapter_ordinal(_nth([t for t, _ in ORDINALS], F.col("event_id"))).alias("ordinal"))


def w03(spark, sf):
    k = F.col("s_suppkey").cast("string")
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("\n before "), k, F.lit("\n\n  第1章 开始\r\nbody "), k, F.lit("\n\nmore\r\n\n第二回\n卷三：x\n第四章没有。\n"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("第1章\n"), k)).otherwise(F.concat(F.lit(" plain "), k, F.lit("\n")))
    return C.text_chapters(table(spark, sf, "supplier").select(F.concat(F.lit("local-txt:"), k).alias("book_url"), text.alias("text")))


def a01_five(spark, sf):
    rows = listings(spark, sf)
    extra = {"cover_url": F.when(F.col("source_ord") % 2 == 0, F.concat(F.lit("/c/"), "book_url")), "intro": F.when(F.col("source_ord") % 3 == 0, F.col("origin")), "last_chapter": F.when(F.col("item_ix") % 5 == 0, F.lit("last")), "update_time": F.lit(None).cast("string")}
    out = merge.merge_listings(rows.withColumns(extra), merge.FILLED, as_array=True)
    return out.orderBy("name", "merge_key").select("merge_key", "name", "book_url", *merge.FILLED, F.size("origins").alias("n_origins"), F.get("origins", F.lit(0)).alias("first_origin"))


def people(spark, sf):
    p = table(spark, sf, "part")
    n = F.col("p_partkey")
    return p.select((n % 40).alias("book"), n.alias("ord"), F.concat(_nth(["Ann·B", " ann•b ", "Cy", "D"], F.floor(n / 40)), F.lit("")).alias("name"), F.array(F.col("p_type")).alias("aliases"), F.when(n % 3 > 0, F.concat(F.lit("s"), n.cast("string"))).alias("status"), F.when(n % 4 > 0, F.col("p_brand")).alias("faction"), F.when(n % 5 > 0, F.col("p_type")).alias("location"), F.concat(F.lit("c"), n.cast("string")).alias("last_seen"), F.col("p_name").alias("description"), _nth(["low", "medium", "高", None, "核心"], n).alias("importance"))


def a08_all(spark, sf):
    return K.merge_characters(people(spark, sf)).select("book", "key", F.trim("name").alias("name"), F.size("aliases").alias("n_aliases"), "status", "faction", "location", "last_seen", "importance")


def a12(spark, sf):
    return K.merge_characters(people(spark, sf), shown=True).select("book", "key", F.trim("name").alias("name"), "status", "faction", "location", "last_seen")


def o01(spark, sf):
    """Stored characters, then new ones, merged as one list; both number their rows from the start."""
    p = people(spark, sf)
    old, new = p.where("ord % 2 = 0"), p.where("ord % 2 = 1")
    return K.merge_characters(K.in_order(old, new)).select("book", "key", F.trim("name").alias("name"), "status", "last_seen")


def ties(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select((F.col("l_orderkey") % 20).alias("book"), n.alias("ord"), F.concat(F.lit("n"), (F.col("l_partkey") % 9).cast("string")).alias("source"), F.concat(F.lit("N"), (F.col("l_suppkey") % 9).cast("string")).alias("target"), _nth(["认识", "朋友", "", "路过"], n).alias("relation"), _nth(["", "met once"], n).alias("status"), F.when(n % 6 == 0, "they travelled for a long time together").alias("description"), _nth([None, "medium", "minor", ""], F.floor(n / 4)).alias("importance"))


def a12_relations(spark, sf):
    return K.merge_relations(ties(spark, sf), shown=True).select("book", "x", "y", "relation", "status", "description", "importance")


def p15(spark, sf):
    r = ties(spark, sf)
    return r.select("ord", K.says_little(F.col("relation"), F.coalesce(F.nullif("description", F.lit("")), "status"), F.col("importance")).alias("little"), K.is_low(F.col("importance")).alias("low"))


NOTES = [
    ("宗门", "设定内容", "势力制度"), ("本章剧情", "x", "基础设定"), ("名", "本章讲了一些事", "基础设定"), ("名", "y", "剧情进展"), ("名", "yy", None), (" ", "z", "技术/魔法"), ("旅程", "随后他们回到城里，看到了第3章里的人，接着告诉他很多很多的事情，" * 3, "社会文化"),
    ("战事", "担心搜查，登上高处，指出并加入了一场很长的战斗，" * 5, "别的"), ("战事", "担心搜查，登上高处，指出并加入了一场很长的战斗，" * 5, "基础规则"), ("法术", "short", "技术/魔法"), ("法 术", "a longer text", "技术/魔法"), ("事", "t", "当前事件"), ("怪", "q", "奇谈"),
]
RECAP = [False, True, True, True, False, False, True, True, False, False, False, True, False]


def notes(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select((n % 7).alias("book"), n.alias("ord"), *(_nth([v[i] for v in NOTES], n).alias(c) for i, c in enumerate(("title", "content", "category"))), F.when(n % 11 == 0, "background").alias("importance"))


def p15_recaps(spark, sf):
    return notes(spark, sf).select("ord", K.is_recap(F.col("title"), F.col("content"), F.coalesce("category", F.lit(""))).alias("recap"))


def a11(spark, sf):
    return K.merge_notes(notes(spark, sf)).select("book", "category", "title", F.md5("content").alias("content_md5"))


def a13(spark, sf):
    return K.group_notes(notes(spark, sf)).select("book", "place", "category", "title")


def spots(spark, sf):
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") % 20).alias("book"), n.alias("ord"), F.concat(F.lit("p"), (F.col("l_partkey") % 6).cast("string")).alias("name"), _nth(["城市", "", "房间", "王国", "酒馆", "村", "世界", "营地"], n).alias("kind"), _nth(["p1", "p2", None, "P3"], F.floor(n / 7)).alias("parent_name"), _nth(["open", None], n).alias("status"), F.col("l_returnflag").alias("description"), F.concat(F.lit("c"), n.cast("string")).alias("first_seen"), F.array(F.concat(F.lit("n"), (F.col("l_suppkey") % 9).cast("string"))).alias("characters"), _nth(["high", "中", "low", None], F.floor(n / 3)).alias("importance"))


def a10(spark, sf):
    return K.merge_places(spots(spark, sf)).select("book", "key", "kind", "parent_name", "status", "first_seen", F.array_join("characters", ",").alias("characters"))


def t10(spark, sf):
    return K.places_in_order(K.merge_places(spots(spark, sf))).select("book", "place", "name")


def u23(spark, sf):
    return spots(spark, sf).select("ord", K.place_level(F.col("kind")).alias("level"), K.place_rank(F.col("kind")).alias("band"), X.importance_rank(F.col("importance")).alias("importance"))


def graph(spark, sf):
    return K.relationship_graph(people(spark, sf).where("book < 20").withColumn("name", F.trim("name")), ties(spark, sf), spots(spark, sf))


def a14_nodes(spark, sf):
    return graph(spark, sf)[0].select("book", "id", "kind", "detail")


def a14_links(spark, sf):
    return graph(spark, sf)[1]


def t09(spark, sf):
    nodes, links = graph(spark, sf)
    return K.nodes_in_order(nodes, links).select("book", "place", "id", "degree")


def p14(spark, sf):
    return people(spark, sf).where(K.matches_search("Large  s1", "name", "aliases", "location", "status")).select("ord")


def u22(spark, sf):
    s = K.place_signature(K.merge_places(spots(spark, sf)).select("book", "name", "parent_name", "kind", "status"))
    return s.select("book", F.md5("signature").alias("signature_md5"))


def j13(spark, sf):
    """Nations as places: regions hold them by a given parent of a higher level, others by what their texts name."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    low = n.select(F.col("r_regionkey").alias("book"), F.col("n_name").alias("name"), _nth(["城市", "酒馆", "房间"], k).alias("kind"), F.when(k % 2 == 0, F.col("r_name")).alias("parent_name"), F.when(k % 3 == 0, F.concat(F.lit("in "), F.lower("r_name"))).alias("description"))
    top = table(spark, sf, "region").select(F.col("r_regionkey").alias("book"), F.col("r_name").alias("name"), F.lit("王国").alias("kind"), F.lit(None).cast("string").alias("parent_name"), F.lit("").alias("description"))
    return K.infer_parents(low.unionByName(top))


SUMMARIES = ["", "本章：x", "第3章 初见：他来了", "故事继续", "z" * 1300, "  "]


def u21(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.md5(X.next_summary(_nth(["old", None, ""], F.floor(n / 6)), _nth(SUMMARIES, n))).alias("summary_md5"))


def u25(spark, sf):
    names = ["/a/My Book.txt", "b.tar.txt", "", "/x/ ", "名字", ".txt", "dir/sub/"]
    c = _nth(names, F.col("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", X.safe_file_name(c).alias("file"), X.title_from_file_name(c).alias("title"))


def p12(spark, sf):
    return table(spark, sf, "events").select("event_id", X.is_truthy(_nth(["", "0", "False", "null", "NONE", "no", "off", " Off ", "1", "vip", "not", None], F.col("event_id"))).alias("flag"))


def u14(spark, sf):
    """Rules with scopes, a disabled one, and an order of their own."""
    rows = [(3, "the", "THE", False, "", True), (1, "[%$*&#]+", "", True, "*", True), (2, "a", "@", False, "source:src1", True), (5, "e", "3", False, "book:7", True), (4, "^The", "- The", True, "de", True), (6, "o", "0", False, None, False), (7, "i", "!", False, "en;/d/8", True)]
    rules = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(a).alias("pattern"), F.lit(b).alias("replacement"), F.lit(x).alias("is_regex"), F.lit(s).cast("string").alias("scope"), F.lit(e).alias("enabled")) for p, a, b, x, s, e in rows))
    url = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"))
    held = X.ordered_rules(rules, F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), url)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(held, lambda r: r["place"].cast("string")), ",").alias("rules"), F.md5(X.replace_rules(F.col("text"), held)).alias("text_md5"))


def books(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("http://h"), (k % 5).cast("string"), F.lit("/b/"), k.cast("string")).alias("book_url"), F.when(F.col("o_orderstatus") == "F", "local-txt").otherwise("web").alias("origin"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.concat(F.lit("a"), (F.col("o_custkey") % 20).cast("string")).alias("author"), k.alias("place"), F.lit(None).cast("string").alias("toc_url"), F.when(k % 2 == 0, F.lit("kind")).alias("kind"), F.when(k % 3 == 0, k).alias("group"))


def j07(spark, sf):
    """Saves: by URL, by name and author at another URL, of a local book, twice in one go, and of a new book."""
    b = books(spark, sf)
    k = F.col("place")
    null = F.lit(None).cast("long").alias("group")
    by_url = b.where(k % 10 == 1).select("book_url", "origin", F.concat("name", F.lit("+")).alias("name"), "author", "place", "toc_url", F.lit("new").alias("kind"), null)
    by_name = b.where(k % 10 == 2).select(F.concat("book_url", F.lit("x")).alias("book_url"), F.lit("web").alias("origin"), "name", "author", "place", "toc_url", F.lit("moved").alias("kind"), F.lit(-1).cast("long").alias("group"))
    twice = by_url.where(k % 20 == 1).withColumn("kind", F.lit("last")).withColumn("place", k + 1_000_000_000)
    fresh = b.where(k % 10 == 3).select(F.concat("book_url", F.lit("/new")).alias("book_url"), "origin", F.concat("name", F.lit("*")).alias("name"), "author", "place", "toc_url", "kind", "group")
    return S.save_books(b, by_url.unionByName(by_name).unionByName(twice).unionByName(fresh), ("group",)).select("book_url", "name", "kind", "group")


def j09(spark, sf):
    b = books(spark, sf).where("origin = 'web'").select("book_url", "origin", "name", "author", "toc_url", "kind")
    url = F.concat("book_url", F.lit("/s"))
    some = b.where(F.length("name") % 2 == 0)
    choice = some.select("book_url", url.alias("new_url"), F.lit("other").alias("new_origin"), F.when(F.length("author") == 2, F.lit("A")).alias("author"), F.lit("").alias("kind"))
    detail = some.select(url.alias("book_url"), F.lit("D").alias("author"), F.lit("detail").alias("kind"), F.lit("/toc").alias("toc_url"))
    return S.switch_source(b, choice, detail, ["author", "kind"])


def j02(spark, sf):
    """Pages to the first of many books of their host whose path begins theirs, or is begun by it."""
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("chapter_url"))
    shelf = p.select(F.regexp_replace("chapter_url", r"[0-9]+([?#].*)?$", "").alias("book_url"), F.col("page_id").alias("place"))
    return p.join(S.chapter_books(p.select("chapter_url").distinct(), shelf), "chapter_url").select("page_id", "place")


def p07(spark, sf):
    b = books(spark, sf)
    kind = F.when(F.col("place") % 4 == 0, "rss").when(F.col("place") % 4 == 1, "book")
    hit = [S.recent_matches(kind, w, " A1 ", "name", "author", "kind", "origin").alias(w) for w in ("all", "book", "rss")]
    return b.select("place", *hit)


def p09(spark, sf):
    o = F.when(F.col("place") % 3 == 0, " local-epub ").when(F.col("place") % 3 == 1, "web")
    url = F.when(F.col("place") % 5 == 0, F.concat(F.lit(" local-txt:"), F.col("place").cast("string"))).otherwise(F.col("book_url"))
    return books(spark, sf).select("place", S.is_local(o, url).alias("local"))


def p08(spark, sf):
    return table(spark, sf, "part").where(C.title_matches(F.col("p_name"), " 00001 ")).select("p_partkey", "p_name")


def p11(spark, sf):
    s = table(spark, sf, "supplier")
    groups = X.split_groups(F.concat(F.lit("g"), (F.col("s_nationkey") % 5).cast("string"), F.lit("， all，g"), (F.col("s_nationkey") % 3).cast("string")), "[,;，、]")
    on = F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 4 > 1)
    scopes = {"all_": ("all", ""), "group_": ("group", "g2"), "one_": ("source", "Supplier#000000002"), "nameless": ("group", "")}
    return s.select("s_suppkey", *(S.in_scope(k, v, groups, F.col("s_name"), on).alias(c) for c, (k, v) in scopes.items()))


def p05(spark, sf):
    n = F.col("s_suppkey")
    row = {"group": _nth([" g ", "", None], n), "enabled": _nth([None, True, False], n), "enabled_explore": _nth([True, False, None], n), "search_url": _nth(["", "/s", None], n), "rule_search": _nth(["{}", None], n), "explore_url": F.lit(None).cast("string"), "rule_explore": _nth([None, None, "{}"], n), "rule_book_info": _nth(["{}", None, "{}"], n), "rule_toc": _nth([None, "{}"], n), "rule_content": F.lit("{}"), "login_url": _nth(["  ", "/l", None], n), "cookie_jar": _nth([True, None], n)}
    o = merge.source_overview(row)
    return table(spark, sf, "supplier").select("s_suppkey", o.alias("o")).select("s_suppkey", "o.*")


def u18_sql() -> str:
    piece = "regexp_extract_all(regexp_replace(trim(text), '\\n+', chr(10), 'g'), '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$')"
    return f"""WITH RECURSIVE s AS (SELECT conv_id, turn, list_filter(list_transform({piece}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS l FROM conversations),
 u AS (SELECT conv_id, turn, unnest(l) AS s, unnest(range(len(l))) AS i FROM s),
 c AS (SELECT conv_id, turn, i, 0 AS k, '' AS piece, s AS rest FROM u WHERE length(s) > 70 UNION ALL
  SELECT conv_id, turn, i, k + 1, CASE WHEN length(rest) > 70 THEN trim(substring(rest, 1, at_)) ELSE rest END, CASE WHEN length(rest) > 70 THEN trim(substring(rest, at_ + 1)) ELSE '' END
   FROM (SELECT *, CASE WHEN length(regexp_extract(substring(rest, 1, 71), '(?s)^(.*)[，、, ]', 1)) > 0 THEN length(regexp_extract(substring(rest, 1, 71), '(?s)^(.*)[，、, ]', 1)) ELSE 70 END AS at_ FROM c WHERE rest <> '')),
 e AS (SELECT conv_id, turn, i, 0 AS k, s AS piece, false AS alone FROM u WHERE length(s) <= 70 UNION ALL SELECT conv_id, turn, i, k, piece, true FROM c WHERE k > 0 AND piece <> ''),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, k) AS p FROM e),
 g AS (SELECT conv_id, turn, p, piece, alone, piece AS body, 0 AS chunk FROM n WHERE p = 1 UNION ALL
  SELECT n.conv_id, n.turn, n.p, n.piece, n.alone, CASE WHEN joins THEN g.body || n.piece ELSE n.piece END, g.chunk + CASE WHEN joins THEN 0 ELSE 1 END
   FROM (SELECT g.*, n.p AS np, NOT g.alone AND NOT n.alone AND length(g.body) + length(n.piece) <= 70 AS joins FROM g JOIN n ON n.conv_id = g.conv_id AND n.turn = g.turn AND n.p = g.p + 1) g JOIN n ON n.conv_id = g.conv_id AND n.turn = g.turn AND n.p = g.np)
 SELECT conv_id, turn, chunk, arg_max(body, p) AS body FROM g GROUP BY 1, 2, 3"""


def marked(spark, sf):
    c = base.catalog(spark, sf)
    report = base.a03(spark, sf).join(c.select(F.concat(F.lit("src"), F.col("source_ord").cast("string")).alias("origin"), F.col("groups").alias("group")), "origin")
    return merge.marked_report(report, "group", F.lit(" "), F.when(F.length("source_name") % 2 == 0, "check"))


def a03_marked(spark, sf):
    return marked(spark, sf).orderBy("source_name").select("origin", "valid", "keyword", "group", "marked_invalid")


def a04_totals(spark, sf):
    """Batches of sources, their reports put together again."""
    parts = [marked(spark, sf).where(F.length("origin") % 2 == i) for i in (0, 1)]
    return merge.report_totals(parts[0].unionByName(parts[1]))


def t04_more(spark, sf):
    """Feed pages of 50: whether a type of events has more behind the first."""
    return table(spark, sf, "events").groupBy("event_type").agg((F.count("*") >= 50).alias("has_more"))


def t04_scope(spark, sf):
    """The second page of the feeds of a group: types of events with an r in their names."""
    e = table(spark, sf, "events").where("event_type like '%r%'").select("event_type", "event_id", (F.col("event_id") % 7).alias("at"))
    return S.feed_page(e, "event_type", [F.desc("at"), "event_id"], 2).select("event_type", "event_id", "place", "has_more")


def a12_places(spark, sf):
    return K.merge_places(spots(spark, sf), shown=True).select("book", "key", "kind", "parent_name", "status", "first_seen", F.array_join("characters", ",").alias("characters"))


def s05(spark, sf):
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    rows = p.select("page_id", "url", "html", F.when(n % 2 == 0, F.concat("url", F.lit("#moved"))).otherwise("").alias("final_url"), F.when(n % 5 == 0, 404).when(n % 5 == 1, 204).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"))
    return catalogs.page_rows(rows).select("page_id", "final_url", F.col("html").isNotNull().alias("has_text"), F.try_element_at("headers", F.lit("content-type")).alias("content_type"))


QUERIES = {
    "a03_marked_report": a03_marked, "a04_report_totals": a04_totals, "t04_has_more": t04_more, "s05_page_rows": s05,
    "p13_title_patterns": p13, "w04_all_units": w04, "w03_text_book": w03, "a01_five_fields": a01_five, "a08_all_fields": a08_all, "a12_shown_characters": a12, "a12_shown_places": a12_places, "t04_scope_page": t04_scope, "a12_shown_relations": a12_relations, "o01_increment": o01, "p15_low_value": p15, "p15_recaps": p15_recaps,
    "a11_merge_notes": a11, "a13_category_groups": a13, "a10_merge_places": a10, "t10_place_order": t10, "u23_levels": u23, "a14_nodes": a14_nodes, "a14_links": a14_links, "t09_node_order": t09, "p14_character_search": p14, "u22_place_signature": u22, "j13_place_parents": j13,
    "u21_summaries": u21, "u25_file_names": u25, "p12_truthiness": p12, "u14_scoped_order": u14, "j07_save_books": j07, "j09_switch_with_detail": j09, "j02_books_of_a_host": j02, "p07_recent_kinds": p07, "p09_local_books": p09, "p08_title_search": p08, "p11_feed_scope": p11, "p05_overview_flags": p05,
}

_KEY = "lower(regexp_replace(translate(trim({}), '·•・', '...'), '\\s+', '', 'g'))"
_LOW = "low|低|低重要性|不重要|路人|背景|minor|background|oneoff|一次性"
_RANK = "CASE WHEN regexp_matches(coalesce({0}, ''), 'high|高') THEN 3 WHEN regexp_matches(coalesce({0}, ''), 'medium|中') THEN 2 WHEN regexp_matches(coalesce({0}, ''), '" + _LOW + "') THEN 1 ELSE 0 END"
_P = f"""WITH c AS (SELECT p_partkey % 40 AS book, p_partkey AS ord, ['Ann·B', ' ann•b ', 'Cy', 'D'][p_partkey // 40 % 4 + 1] AS name, p_type, p_name AS description, CASE WHEN p_partkey % 3 > 0 THEN 's' || p_partkey END AS status, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS faction,
  CASE WHEN p_partkey % 5 > 0 THEN p_type END AS location, 'c' || p_partkey AS last_seen, ['low', 'medium', '高', NULL, '核心'][p_partkey % 5 + 1] AS importance FROM part), k AS (SELECT *, {_KEY.format("name")} AS key FROM c)"""
_TIES = f"""WITH r AS (SELECT l_orderkey % 20 AS book, l_orderkey * 10 + l_linenumber AS ord, 'n' || (l_partkey % 9) AS source, 'N' || (l_suppkey % 9) AS target, ['认识', '朋友', '', '路过'][(l_orderkey * 10 + l_linenumber) % 4 + 1] AS relation,
  ['', 'met once'][(l_orderkey * 10 + l_linenumber) % 2 + 1] AS status, CASE WHEN (l_orderkey * 10 + l_linenumber) % 6 = 0 THEN 'they travelled for a long time together' END AS description, [NULL, 'medium', 'minor', ''][(l_orderkey * 10 + l_linenumber) // 4 % 4 + 1] AS importance FROM lineitem),
 f AS (SELECT *, relation IN ('认识', '路过') AND coalesce(importance, '') <> 'medium' AND length(regexp_replace(coalesce(description, status), '\\s+', '', 'g')) < 18 AS little, coalesce(importance, '') = 'minor' AS low, least(lower(source), lower(target)) AS x, greatest(lower(source), lower(target)) AS y FROM r)"""
_NOTES = f"""WITH n AS (SELECT event_id % 7 AS book, event_id AS ord, {_list([v[0] for v in NOTES])}[event_id % {len(NOTES)} + 1] AS title, {_list([v[1] for v in NOTES])}[event_id % {len(NOTES)} + 1] AS content, coalesce({_list([v[2] for v in NOTES])}[event_id % {len(NOTES)} + 1], '基础设定') AS category,
  {_list([int(v) for v in RECAP])}[event_id % {len(NOTES)} + 1] = 1 AS recap, event_id % 11 = 0 AS low FROM events)"""
_SPOTS = """WITH s AS (SELECT l_orderkey % 20 AS book, n AS ord, 'p' || (l_partkey % 6) AS name, ['城市', '', '房间', '王国', '酒馆', '村', '世界', '营地'][n % 8 + 1] AS kind, ['p1', 'p2', NULL, 'P3'][n // 7 % 4 + 1] AS parent_raw, ['open', NULL][n % 2 + 1] AS status, l_returnflag AS description, 'c' || n AS first_seen,
  'n' || (l_suppkey % 9) AS who, ['high', '中', 'low', NULL][n // 3 % 4 + 1] AS importance FROM (SELECT *, l_orderkey * 10 + l_linenumber AS n FROM lineitem)),
 q AS (SELECT *, CASE WHEN lower(parent_raw) <> name THEN parent_raw END AS parent_name, CASE kind WHEN '城市' THEN 50 WHEN '房间' THEN 20 WHEN '王国' THEN 70 WHEN '酒馆' THEN 30 WHEN '村' THEN 40 WHEN '世界' THEN 90 ELSE 35 END AS level FROM s),
 m AS (SELECT book, name, arg_max(kind, ord) FILTER (kind <> '') AS kind, arg_max(parent_name, ord) FILTER (parent_name IS NOT NULL) AS parent_name, arg_max(status, ord) FILTER (status IS NOT NULL) AS status, arg_min(first_seen, ord) AS first_seen,
  array_to_string(list_sort(list(DISTINCT who)), ',') AS characters, arg_max(importance, (""" + _RANK.format("importance") + """, -ord)) AS importance FROM q GROUP BY 1, 2)"""
_BANDS = "CASE WHEN kind IN ('王国', '世界') THEN 4 WHEN kind = '城市' THEN 3 WHEN kind = '村' THEN 2 WHEN kind IN ('房间', '酒馆') THEN 0 ELSE 1 END"
_GRAPH = _TIES + ", " + _P.removeprefix("WITH ").replace(" k AS", " pk AS").replace("FROM c)", "FROM c WHERE book < 20)") + ", " + _SPOTS.removeprefix("WITH ").replace("WITH ", "") + """,
 named AS (SELECT book, trim(name) AS id, 'character' AS kind, coalesce(status, description) AS detail, (0, ord, 0) AS o FROM pk UNION ALL SELECT book, source, 'character', NULL, (1, ord, 1) FROM r UNION ALL SELECT book, target, 'character', NULL, (1, ord, 1) FROM r
  UNION ALL SELECT book, name, 'location', description, (2, ord, 2) FROM s UNION ALL SELECT book, who, 'character', NULL, (2, ord, 3) FROM s),
 nodes AS (SELECT book, id, arg_min(kind, (o, kind)) AS kind, min((o, kind, detail))[3] AS detail FROM named GROUP BY 1, 2),
 links AS (SELECT DISTINCT book, source, target, coalesce(nullif(relation, ''), nullif(status, ''), '关联') AS label FROM r WHERE source <> target UNION SELECT DISTINCT book, who, name, '位于' FROM s WHERE who <> name)"""
_BOOKS = """WITH b AS (SELECT 'http://h' || (o_orderkey % 5) || '/b/' || o_orderkey AS book_url, CASE WHEN o_orderstatus = 'F' THEN 'local-txt' ELSE 'web' END AS origin, 'n' || o_orderkey AS name, 'a' || (o_custkey % 20) AS author, o_orderkey AS place,
  CASE WHEN o_orderkey % 2 = 0 THEN 'kind' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS "group" FROM orders)"""
_STORY = [t for t in TITLES if t.strip() in ("序章", "楔子", "引子", "序", "前言", "（序章）", "序章 一", "推荐信", "第1章 推荐", "加更", "第三章", "Chapter 4")]

_MARKED = _CATALOG + ", " + L.removeprefix("WITH ") + """, v AS (SELECT 'src' || source_ord AS origin, source_name, names, groups, EXISTS (SELECT 1 FROM l WHERE l.source_ord = d.source_ord AND (kind = 'LARGE' OR author = 'Brand#7')) AS valid, list_contains(names, '失效') AS has FROM d)"""

SQL = {
    "a03_marked_report": _MARKED + """ SELECT origin, valid, CASE WHEN length(source_name) % 2 = 0 THEN 'check' ELSE '斗破苍穹' END AS keyword,
 CASE WHEN valid AND has THEN array_to_string(list_filter(names, lambda x: x <> '失效'), ',') WHEN NOT valid AND NOT has THEN array_to_string(list_append(names, '失效'), ',') ELSE groups END AS "group", NOT valid AND NOT has AS marked_invalid FROM v""",
    "a04_report_totals": _MARKED + " SELECT count(*) AS total, count_if(valid) AS valid, count_if(NOT valid) AS invalid, count_if(NOT valid AND NOT has) AS marked_invalid FROM v",
    "t04_scope_page": """WITH p AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 7 DESC, event_id) AS place FROM events WHERE event_type LIKE '%r%'), q AS (SELECT * FROM p WHERE place BETWEEN 51 AND 100)
 SELECT event_type, event_id, place, (SELECT max(n) >= 50 FROM (SELECT count(*) AS n FROM q GROUP BY event_type)) AS has_more FROM q""",
    "t04_has_more": "SELECT event_type, count(*) >= 50 AS has_more FROM events GROUP BY 1",
    "s05_page_rows": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '#moved' ELSE url END AS final_url, page_id % 5 <> 0 AS has_text, 'text/html' AS content_type FROM pages",
    "p13_title_patterns": f"SELECT event_id, {_list(TITLES)}[event_id % {len(TITLES)} + 1] AS title FROM events WHERE list_contains({_list(_STORY)}, {_list(TITLES)}[event_id % {len(TITLES)} + 1])",
    "w04_all_units": f"SELECT event_id, CAST({_list([n for _, n in ORDINALS])}[event_id % {len(ORDINALS)} + 1] AS INT) AS ordinal FROM events",
    "w03_text_book": """WITH k AS (SELECT s_suppkey AS n, CAST(s_suppkey AS VARCHAR) AS k, length(CAST(s_suppkey AS VARCHAR)) AS z FROM supplier),
 r AS (SELECT n, i, CASE i WHEN 0 THEN '序章' WHEN 1 THEN '第1章 开始' WHEN 2 THEN '第二回' ELSE '卷三：x' END AS title, CASE i WHEN 0 THEN chr(10) || ' before ' || k WHEN 1 THEN 'body ' || k || chr(10) || chr(10) || 'more' WHEN 2 THEN '' ELSE '第四章没有。' END AS content,
  CASE i WHEN 0 THEN 0 WHEN 1 THEN 9 + z + 2 + 10 WHEN 2 THEN 9 + z + 2 + 10 + 5 + z + 2 + 6 + 1 + 4 ELSE 9 + z + 2 + 10 + 5 + z + 2 + 6 + 1 + 4 + 5 END AS start FROM k, (VALUES (0), (1), (2), (3)) v(i) WHERE n % 3 = 0
  UNION ALL SELECT n, 0, '第1章', k, 4 FROM k WHERE n % 3 = 1 UNION ALL SELECT n, 0, '正文', ' plain ' || k || chr(10), 0 FROM k WHERE n % 3 = 2)
 SELECT 'local-txt:' || n AS book_url, i AS idx, title, 'local-txt:' || n || '#' || i AS url, CAST(start AS BIGINT) AS start, CAST(start + length(content) AS BIGINT) AS "end", content FROM r""",
    "a01_five_fields": L + """, x AS (SELECT *, CASE WHEN source_ord % 2 = 0 THEN '/c/' || book_url END AS cover_url, CASE WHEN source_ord % 3 = 0 THEN origin END AS intro, CASE WHEN item_ix % 5 = 0 THEN 'last' END AS last_chapter, lower(trim(name)) || '|' || lower(trim(author)) AS merge_key, (source_ord, item_ix, book_url) AS o FROM l)
 SELECT merge_key, arg_min(name, o) AS name, arg_min(book_url, o) AS book_url, arg_min(cover_url, o) FILTER (cover_url IS NOT NULL) AS cover_url, arg_min(intro, o) FILTER (intro IS NOT NULL) AS intro, arg_min(kind, o) FILTER (kind IS NOT NULL) AS kind,
  arg_min(last_chapter, o) FILTER (last_chapter IS NOT NULL) AS last_chapter, CAST(NULL AS VARCHAR) AS update_time, CASE WHEN count(*) > 1 THEN CAST(count(DISTINCT origin) AS INT) ELSE -1 END AS n_origins, CASE WHEN count(*) > 1 THEN arg_min(origin, o) END AS first_origin FROM x GROUP BY 1""",
    "a08_all_fields": _P + f""" SELECT book, key, trim(arg_min(name, ord)) AS name, CAST(count(DISTINCT p_type) AS INT) AS n_aliases, arg_max(status, ord) FILTER (status IS NOT NULL) AS status, arg_max(faction, ord) FILTER (faction IS NOT NULL) AS faction,
 arg_max(location, ord) FILTER (location IS NOT NULL) AS location, arg_max(last_seen, ord) AS last_seen, arg_max(importance, ({_RANK.format("importance")}, -ord)) AS importance FROM k GROUP BY 1, 2""",
    "a12_shown_characters": _P + """ SELECT book, key, trim(arg_min(name, ord)) AS name, arg_max(status, (length(coalesce(status, '')), -ord)) AS status, arg_min(faction, ord) FILTER (faction IS NOT NULL) AS faction, arg_min(location, ord) FILTER (location IS NOT NULL) AS location, arg_min(last_seen, ord) AS last_seen
 FROM k WHERE coalesce(importance, '') <> 'low' GROUP BY 1, 2""",
    "o01_increment": _P + " SELECT book, key, trim(arg_min(name, (ord % 2, ord))) AS name, arg_max(status, (ord % 2, ord)) FILTER (status IS NOT NULL) AS status, arg_max(last_seen, (ord % 2, ord)) AS last_seen FROM k GROUP BY 1, 2",
    "a12_shown_places": _SPOTS + """ SELECT book, name AS key, arg_min(kind, ord) FILTER (kind <> '') AS kind, arg_min(parent_name, ord) FILTER (parent_name IS NOT NULL) AS parent_name, arg_max(status, (length(coalesce(status, '')), -ord)) AS status, arg_min(first_seen, ord) AS first_seen,
 array_to_string(list_sort(list(DISTINCT who)), ',') AS characters FROM q WHERE coalesce(importance, '') <> 'low' GROUP BY 1, 2""",
    "a12_shown_relations": _TIES + f""" SELECT book, x, y, relation, arg_max(status, (length(coalesce(status, '')), -ord)) AS status, arg_max(description, (length(coalesce(description, '')), -ord)) AS description, arg_max(nullif(importance, ''), ({_RANK.format("importance")}, -ord)) AS importance
 FROM f WHERE x <> y AND relation <> '' AND NOT low AND NOT little GROUP BY 1, 2, 3, 4""",
    "p15_low_value": _TIES + " SELECT ord, little, low FROM f",
    "p15_recaps": _NOTES + " SELECT ord, recap FROM n",
    "a11_merge_notes": _NOTES + f" SELECT book, arg_min(category, ord) AS category, arg_min(title, ord) AS title, md5(arg_max(content, (length(content), -ord))) AS content_md5 FROM n WHERE NOT low AND NOT recap AND trim(title) <> '' GROUP BY book, {_KEY.format('category')}, {_KEY.format('title')}",
    "a13_category_groups": _NOTES + f""", g AS (SELECT book, category, {_KEY.format("title")} AS key, arg_min(title, ord) AS title, min(ord) AS ord FROM n WHERE NOT low GROUP BY 1, 2, 3)
 SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY coalesce(list_position({_list(list(K.CATEGORIES))}, category), 9), category, ord, key) AS INT) AS place, category, title FROM g""",
    "a10_merge_places": _SPOTS + " SELECT book, name AS key, kind, parent_name, status, first_seen, characters FROM m",
    "t10_place_order": _SPOTS + f" SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY {_BANDS} DESC, {_RANK.format('importance')} DESC, coalesce(kind, ''), name) AS INT) AS place, name FROM m",
    "u23_levels": _SPOTS + f" SELECT ord, level, {_BANDS} AS band, {_RANK.format('importance')} AS importance FROM q",
    "a14_nodes": _GRAPH + " SELECT book, id, kind, detail FROM nodes",
    "a14_links": _GRAPH + " SELECT * FROM links",
    "t09_node_order": _GRAPH + """, d AS (SELECT book, id, count(*) AS degree FROM (SELECT book, source AS id FROM links UNION ALL SELECT book, target FROM links) GROUP BY 1, 2)
 SELECT n.book, CAST(row_number() OVER (PARTITION BY n.book ORDER BY coalesce(degree, 0) DESC, n.id) AS INT) AS place, n.id, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d ON d.book = n.book AND d.id = n.id""",
    "p14_character_search": _P + " SELECT ord FROM k WHERE contains(lower(regexp_replace(concat_ws(' ', name, p_type, location, status), '\\s+', '', 'g')), 'larges1')",
    "u22_place_signature": _SPOTS + f", x AS (SELECT book, name || ':' || lower(coalesce(parent_name, '')) || ':' || coalesce(kind, '') || ':' || coalesce(status, '') || ':' AS one FROM m) SELECT book, md5(string_agg(one, '|' ORDER BY one)) AS signature_md5 FROM x GROUP BY 1",
    "j13_place_parents": """WITH n AS (SELECT n_nationkey AS k, n_name AS name, r_name, r_regionkey AS book, n_nationkey % 3 AS c FROM nation JOIN region ON n_regionkey = r_regionkey),
 t AS (SELECT book, count(*) AS towns, min(name) AS town FROM n WHERE c = 0 GROUP BY 1)
 SELECT n.book, name, CASE WHEN k % 2 = 0 OR c = 0 THEN r_name WHEN towns = 1 THEN town WHEN towns IS NULL THEN r_name END AS parent FROM n LEFT JOIN t USING (book) UNION ALL SELECT r_regionkey, r_name, NULL FROM region""",
    "u21_summaries": f"""WITH e AS (SELECT event_id, coalesce(['old', NULL, ''][event_id // 6 % 3 + 1], '') AS p, event_id % 6 AS i FROM events)
 SELECT event_id, md5(CASE i WHEN 0 THEN p WHEN 5 THEN p WHEN 1 THEN CASE WHEN p = '' THEN 'x' ELSE p END WHEN 2 THEN CASE WHEN p = '' THEN '他来了' ELSE p END WHEN 3 THEN '故事继续' ELSE repeat('z', 658) || '……' || repeat('z', 540) END) AS summary_md5 FROM e""",
    "u25_file_names": "SELECT s_suppkey, ['My Book.txt', 'b.tar.txt', 'book.txt', 'book.txt', '名字', '.txt', 'sub'][s_suppkey % 7 + 1] AS file, ['My Book', 'b.tar', 'book', 'book', '名字', '.txt', 'sub'][s_suppkey % 7 + 1] AS title FROM supplier",
    "p12_truthiness": "SELECT event_id, event_id % 12 IN (8, 9, 10) AS flag FROM events",
    "u14_scoped_order": """WITH a AS (SELECT *, regexp_replace(text, '(?m)[%$*&#]+', '', 'g') AS t1 FROM documents), b AS (SELECT *, CASE WHEN source = 'src1' THEN replace(t1, 'a', '@') ELSE t1 END AS t2 FROM a), c AS (SELECT *, replace(t2, 'the', 'THE') AS t3 FROM b),
 d AS (SELECT *, CASE WHEN lang = 'de' THEN regexp_replace(t3, '(?m)^The', '- The', 'g') ELSE t3 END AS t4 FROM c), e AS (SELECT *, CASE WHEN doc_id = 7 THEN replace(t4, 'e', '3') ELSE t4 END AS t5 FROM d), f AS (SELECT *, CASE WHEN lang = 'en' AND doc_id = 8 THEN replace(t5, 'i', '!') ELSE t5 END AS t6 FROM e)
 SELECT doc_id, concat_ws(',', '1', CASE WHEN source = 'src1' THEN '2' END, '3', CASE WHEN lang = 'de' THEN '4' END, CASE WHEN doc_id = 7 THEN '5' END, CASE WHEN lang = 'en' AND doc_id = 8 THEN '7' END) AS rules, md5(t6) AS text_md5 FROM f""",
    "j07_save_books": _BOOKS + """ SELECT CASE WHEN place % 10 = 2 AND origin = 'web' THEN book_url || 'x' ELSE book_url END AS book_url, CASE WHEN place % 10 = 1 THEN name || '+' ELSE name END AS name,
  CASE WHEN place % 20 = 1 THEN 'last' WHEN place % 10 = 1 THEN 'new' WHEN place % 10 = 2 AND origin = 'web' THEN 'moved' ELSE kind END AS kind, CASE WHEN place % 10 = 2 AND origin = 'web' THEN -1 ELSE "group" END AS "group" FROM b
 UNION ALL SELECT book_url || 'x', name, 'moved', -1 FROM b WHERE place % 10 = 2 AND origin <> 'web' UNION ALL SELECT book_url || '/new', name || '*', kind, "group" FROM b WHERE place % 10 = 3""",
    "j09_switch_with_detail": _BOOKS + """ SELECT CASE WHEN length(name) % 2 = 0 THEN book_url || '/s' ELSE book_url END AS book_url, CASE WHEN length(name) % 2 = 0 THEN 'other' ELSE origin END AS origin, name, CASE WHEN length(name) % 2 = 0 AND length(author) = 2 THEN 'A' ELSE author END AS author,
  CASE WHEN length(name) % 2 = 0 THEN '/toc' END AS toc_url, CASE WHEN length(name) % 2 = 0 THEN coalesce(kind, 'detail') ELSE kind END AS kind FROM b WHERE origin = 'web'""",
    "j02_books_of_a_host": """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS full_, regexp_replace(url, '[0-9]+([?#].*)?$', '') AS book_url FROM pages),
 b AS (SELECT page_id AS place, lower(regexp_extract(book_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, rtrim(coalesce(nullif(regexp_extract(book_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/'), '/') AS path FROM p)
 SELECT page_id, min(place) AS place FROM p JOIN b USING (host) WHERE starts_with(full_, path) OR starts_with(path, rtrim(full_, '/')) GROUP BY 1""",
    "p07_recent_kinds": _BOOKS + ", h AS (SELECT *, contains(lower(concat_ws('|', name, author, kind, origin)), 'a1') AS hit FROM b) SELECT place, hit AS \"all\", hit AND place % 4 <> 0 AS book, hit AND place % 4 = 0 AS rss FROM h",
    "p09_local_books": _BOOKS + " SELECT place, place % 3 = 0 OR place % 5 = 0 AS local FROM b",
    "p08_title_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '00001')",
    "p11_feed_scope": """WITH s AS (SELECT *, s_suppkey % 4 = 0 OR s_suppkey % 4 > 1 AS live, ['g' || (s_nationkey % 5), 'all', 'g' || (s_nationkey % 3)] AS g FROM supplier)
 SELECT s_suppkey, live AS all_, live AND list_contains(g, 'g2') AS group_, live AND s_name = 'Supplier#000000002' AS one_, false AS nameless FROM s""",
    "p05_overview_flags": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'g' ELSE '未分组' END AS "group", CASE WHEN s_suppkey % 3 = 2 THEN '停用' ELSE '启用' END AS status_text, CASE WHEN s_suppkey % 3 = 1 THEN '发现停用' ELSE '发现可用' END AS explore_text,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Cookie 独立' ELSE '默认 Cookie' END AS cookie_text, s_suppkey % 3 = 1 OR s_suppkey % 2 = 0 AS has_search, s_suppkey % 3 = 2 AS has_explore, s_suppkey % 3 <> 1 AS has_book_info, s_suppkey % 2 = 1 AS has_toc, true AS has_content, s_suppkey % 3 = 1 AS has_login FROM supplier""",
    "u18_chunks": u18_sql(),
}
