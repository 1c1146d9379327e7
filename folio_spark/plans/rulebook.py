"""Queries of catalogs of rules over pages and other bodies: lists, details, tables of contents, contents, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio_spark.functions import urls as U
from folio_spark.operators import extract, programs, rules
from folio_spark.operators.shred import trees

from .listings import table
from .texts import _K



def sourced(spark, sf):
    """Pages of three sources: markup read by selection, markup read by a pattern, and JSON."""
    p = table(spark, sf, "pages")
    books = F.array(F.struct(U.host(F.col("url")).alias("n"), F.concat(F.lit("/j/"), F.col("page_id").cast("string")).alias("u")), F.struct(F.lit("second").alias("n"), F.concat(F.lit("/k/"), F.col("page_id").cast("string")).alias("u")))
    body = F.when(F.col("page_id") % 3 == 2, F.to_json(F.struct(books.alias("books")))).otherwise(F.col("html"))
    return p.select("page_id", "url", body.alias("html"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("source_url"))


CATALOG = [
    {"source_url": "s0", "source_ord": 0, "list": "@css:tag.nav@tag.li", "fields": {"name": "tag.a@text", "book_url": "tag.a@href"}, "explore_list": "-tag.nav@tag.li", "explore_fields": {"name": "tag.a@href##^/##", "book_url": "tag.a@href"}},
    {"source_url": "s1", "source_ord": 1, "list": ':<li><a href="([^"]*)">([^<]*)</a>', "fields": {"name": "$2", "book_url": "$1"}, "url_pattern": "x"},
    {"source_url": "s2", "source_ord": 2, "list": "books", "fields": {"name": "n", "book_url": "$.u"}, "explore_list": "  "},
]


def e16(spark, sf):
    """One rule, two kinds of body: JSON bodies go to the JSON branch, others to selection."""
    rows = extract.listing(sourced(spark, sf).where("source_url <> 's1'"), "books", {"n": "n"})
    return rows.select("page_id", "item_ix", "n")


def e17(spark, sf):
    return extract.search(sourced(spark, sf), CATALOG).select("page_id", "source_ord", "item_ix", "name", "book_url")


def e18(spark, sf):
    return extract.explore(sourced(spark, sf), CATALOG).select("page_id", "source_ord", "item_ix", "name", "book_url")


def e19(spark, sf):
    catalog = [{"source_url": "s0", "source_ord": 0, "list": "class.results@tag.li", "fields": {"name": "tag.a@text", "book_url": "tag.a@href"}, "detail": {"name": "tag.h1@text", "book_url": "tag.a.0@href"}}]
    pages = table(spark, sf, "pages").withColumn("source_url", F.lit("s0"))
    return extract.search(pages, catalog).select("page_id", "item_ix", "name", "book_url")


def e20(spark, sf):
    rule = {"source_url": "s0", "source_ord": 0, "init": "@put:{l:tag.html@lang,a:tag.nav@tag.a.0@text}", "detail": {"name": "tag.h1@text", "author": "@get:{a}", "kind": "tag.html@lang##^##lang:", "intro": "{{l}}/@get:{a}", "cover_url": "tag.nav@tag.a.0@href", "toc_url": "tag.nav@tag.a.40@href"}}
    pages = table(spark, sf, "pages").withColumn("source_url", F.lit("s0"))
    return extract.details(pages, [rule]).select("page_id", "book_url", "name", "author", "kind", "intro", "cover_url", "toc_url", "word_count")


def e21_flags(spark, sf):
    rule = {"source_url": "s0", "source_ord": 0, "toc_list": "-tag.nav@tag.li", "toc": {"title": "tag.a@text", "url": "tag.a@href", "tag": "tag.a@href##/##", "is_vip": "tag.a@text##^[aeiou].*$##", "is_volume": "tag.a@href##^.*[^n]$##0"}}
    pages = table(spark, sf, "pages").withColumn("source_url", F.lit("s0"))
    return extract.tocs(pages, [rule]).select("page_id", "idx", "title", "url", "tag", "is_volume", "is_vip", "is_pay")


def e22_rules(spark, sf):
    rule = {"source_url": "s0", "source_ord": 0, "content": "tag.article@textNodes", "source_regex": "<h1>[^<]*</h1>##", "replace_regex": "##[|] ##", "next": "tag.nav@tag.a.-1@href"}
    pages = table(spark, sf, "pages").withColumn("source_url", F.lit("s0"))
    return extract.contents(pages, [rule]).select("page_id", F.md5("content").alias("content_md5"))


def e23(spark, sf):
    return extract.next_pages(table(spark, sf, "pages"), "tag.nav@tag.a.-1@href", all_of_them=False).select("page_id", "next_url")


def e21_next(spark, sf):
    return extract.next_pages(table(spark, sf, "pages"), "tag.nav@tag.a!0@href").select("page_id", "ix", "next_url")


def e05_source(spark, sf):
    return rules.values(trees(table(spark, sf, "pages")), "tag.nav@html").select("page_id", F.md5("value").alias("html_md5"))


def e07(spark, sf):
    return rules.values(trees(table(spark, sf, "pages")), "tag.nav@html@@tag.li@tag.a@text")


def xml_bodies(spark, sf):
    """A small document for each supplier; every fifth isn't well-formed."""
    s = table(spark, sf, "supplier")
    body = F.concat(F.lit("<s><n>"), F.col("s_name"), F.lit("</n><k>"), (F.col("s_suppkey") % 4).cast("string"), F.lit("</k><k>7</k>"), F.when(F.col("s_suppkey") % 5 == 0, "<s>").otherwise("</s>"))
    return s.select("s_suppkey", body.alias("source"))


def e09(spark, sf):
    b = F.col("source")
    return xml_bodies(spark, sf).select("s_suppkey", extract.xpath_value("//n/text()", b).alias("name"), extract.xpath_value("@xpath:count(//k)", b).alias("n"), extract.xpath_value("sum(//k)", b).alias("total"), extract.xpath_value("//k[1]/text() = '3'", b).alias("three"), extract.xpath_value("string(//k[2])##7##seven", b).alias("second"))


def e09_list(spark, sf):
    return xml_bodies(spark, sf).select("s_suppkey", F.posexplode(extract.items("//k", {"v": "text()"})).alias("item_ix", "r")).select("s_suppkey", "item_ix", F.col("r.v").alias("v"))


def e11(spark, sf):
    """Fields of JSON bodies: by key, path, literal, template, and a variable that a later field takes up."""
    body = F.concat(F.lit('{"rows":['), F.col("props"), F.lit(',{"k":[1,"b"],"n":null,"o":{"p":true}}]}'))
    fields = {"key": "k", "path": "$.o.p", "literal": "https://h/?k=1", "put": "@put:{kk:k}", "made": "/b/{{$.k}}?e={{@get:{kk}}}&f={$.k}", "changed": "k##[0-9]##d", "once": "k##[0-9]##d###", "none": "$.n"}
    rows = table(spark, sf, "events").select("event_id", body.alias("source")).select("event_id", F.posexplode(extract.items("$.rows[*]", fields)).alias("item_ix", "r"))
    return rows.select("event_id", "item_ix", *(F.col(f"r.{c}").alias(c) for c in fields if c != "put"))


def e24(spark, sf):
    n = F.col("s_suppkey").cast("string")
    strict = F.concat(F.lit('[{"title":"A '), n, F.lit('","url":"/a"},{"title":" ","url":"/b"},{"title":"C"}]'))
    relaxed = F.concat(F.lit('[<"title":"R<'), n, F.lit('>","url":"/r">]'))
    plain = F.concat(F.lit(" One::/1&&Two\n\n::/none&&T"), n, F.lit(":: /t::x &&"))
    text = F.when(F.col("s_suppkey") % 3 == 0, strict).when(F.col("s_suppkey") % 3 == 1, relaxed).otherwise(plain)
    return table(spark, sf, "supplier").select("s_suppkey", F.posexplode(extract.explore_kinds(text)).alias("pos", "k")).select("s_suppkey", "pos", F.col("k.title").alias("title"), F.col("k.url").alias("url"))


def many_sources(spark, sf):
    """A catalog with rules of its own for every part: selections, patterns and JSON paths by turns; and pages, each with the list of the eight of these that read it."""
    k = F.col("p_partkey")
    key, third = k.cast("string"), F.floor(k / 3)
    listed = F.when(k % 3 == 0, F.concat(F.lit("tag.nav@tag.li["), (third % 3).cast("string"), F.lit(":"), (third % 5).cast("string"), F.lit("]"))).when(k % 3 == 1, ':<li><a href="([^"]*)">([^<]*)</a>').otherwise("$.books[*]")
    name = F.concat(F.when(k % 3 == 0, "tag.a@text##$##-").when(k % 3 == 1, "$2-").otherwise("n##$##-"), key)
    link = F.when(k % 3 == 0, "tag.a@href").when(k % 3 == 1, "$1").otherwise("$.u")
    catalog = table(spark, sf, "part").select(F.concat(F.lit("s"), key).alias("source_url"), listed.alias("list"), F.create_map(F.lit("name"), name, F.lit("book_url"), link).alias("fields"))
    each = table(spark, sf, "part").agg(F.floor(F.count("*") / 3).alias("m"))
    pages = sourced(spark, sf).drop("source_url").crossJoin(F.broadcast(each))
    source = lambda j: (F.floor(F.col("page_id") / 3) * 8 + j) % F.col("m") * 3 + F.col("page_id") % 3
    readers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.concat(F.lit("s"), source(j).cast("string")))
    return pages.select("page_id", "url", "html", readers.alias("source_url")), catalog


def e17_data(spark, sf):
    names = ("name", "book_url")
    pages, catalog = many_sources(spark, sf)
    return programs.search(pages, programs.compiled(catalog, "list", "fields", names), names, keep=("reader",)).select("page_id", F.col("reader").alias("j"), "source_url", "item_ix", "name", "book_url")


def e20_data(spark, sf):
    """Whole pages' fields by rules of as many sources."""
    pages, catalog = many_sources(spark, sf)
    k = F.regexp_extract("source_url", r"\d+", 0)
    rules_of = F.when(k.cast("long") % 3 == 2, F.create_map(F.lit("name"), F.concat(F.lit("$.books[1].n##d$##-"), k), F.lit("kind"), F.lit("books[0].u"))).otherwise(F.create_map(F.lit("name"), F.concat(F.lit("tag.nothing@text||tag.nav@tag.li."), F.pmod(k.cast("long"), F.lit(4)).cast("string"), F.lit("@tag.a@href")), F.lit("kind"), F.lit("tag.html@lang")))
    names = ("name", "kind", "author")
    return programs.details(pages, programs.compiled(catalog.select("source_url", rules_of.alias("r")), None, "r", names), names, keep=("reader",)).select("page_id", F.col("reader").alias("j"), "source_url", *names)


def _upper(t):
    """A text in upper case, letter by letter as SQL has it: none becomes two ('ß' is 'ẞ', not 'SS')."""
    one = lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(t, ""), one), "")


def f01_listing(spark, sf):
    """A listing with the caller's functions: bodies without their first link, every other item, names with their place."""
    hooks = {"body": lambda b: F.regexp_replace(b, r'<a href="/[^"]*">of</a>', ""), "items": lambda rows: F.filter(rows, lambda r, i: i % 2 == 0), "name": lambda i, t: F.concat((i + 1).cast("string"), F.lit(". "), _upper(t))}
    return extract.search(sourced(spark, sf).where("page_id % 3 = 1"), CATALOG[1:2], hooks=hooks).select("page_id", "item_ix", "name")


def _upper_text(text: str) -> str:
    return "".join("ẞ" if c == "ß" else next((u for u in (c.upper(), c.title()) if len(u) == 1), c) for c in text)


@F.pandas_udf(T.StringType())
def _marked(texts: pd.Series) -> pd.Series:
    return "[" + texts.map(_upper_text, na_action="ignore") + "]"


def f01_content(spark, sf):
    """Contents with a function of the caller that is Python, in Arrow batches."""
    rule = {"source_url": "s0", "source_ord": 0, "content": "tag.h1@text"}
    pages = table(spark, sf, "pages").withColumn("source_url", F.lit("s0"))
    return extract.contents(pages, [rule], hooks={"body": lambda b: F.replace(b, F.lit("<h1>"), F.lit("<h1>x ")), "content": lambda _, t: _marked(t)}).select("page_id", "content")


QUERIES = {
    "f01_listing_hooks": f01_listing, "f01_content_hooks": f01_content,
    "e17_rules_as_data": e17_data, "e20_rules_as_data": e20_data,
    "e05_source_text": e05_source, "e07_pages_in_pages": e07, "e09_xpath_values": e09, "e09_xpath_list": e09_list, "e11_json_items": e11, "e16_routing": e16, "e17_search": e17, "e18_explore": e18, "e19_detail_fallback": e19,
    "e20_details": e20, "e21_flags": e21_flags, "e21_next_pages": e21_next, "e22_content_rules": e22_rules, "e23_next_content": e23, "e24_explore_kinds": e24,
}

_O = "regexp_extract(page_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
_B = "regexp_replace(page_url, '#.*$', '')"
_T = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_U = "replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_H1 = _T.format("replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')")
_J = "SELECT page_id, 2 AS source_ord, i AS item_ix, CASE WHEN i = 0 THEN lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) ELSE 'second' END AS name, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || CASE WHEN i = 0 THEN '/j/' ELSE '/k/' END || page_id AS book_url FROM pages, (VALUES (0), (1)) v(i) WHERE page_id % 3 = 2"

_M = """, third AS (SELECT count(*) // 3 AS m FROM part), q AS (SELECT page_id, url, html, j, (page_id // 3 * 8 + j) % third.m * 3 + page_id % 3 AS k FROM pages, third, range(8) t(j)),
  n AS (SELECT page_id AS id, count(*) AS n FROM links GROUP BY 1), css AS (SELECT page_id, j, k, least(k // 3 % 3, n - 1) AS lo, least(k // 3 % 5, n - 1) AS hi FROM q JOIN n ON page_id = id WHERE page_id % 3 = 0)"""

SQL = {
    "f01_listing_hooks": """WITH m AS (SELECT page_id, regexp_replace(html, '<a href="/[^"]*">of</a>', '', 'g') AS b FROM pages WHERE page_id % 3 = 1), t AS (SELECT page_id, regexp_extract_all(b, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS t FROM m),
 k AS (SELECT page_id, list_filter(t, lambda x, i: i % 2 = 1 AND x <> '') AS t, list_filter(t, lambda x: x <> '') AS u FROM t), n AS (SELECT page_id, list_filter(u, lambda x, i: i % 2 = 1) AS t FROM k), e AS (SELECT page_id, unnest(t) AS t, unnest(range(len(t))) AS i FROM n)
 SELECT page_id, CAST(i AS INT) AS item_ix, (i + 1) || '. ' || upper(t) AS name FROM e""",
    "f01_content_hooks": f"SELECT page_id, '[' || upper(trim('x ' || {_H1})) || ']' AS content FROM pages",
    "e17_rules_as_data": _K + _M + f""" SELECT page_id, j, 's' || k AS source_url, CAST(abs(item_ix - lo) AS INT) AS item_ix, title || '-' || k AS name, {_O} || href AS book_url FROM css JOIN links USING (page_id) WHERE item_ix BETWEEN least(lo, hi) AND greatest(lo, hi)
 UNION ALL SELECT page_id, j, 's' || k, item_ix, title || '-' || k, {_O} || href FROM q JOIN links USING (page_id) WHERE page_id % 3 = 1
 UNION ALL SELECT page_id, j, 's' || k, b.item_ix, b.name || '-' || k, b.book_url FROM q JOIN ({_J}) b USING (page_id)""",
    "e20_rules_as_data": _K + _M + f""" SELECT page_id, j, 's' || k AS source_url, CASE WHEN page_id % 3 = 2 THEN 'secon-' || k ELSE (SELECT href FROM links l WHERE l.page_id = q.page_id AND item_ix = k % 4) END AS name,
 CASE WHEN page_id % 3 = 2 THEN '/j/' || page_id ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS kind, CAST(NULL AS VARCHAR) AS author FROM q""",
    "e05_source_text": "SELECT page_id, md5(regexp_extract(html, '(?s)<nav>.*?</nav>', 0)) AS html_md5 FROM pages",
    "e07_pages_in_pages": _K + " SELECT page_id, item_ix AS place, title AS value FROM links",
    "e09_xpath_values": """SELECT s_suppkey, CASE WHEN ok THEN s_name END AS name, CASE WHEN ok THEN '2' END AS n, CASE WHEN ok THEN CAST(7 + s_suppkey % 4 AS VARCHAR) END AS total,
 CASE WHEN ok THEN CAST(s_suppkey % 4 = 3 AS VARCHAR) END AS three, CASE WHEN ok THEN 'seven' END AS second FROM (SELECT *, s_suppkey % 5 <> 0 AS ok FROM supplier)""",
    "e09_xpath_list": "SELECT s_suppkey, i AS item_ix, CASE WHEN i = 0 THEN CAST(s_suppkey % 4 AS VARCHAR) ELSE '7' END AS v FROM supplier, (VALUES (0), (1)) t(i) WHERE s_suppkey % 5 <> 0",
    "e11_json_items": """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
 SELECT event_id, 0 AS item_ix, k AS key, CAST(NULL AS VARCHAR) AS path, 'https://h/?k=1' AS literal, '/b/' || k || '?e=' || k || '&f=' || k AS made, regexp_replace(k, '[0-9]', 'd', 'g') AS changed, regexp_replace(k, '[0-9]', 'd') AS once, CAST(NULL AS VARCHAR) AS none FROM e
 UNION ALL SELECT event_id, 1, '1' || chr(10) || 'b', 'true', 'https://h/?k=1', '/b/1' || chr(10) || 'b?e=1' || chr(10) || 'b&f=1' || chr(10) || 'b', 'd' || chr(10) || 'b', 'd' || chr(10) || 'b', NULL FROM e""",
    "e16_routing": "SELECT page_id, item_ix, name AS n FROM (" + _J + ")",
    "e17_search": _K + f" SELECT page_id, page_id % 3 AS source_ord, item_ix, title AS name, {_O} || href AS book_url FROM links WHERE page_id % 3 < 2 UNION ALL {_J}",
    "e18_explore": _K + f""" SELECT page_id, 0 AS source_ord, max(item_ix) OVER (PARTITION BY page_id) - item_ix AS item_ix, href[2:] AS name, {_O} || href AS book_url FROM links WHERE page_id % 3 = 0
 UNION ALL SELECT page_id, 1, item_ix, title, {_O} || href FROM links WHERE page_id % 3 = 1 UNION ALL {_J}""",
    "e19_detail_fallback": f"""WITH p AS (SELECT page_id, url AS page_url, {_H1} AS name, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
 SELECT page_id, 0 AS item_ix, name, CASE WHEN len(h) > 0 THEN {_O} || h[1] ELSE {_B} END AS book_url FROM p WHERE name <> ''""",
    "e20_details": f"""WITH p AS (SELECT page_id, url AS page_url, {_H1} AS name, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>', 0), '<a href="([^"]*)">([^<]*)</a>', 1) AS h,
  regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>', 0), '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
 SELECT page_id, page_url AS book_url, name, coalesce(t[1], '') AS author, 'lang:' || lang AS kind, lang || '/' || coalesce(t[1], '') AS intro, CASE WHEN len(h) > 0 THEN {_O} || h[1] END AS cover_url,
  CASE WHEN len(h) > 40 THEN {_O} || h[41] ELSE page_url END AS toc_url, CAST(NULL AS VARCHAR) AS word_count FROM p""",
    "e21_flags": _K + f""", d AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY item_ix) = 1)
 SELECT page_id, CAST(count(*) OVER (PARTITION BY page_id) - row_number() OVER (PARTITION BY page_id ORDER BY item_ix) AS INT) AS idx, title, {_O} || href AS url, replace(href, '/', '') AS tag, ends_with(href, 'n') AS is_volume,
  NOT regexp_matches(title, '^[aeiou]') AND lower(title) NOT IN ('0', 'false', 'null', 'none', 'no', 'off') AS is_vip, false AS is_pay FROM d""",
    "e21_next_pages": _K + f" SELECT page_id, item_ix - 1 AS ix, {_O} || href AS next_url FROM links WHERE item_ix > 0",
    "e22_content_rules": f"""WITH a AS (SELECT page_id, regexp_extract(regexp_replace(html, '<h1>[^<]*</h1>', '', 'g'), '(?s)<article>(.*?)</article>', 1) AS b FROM pages),
 t AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(b, '<[^>]*>'), lambda x: {_T.format(_U.format('x'))}), lambda x: x <> '') AS t FROM a)
 SELECT page_id, md5(regexp_replace(array_to_string(t, chr(10)), '[|] ', '', 'g')) AS content_md5 FROM t""",
    "e23_next_content": _K + f" SELECT page_id, {_O} || href AS next_url FROM links QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY item_ix DESC) = 1",
    "e24_explore_kinds": """SELECT s_suppkey, i AS pos, CASE WHEN i = 0 THEN 'A ' || s_suppkey ELSE 'C' END AS title, CASE WHEN i = 0 THEN '/a' END AS url FROM supplier, (VALUES (0), (1)) t(i) WHERE s_suppkey % 3 = 0
 UNION ALL SELECT s_suppkey, 0, 'R<' || s_suppkey || '>', '/r' FROM supplier WHERE s_suppkey % 3 = 1
 UNION ALL SELECT s_suppkey, i, CASE i WHEN 0 THEN 'One' WHEN 1 THEN 'Two' ELSE 'T' || s_suppkey END, CASE i WHEN 0 THEN '/1' WHEN 2 THEN '/t::x' END FROM supplier, (VALUES (0), (1), (2)) t(i) WHERE s_suppkey % 3 = 2""",
}
