"""Queries of extraction rules over pages, with SQL that reads the same from the source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio_spark.functions import urls as U
from folio_spark.operators import chapters, rules
from folio_spark.operators.shred import shred, trees

from .listings import table
from .texts import _K


def page_trees(spark, sf):
    return trees(table(spark, sf, "pages"))


def e01(spark, sf):
    rows = shred(table(spark, sf, "pages"))
    return rows.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("n_li"), F.count_if(F.col("tag") == "p").alias("n_p"), F.count_if(F.col("tag") == "br").alias("n_br"), F.max(F.when(F.col("tag") == "html", F.col("attrs")["lang"])).alias("lang"))


def e02(spark, sf):
    found = F.size(rules.item_places("tag.nav@tag.ul@tag.li@tag.a")).cast("long")
    return page_trees(spark, sf).select("page_id", found.alias("n")).where("n > 0")


def e03(spark, sf):
    return rules.values(page_trees(spark, sf), "tag.li[0,-1,1:3]@tag.a@href")


def e04(spark, sf):
    return rules.values(page_trees(spark, sf), "tag.li@tag.a@text%%tag.li@tag.a@href")


def e04_first(spark, sf):
    return rules.values(page_trees(spark, sf), "tag.h2@text||tag.h1@text").select("page_id", "value")


def e05(spark, sf):
    return rules.values(page_trees(spark, sf), "tag.div.0@class&&tag.html@lang")


def e06(spark, sf):
    return rules.listing(page_trees(spark, sf), "tag.nav@tag.li", {"title": "tag.a@text", "href": "tag.a@href"})


def e06_reversed(spark, sf):
    return rules.listing(page_trees(spark, sf), "-tag.nav@tag.li", {"href": "tag.a@href##^/##"})


def e08(spark, sf):
    return rules.values(page_trees(spark, sf), "tag.article@text").select("page_id", F.md5("value").alias("text_md5"))


def e21(spark, sf):
    items = rules.listing(page_trees(spark, sf).withColumn("page", F.struct("page_id", "url")), "tag.nav@tag.li", {"title": "tag.a@text", "href": "tag.a@href"}, "page")
    url = F.col("page.url")
    rows = items.select(U.host(url).alias("book"), F.col("page.page_id").alias("page_ord"), "item_ix", "title", U.resolve(F.col("href"), url).alias("url"))
    return chapters.assemble_toc(rows)


QUERIES = {"e01_shred": e01, "e02_select": e02, "e03_positions": e03, "e04_interleave": e04, "e04_first_non_empty": e04_first, "e05_extractors": e05, "e06_relative_fields": e06, "e06_reversed_list": e06_reversed, "e08_body_text": e08, "e21_toc": e21}

SQL = {
    "e01_shred": """SELECT page_id, len(regexp_extract_all(html, '<li[ >]')) AS n_li, len(regexp_extract_all(html, '<p[ >]')) AS n_p, len(regexp_extract_all(html, '<br[ />]')) AS n_br, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang
 FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '(?s)<style>.*?</style>', '', 'g') AS html FROM pages)""",
    "e02_select": _K + " SELECT page_id, count(*) AS n FROM links GROUP BY 1",
    "e03_positions": _K + """, n AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM links), r AS (SELECT page_id, href, CASE WHEN item_ix = 0 THEN 0 WHEN item_ix = n - 1 THEN 1 ELSE 1 + item_ix END AS o FROM n WHERE item_ix <= 3 OR item_ix = n - 1)
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS place, href AS value FROM r""",
    "e04_interleave": _K + " SELECT page_id, 2 * item_ix AS place, title AS value FROM links UNION ALL SELECT page_id, 2 * item_ix + 1, href FROM links",
    "e04_first_non_empty": "SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS value FROM pages",
    "e05_extractors": "SELECT page_id, 0 AS place, 'ad' AS value FROM pages UNION ALL SELECT page_id, 1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) FROM pages",
    "e06_relative_fields": _K + " SELECT page_id, item_ix, title, href FROM links",
    "e06_reversed_list": _K + " SELECT page_id, max(item_ix) OVER (PARTITION BY page_id) - item_ix AS item_ix, href[2:] AS href FROM links",
    "e08_body_text": """WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS b FROM pages)
 SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS text_md5 FROM a""",
    "e21_toc": _K + """, q AS (SELECT book, page_ord, item_ix, regexp_extract(p.url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || toc.url AS url, title FROM toc JOIN pages p ON p.page_id = page_ord),
 f AS (SELECT book, url, min((page_ord, item_ix, title)) AS f FROM q GROUP BY 1, 2) SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY f[1], f[2], url) - 1 AS INT) AS idx, url, f[3] AS title FROM f""",
}
