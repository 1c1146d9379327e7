"""Queries of imports, stores, requests, page walks and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio_spark import streaming
from folio_spark.functions import sql as Q
from folio_spark.functions import text as X
from folio_spark.functions import urls as U
from folio_spark.operators import chapters as C
from folio_spark.operators import knowledge as K
from folio_spark.operators import shelf as S
from folio_spark.plans.listings import table
from folio_spark.plans.story import _nth
from folio_spark.sources import catalogs, epub, stores
from folio_spark.streaming import timers


def _folder(spark, tag: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or stores.checkpointed(spark.range(1)).sparkSession.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def catalog_texts(spark, sf):
    """JSON documents of all the shapes a catalog comes in, one a supplier."""
    k = F.col("s_suppkey").cast("string")
    old = F.concat(F.lit('{"bookSourceUrl":"u'), k, F.lit('","serialNumber":"'), k, F.lit('","bookSourceType":"AUDIO","httpUserAgent":"ua","ruleSearchUrl":"/s?q=searchKey&p={1,2}|charset=gbk","ruleSearchList":"tag.li","ruleSearchNoteUrl":"a@href","ruleSearchBookUrl":"b@href","ruleSearchName":" ","ruleChapterUrl":"/toc","ruleBookContent":"id.c","enable":true}'))
    new = F.concat(F.lit('{"bookSourceUrl":"n'), k, F.lit('","customOrder":'), k, F.lit(',"header":"h","ruleSearch":"{\\"bookList\\":\\"x\\"}","ruleToc":"null","searchUrl":"/p@Header:{\\"A\\":\\"b\\"}@body:q=searchKey"}'))
    body = F.concat(old, F.lit(","), new)
    text = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit('{"bookSourceList":['), body, F.lit("]}"))).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit('{"data":['), body, F.lit("]}"))).otherwise("{broken")
    return table(spark, sf, "supplier").select("s_suppkey", text.alias("value"))


def s01(spark, sf):
    rows = catalogs.catalog_rows(catalog_texts(spark, sf))
    return rows.select("s_suppkey", "pos", catalogs.field("source", "bookSourceUrl").alias("url"), catalogs.int_or_text("source", "customOrder").alias("custom_order"), F.get_json_object(catalogs.rule_object("source", "ruleSearch"), "$.bookList").alias("book_list"), catalogs.rule_object("source", "ruleToc").alias("toc"))


def s03(spark, sf):
    rows = catalogs.catalog_rows(catalog_texts(spark, sf))
    m = catalogs.migrated("source")
    pick = {"url": m["bookSourceUrl"], "custom_order": m["customOrder"], "kind": m["bookSourceType"], "header": m["header"], "enabled": m["enabled"], "search_url": m["searchUrl"], "toc_url": F.try_element_at(m["ruleBookInfo"], F.lit("tocUrl")), "chapter_url": F.try_element_at(m["ruleToc"], F.lit("chapterUrl")), "content": F.try_element_at(m["ruleContent"], F.lit("content"))}
    pick |= {f"search_{n}": F.try_element_at(m["ruleSearch"], F.lit(n)) for n in ("bookList", "bookUrl", "name")}
    return rows.select("s_suppkey", "pos", *(v.alias(c) for c, v in pick.items()))


def s06(spark, sf):
    """Bodies in several charsets, told in three ways."""
    n = F.col("p_partkey")
    word = F.concat(F.lit("书"), n.cast("string"))
    latin = F.concat(F.lit("é"), n.cast("string"))
    gbk = F.concat(F.unhex(F.lit("CAE9")), F.encode(n.cast("string"), "UTF-8"))  # the same word in GB18030
    body = F.when(n % 4 == 0, F.encode(word, "UTF-8")).when(n % 4 == 1, gbk).when(n % 4 == 2, F.encode(latin, "ISO-8859-1")).otherwise(F.concat(F.encode(F.lit('<meta charset="gb2312">'), "UTF-8"), gbk))
    declared, kind = F.when(n % 4 == 1, "GBK").otherwise(""), F.when(n % 4 == 2, "text/xml; charset=iso-8859-1").otherwise("text/html")
    return table(spark, sf, "part").select("p_partkey", catalogs.decode_body(body, declared, kind).alias("text"), catalogs.decode_body(body, declared, kind, F.lit("image")).alias("digits"))


def s07(spark, sf):
    n = F.col("s_suppkey")
    word = F.concat(F.lit("章"), n.cast("string"))
    content = F.when(n % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(word, "UTF-8"))).when(n % 3 == 1, F.encode(word, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("D5C2")), F.encode(n.cast("string"), "UTF-8")))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("/in/b"), n.cast("string"), F.lit(".txt")).alias("path"), content.alias("content"))
    return catalogs.decoded_texts(files)


def feed_bodies(spark, sf):
    n = F.col("s_suppkey")
    k = n.cast("string")
    rss = F.concat(F.lit('<rss><channel><title>f</title><item><title> A'), k, F.lit('</title><link>http://a/'), k, F.lit('</link><description>d</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><content:encoded>full</content:encoded><enclosure url="i.png" type="image/png"/></item><item><title>B</title><link>http://b</link></item></channel></rss>'))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="text">E'), k, F.lit('</title><link rel="self" href="s"/><link href="http://e/'), k, F.lit('"/><summary>s</summary><updated>2024-01-02T03:04:05Z</updated></entry></feed>'))
    body = F.when(n % 3 == 0, rss).when(n % 3 == 1, atom).otherwise("<rss><channel><item>")
    return table(spark, sf, "supplier").select(k.alias("origin"), body.alias("body"))


def s09(spark, sf):
    return catalogs.feed_articles(feed_bodies(spark, sf)).select("origin", "pos", "title", "link", "description", "content", "image", "ord")


def s10(spark, sf):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"'), _nth(list(catalogs.FEED_WRAPPERS), F.col("s_suppkey")), F.lit('":[{"sourceUrl":"f'), k, F.lit('"}]}'))
    rows = catalogs.catalog_rows(table(spark, sf, "supplier").select("s_suppkey", text.alias("value")), "value", catalogs.FEED_WRAPPERS)
    return rows.select("s_suppkey", "pos", catalogs.field("source", "sourceUrl").alias("url"))


def s11(spark, sf):
    """Documents put, some put again with other texts, some removed."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("/b/"), "source").alias("book_url"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("chapter_url"), "doc_id", F.md5("text").alias("content"))
    store = stores.ContentStore(spark, _folder(spark, "store"))
    store.put(stores.with_keys(d))
    store.put(stores.with_keys(d.where("doc_id % 5 = 0").withColumn("content", F.lit("again"))))
    store.remove(stores.with_keys(d.where("doc_id % 7 = 0")).select("book_key", "chapter_key"))
    return store.read().select("doc_id", "content")


def s12(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("toc_url"), F.col("turn").cast("int").alias("idx"), "role")
    store = stores.TocStore(spark, _folder(spark, "tocs"))
    store.save(c.where("idx < 2"))
    store.append(c.where("idx >= 2"))
    store.delete(c.where("toc_url like '%3'"))
    return store.load().select("toc_url", "idx", "role")


def s13(spark, sf):
    path = _folder(spark, "bundle")
    b = table(spark, sf, "orders").select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("book_url"), "o_totalprice", F.col("o_orderdate").cast("string").alias("day"))
    stores.export_bundle({"books": b, "groups": table(spark, sf, "region").select(F.col("r_regionkey").alias("group_id"), "r_name")}, path)
    return stores.restore_bundle(spark, path)["books"]


def s14(spark, sf):
    k = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit('{"bookUrl":"/o/'), k, F.lit('","origin":"w","x":{"y":[{"z":1}]}}'))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("["), one, F.lit(","), one, F.lit(',{"bookUrl":"/cut'))).when(F.col("o_orderkey") % 3 == 1, F.concat(one, F.lit('{"bookUrl":"/p/'), k, F.lit('","origin":"v"}garbage'))).otherwise('{"bookUrl":}')
    return catalogs.recovered(table(spark, sf, "orders").select(text.alias("value"))).select(F.col("bookUrl").alias("book_url"), "origin", F.get_json_object("item", "$.x.y[0].z").alias("z"))


def s15(spark, sf):
    c = table(spark, sf, "customer").select(_nth(["default", "anna"], F.floor(F.col("c_custkey") / 2)).alias("user_ns"), F.concat(F.lit("s"), (F.col("c_custkey") - F.col("c_custkey") % 3).cast("string")).alias("source_url"), F.col("c_name").alias("name")).dropDuplicates(["user_ns", "source_url"]).drop("name").withColumn("name", F.concat("user_ns", F.lit(":"), "source_url"))
    return catalogs.copy_sources(c, "default", "anna")


def _spread(spark, rows, key: str):
    """Short rows over all tasks: a small file is one part, whatever is made of its rows."""
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, key)


def _zipped(batches):
    """Archives of files (path, text), one a row."""
    import io
    import zipfile

    import pyarrow as pa

    for b in batches:
        out = []
        for members in b.column(1).to_pylist():
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                for m in members:
                    z.writestr(m["path"], m["text"])
            out.append(data.getvalue())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["book", "content"])


def second_edition(spark, sf):
    """Archives of the older kind for every customer: titles in an NCX (some chapters have none there), the cover by a meta element,
    by its own property, by its name, or none, by turns."""
    n = F.col("book")
    k = n.cast("string")
    metas = F.when(n % 4 == 0, '<meta name="cover" content="pic"/>').otherwise("")
    pictures = F.when(n % 4 == 0, '<item id="pic" href="img/p.jpg" media-type="image/jpeg"/><item id="cover-b" href="img/b.png" media-type="image/png"/>').when(n % 4 == 1, '<item id="a" href="img/a.png" media-type="image/png" properties="cover-image"/>').when(n % 4 == 2, '<item id="z" href="img/The%20Cover.gif" media-type="image/gif"/>').otherwise('<item id="q" href="img/q.png" media-type="image/png"/>')
    files = {
        "META-INF/container.xml": F.lit('<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>'),
        "c.opf": F.concat(F.lit("<package><metadata>"), metas, F.lit('</metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="c1" href="a%201.html" media-type="application/xhtml+xml"/><item id="c2" href="b.html" media-type="text/html"/><item id="css" href="s.css" media-type="text/css"/>'), pictures, F.lit('</manifest><spine toc="ncx"><itemref idref="c1"/><itemref idref="css"/><itemref idref="c2"/><itemref idref="c1"/></spine></package>')),
        "toc.ncx": F.concat(F.lit("<ncx><navMap><navPoint><navLabel><text> Part &amp; "), k, F.lit('</text></navLabel><content src="a%201.html#top"/></navPoint>'), F.when(n % 3 == 0, '<navPoint><navLabel><text>End</text></navLabel><content src="b.html"/></navPoint>').otherwise(""), F.lit("</navMap></ncx>")),
        "a 1.html": F.lit("<html><body><p>one</p></body></html>"),
        "b.html": F.concat(F.lit("<html><body>"), F.when(n % 3 == 1, "<h3>Own <b>title</b></h3>").otherwise(""), F.lit("<p>two</p></body></html>")),
    }
    packed = F.array(*(F.struct(F.lit(p).alias("path"), t.alias("text")) for p, t in files.items()))
    return epub.stored_files(_spread(spark, table(spark, sf, "customer").select(F.col("c_custkey").alias("book")), "book").select("book", packed.alias("files")).mapInArrow(_zipped, "book long, content binary"))


def j04_ncx(spark, sf):
    return epub.chapters(second_edition(spark, sf)).select("book", "idx", "path", "title")


def j04_cover(spark, sf):
    packs = stores.checkpointed(epub.packages(second_edition(spark, sf)))  # read by manifest and cover
    return epub.cover(packs, epub.manifest(packs)).select("book", "path")


def s15_defaults(spark, sf):
    """One namespace's sources become the defaults, which a new one then gets."""
    n = F.col("c_custkey")
    c = table(spark, sf, "customer").select(F.when(n % 3 == 0, "anna").otherwise("ben").alias("user_ns"), F.concat(F.lit("s"), (n % 40).cast("string")).alias("source_url")).distinct()
    return catalogs.copy_defaults(catalogs.set_defaults(c, "anna"), "new")


def s08(spark, sf):
    """An archive for each supplier, written by Spark tasks, then read back as chapters."""
    k = F.col("s_suppkey").cast("string")
    files = F.array(*(F.struct(F.lit(p).alias("path"), t.alias("text")) for p, t in {
        "META-INF/container.xml": F.lit('<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        "OPS/p.opf": F.concat(F.lit('<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book '), k, F.lit('</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c1" href="t/one.xhtml" media-type="application/xhtml+xml"/><item href="t/two%20.xhtml" id="c2" media-type="application/xhtml+xml"/><item id="c3" href="t/three.xhtml" media-type="text/html"/><item id="i" href="img/a.png" media-type="image/png" properties="cover-image"/><item id="s" href="x.css" media-type="text/css"/></manifest><spine><itemref idref="c2"/><itemref idref="c1"/><itemref idref="s"/><itemref idref="c2"/><itemref idref="c3"/></spine></package>')),
        "OPS/nav.xhtml": F.lit('<!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol><li><a href="t/one.xhtml#x"> One  &amp; all</a></li></ol></nav></body></html>'),
        "OPS/t/one.xhtml": F.concat(F.lit('<html><head><title>no</title><style>p{}</style></head><body><p class="a">Text '), k, F.lit('</p><script>x()</script><img alt="" src="../img/a.png"/><img src="gone.png"/><font>f</font><br/></body></html>')),
        "OPS/t/two .xhtml": F.lit("<html><body><h2>Two <i>x</i></h2></body></html>"),
        "OPS/t/three.xhtml": F.lit("<html><body><p>three</p></body></html>"),
        "OPS/img/a.png": F.lit("png"),
        "../evil": F.lit("no"),
    }.items()))

    archives = _spread(spark, table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select(F.col("s_suppkey").alias("book"), files.alias("files")).mapInArrow(_zipped, "book long, content binary")
    members = epub.stored_files(archives)
    c = epub.chapters(members)
    assets = F.create_map(F.lit("OPS/img/a.png"), F.lit("/assets/a.png"))
    return c.select("book", "idx", "path", "title", "n_chars", epub.clean_markup(F.col("markup"), assets, F.regexp_extract("path", "^(.*/)[^/]*$", 1)).alias("markup"))


RULES = ["/s?q={{key}}&p=<1,2>", '/p , {"method":"post","body":"a=1","retry":"x","headers":{"User-Agent":"me","X":"1","proxy":"p:1"},"webView":"false"}', '/g,{"charset":" gbk ","retry":"5","headers":"{\\"x\\":\\"9\\"}","webView":true,"webViewDelayTime":-5}', "/plain"]


def u06(spark, sf):
    rule = _nth(RULES, F.col("s_suppkey"))
    o = U.request_options(U.split_options(rule)[1], F.lit('{"x":"0","Accept":"a"}'))
    rows = table(spark, sf, "supplier").select("s_suppkey", o.alias("o"))
    head = lambda n: F.try_element_at("o.headers", F.lit(n)).alias(f"h_{n.replace('-', '_')}")
    return rows.select("s_suppkey", "o.method", "o.charset", "o.body", "o.retry", "o.proxy", "o.web_view", "o.delay", head("x"), head("user-agent"), head("accept"))


LINKS = ["", "javascript:x()", "data:text/plain,a", "//c.org/z", "/r", "q?x=1", "?y=2", "http://o/", '/opt , {"method":"POST"}', "../up"]


def u02(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", U.absolute(_nth(LINKS, k), F.concat(F.lit("http://h/a/b"), k.cast("string"), F.lit("?q=1#f"))).alias("url"))


def u07(spark, sf):
    return table(spark, sf, "part").select("p_partkey", U.encode_query(F.concat(F.lit("q="), "p_name", F.lit("&中="), _nth(["a b", "c*~", "x%20", "é"], F.col("p_partkey")))).alias("query"))


BODIES = ["a=1 2&b", '{"j":1}', " <x/>", "a=%20", "k=é*&é", "x=~"]


def u08(spark, sf):
    n = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", U.form_body(_nth(BODIES, n), _nth([None, "escape"], F.floor(n / 6)), F.floor(n / 12) % 5 == 0).alias("body"))


def u09(spark, sf):
    raw = _nth([" http://a/b\u0007c ", "http%3A//x%3Fa%3D1%26b%23c", "http://x?a%3D1", "plain"], F.col("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", U.normalise(raw).alias("plain"), U.repair(raw).alias("repaired"))


def u26(spark, sf):
    v = F.try_parse_json(_nth(['{"v":"t"}', '{"v":12}', '{"v":1.5}', '{"v":true}', '{"v":[1,"b",null]}', '{"v":{"a":1}}', '{"v":null}', "{}"], F.col("event_id")))
    return table(spark, sf, "events").select("event_id", X.json_text(F.try_variant_get(v, "$.v", "variant")).alias("text"))


def toc_edges(spark, sf):
    """Page chains of 150 (one next link each), a hub of several pages, and a cycle, by supplier."""
    rows = table(spark, sf, "supplier").select("s_suppkey").join(F.broadcast(spark.range(150).select(F.col("id").cast("int").alias("i"))))
    page = lambda i: F.concat(F.lit("/"), F.col("s_suppkey").cast("string"), F.lit("/"), i.cast("string"))
    i, kind = F.col("i"), F.col("s_suppkey") % 3
    target = F.when((kind == 0) & (i < 149), page(i + 1)).when((kind == 1) & (i.between(1, 4)), page(i)).when((kind == 2) & (i < 3), page((i + 1) % 3))
    return rows.select("s_suppkey", F.when(kind == 1, page(F.lit(0))).otherwise(page(i)).alias("url"), target.alias("next_url"), i.alias("ix")).where("next_url is not null")


def g01(spark, sf):
    edges = toc_edges(spark, sf)
    start = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("book"), F.concat(F.lit("/"), F.col("s_suppkey").cast("string"), F.lit("/0")).alias("url"))
    return C.walk_pages(start, edges)


def g02(spark, sf):
    """Texts on one to four pages; the last page's next link is the next chapter or the page itself."""
    n = F.col("p_partkey")
    base = F.concat(F.lit("http://h/c"), n.cast("string"))
    url = lambda b, i: F.concat(b, F.when(i > 1, F.concat(F.lit("_"), i.cast("string"))).otherwise(""), F.lit(".html"))
    part = table(spark, sf, "part").select("p_partkey", base.alias("base"), F.explode(F.sequence(F.lit(1), (n % 4 + 1).cast("int"))).alias("i"))
    last = F.col("i") == F.col("p_partkey") % 4 + 1
    after = F.concat(F.lit("http://h/c"), (F.col("p_partkey") + 1).cast("string"), F.lit(".html"))
    pages = part.select(url(F.col("base"), F.col("i")).alias("url"), F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit("."), F.col("i").cast("string")).alias("content"), F.when(last, F.when(F.col("p_partkey") % 2 == 0, after).otherwise(url(F.col("base"), F.col("i")))).otherwise(url(F.col("base"), F.col("i") + 1)).alias("next_url"))
    chapters = part.where("i = 1").select(F.lit("b").alias("book"), url(F.col("base"), F.col("i")).alias("url"), after.alias("next_chapter"))
    return C.whole_content(pages, chapters).select("url", "content")


def _stream(spark, sf, build, mode: str, tag: str):
    """A stream over the events table, run until all of it is done, as a table."""
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, where = _folder(spark, tag), _folder(spark, f"{tag}-state")
    rows = build(source.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int")))
    if mode == "append":
        q = rows.writeStream.format("parquet").option("path", out)
    else:  # each batch replaces the last: the counts so far
        q = rows.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode("complete")
    q.option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def st1(spark, sf):
    return _stream(spark, sf, lambda e: streaming.first_seen_stream(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], delay="400 days"), "append", "st1").select("user_id", "event_type")


def st2(spark, sf):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "cached").otherwise("success")
    return _stream(spark, sf, lambda e: streaming.caching_counters(e.withColumn("o", outcome), "k", "o"), "complete", "st2")


def st3(spark, sf):
    store = stores.ContentStore(spark, _folder(spark, "st3"), keys=("user_id",))
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = source.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    rows.writeStream.foreachBatch(streaming.latest_into(store, ["user_id"], "ts")).option("checkpointLocation", _folder(spark, "st3-state")).trigger(availableNow=True).start().awaitTermination()
    return store.read().select("user_id", "event_id")


def st4(spark, sf):
    rows = _stream(spark, sf, lambda e: streaming.coalesced_progress(e.select("user_id", "ts", "event_id"), ["user_id"], interval="6 hours", delay="0 seconds"), "append", "st4")
    last = table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("_end"))  # windows after the watermark still wait
    return rows.crossJoin(F.broadcast(last)).where(F.col("window_start") + F.expr("interval 12 hours") <= F.col("_end")).select(F.unix_seconds("window_start").alias("at"), "user_id", "event_id")


def st5(spark, sf):
    feeds = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("o"), (F.col("event_id") % 3).cast("string")).alias("origin"), F.concat(F.lit("<rss><channel><item><title>t</title><link>l"), (F.col("user_id") % 20).cast("string"), F.lit("</link></item></channel></rss>")).alias("body"))
    path = _folder(spark, "feeds")
    feeds.write.parquet(path)
    out = _folder(spark, "st5")
    rows = streaming.new_articles(spark.readStream.schema(feeds.schema).parquet(path), delay="400 days")
    rows.select("origin", "link").writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "st5-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def st4_timers(spark, sf):
    """A user's saves, at most one in six hours, counted from the first."""
    timers.with_timers(spark)
    rows = _stream(spark, sf, lambda e: timers.coalesced_by_timer(e.select("user_id", "ts", "event_id"), ["user_id"], seconds=21_600, delay="0 seconds"), "append", "st4t")
    last = table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("_end"))  # intervals after the watermark still wait
    return rows.crossJoin(F.broadcast(last)).where(F.col("since") + F.expr("interval 7 hours") <= F.col("_end")).select("user_id", F.unix_micros("since").alias("since"), "event_id")


def st6(spark, sf):
    """Characters of chapters, a stream of files: it stops after each and goes on from its checkpoint; the third brings the first one's rows again."""
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("book"), (F.col("event_id") % 50).cast("int").alias("idx"), F.col("event_id").alias("ord"), F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string")).alias("name"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("status"))
    store = stores.ContentStore(spark, _folder(spark, "st6"), keys=("book", "key"))
    path, where = _folder(spark, "chapters"), _folder(spark, "st6-state")
    for some in (e.where("idx < 25"), e.where("idx >= 25"), e.where("idx < 25")):
        some.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(e.schema).parquet(path)
        stream.writeStream.foreachBatch(streaming.knowledge_into(store, K.merge_characters)).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    return store.read().select("book", "key", "status", "processed")


def st7(spark, sf):
    """Requests that come sooner than the least gap behind the one before them at the same source."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"))
    return S.too_soon(e, 60_000, "event_id").select("event_id", "too_soon")


def f01(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.col("role").alias("title"))
    return Q.with_hooks(c, title=(lambda i, t: F.concat(F.lpad((i + 1).cast("string"), 3, "0"), F.lit(" "), F.upper(t)), ["idx", "title"]))


def f02(spark, sf):
    Q.register(spark)
    return spark.sql("SELECT page_id, count_if(tag = 'li') AS n_li, max(attrs['lang']) AS lang FROM folio_shred_pages(TABLE(SELECT page_id, html FROM {p})) GROUP BY page_id", p=table(spark, sf, "pages"))


def f03(spark, sf):
    Q.register(spark)
    return spark.sql("SELECT page_id, folio_url_host(url) AS host, folio_root_label(folio_url_host(url)) AS label, folio_plain_length(html) AS n, folio_merge_key(' A ', NULL) AS k, folio_unread(5, 9) AS unread, folio_is_truthy('off') AS flag FROM {p}", p=table(spark, sf, "pages"))


def j03(spark, sf):
    """Scopes of all kinds: none, '*', a source, a book, a name, a name with a URL."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")).alias("url"))
    scopes = [(1, ""), (2, "*"), (3, "source:src1"), (4, "book:3"), (5, "de"), (6, "en;/d/4"), (7, "nobody"), (8, None), (9, "fr;")]
    rules = F.array(*(F.struct(F.lit(i).alias("place"), F.lit("x").alias("pattern"), F.lit("").alias("replacement"), F.lit(False).alias("is_regex"), F.lit(s).cast("string").alias("scope"), F.lit(True).alias("enabled")) for i, s in scopes))
    held = X.ordered_rules(rules, F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), F.col("url"))
    return d.select("doc_id", F.explode(F.transform(held, lambda r: r["place"])).alias("rule_id"))


QUERIES = {
    "s01_catalog_import": s01, "s03_legacy_catalog": s03, "s06_decode_bodies": s06, "s07_text_files": s07, "s08_epub_chapters": s08, "j04_ncx_titles": j04_ncx, "j04_covers": j04_cover, "s15_defaults": s15_defaults, "s09_feed_articles": s09, "s10_feed_sources": s10, "s11_content_store": s11, "s12_toc_store": s12, "s13_bundle": s13, "s14_recovery": s14, "s15_copy_sources": s15,
    "u02_absolute_url": u02, "u06_request_options": u06, "u07_encode_query": u07, "u08_form_body": u08, "u09_url_text": u09, "u26_json_text": u26, "g01_page_walk": g01, "g02_whole_content": g02,
    "st1_first_seen": st1, "st2_counters": st2, "st3_latest": st3, "st4_coalesced": st4, "st4_timers": st4_timers, "st5_new_articles": st5, "st6_knowledge": st6, "st7_least_gap": st7, "f01_hooks": f01, "f02_shred_table": f02, "f03_sql_functions": f03, "j03_all_scopes": j03,
}

_H = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
SQL = {
    "s01_catalog_import": """SELECT s_suppkey, pos, CASE pos WHEN 0 THEN 'u' ELSE 'n' END || s_suppkey AS url, CASE pos WHEN 1 THEN s_suppkey END AS custom_order, CASE pos WHEN 1 THEN 'x' END AS book_list, CAST(NULL AS VARCHAR) AS toc FROM supplier, (VALUES (0), (1)) v(pos) WHERE s_suppkey % 4 < 3""",
    "s03_legacy_catalog": """SELECT s_suppkey, 0 AS pos, 'u' || s_suppkey AS url, CAST(s_suppkey AS VARCHAR) AS custom_order, '1' AS kind, '{"User-Agent":"ua"}' AS header, 'true' AS enabled, '/s?q={{key}}&p=<1,2>,{"charset":"gbk"}' AS search_url, '/toc' AS toc_url, CAST(NULL AS VARCHAR) AS chapter_url, 'id.c' AS content,
  'tag.li' AS "search_bookList", 'a@href' AS "search_bookUrl", CAST(NULL AS VARCHAR) AS search_name FROM supplier WHERE s_suppkey % 4 < 3
 UNION ALL SELECT s_suppkey, 1, 'n' || s_suppkey, CAST(s_suppkey AS VARCHAR), NULL, 'h', NULL, '/p,{"body":"q=searchKey","headers":{"A":"b"},"method":"POST"}', NULL, NULL, NULL, 'x', NULL, NULL FROM supplier WHERE s_suppkey % 4 < 3""",
    "s06_decode_bodies": """SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN '<?xml version="1.0" encoding="UTF-8"?>é' WHEN 3 THEN '<meta charset="gb2312">书' ELSE '书' END || p_partkey AS text,
 lower(CASE p_partkey % 4 WHEN 0 THEN 'E4B9A6' WHEN 1 THEN 'CAE9' WHEN 2 THEN 'E9' ELSE hex('<meta charset="gb2312">') || 'CAE9' END || hex(CAST(p_partkey AS VARCHAR))) AS digits FROM part""",
    "s07_text_files": "SELECT '/in/b' || s_suppkey || '.txt' AS path, 'b' || s_suppkey AS title, '章' || s_suppkey AS text, md5('default:b' || s_suppkey || '.txt:' || md5('章' || s_suppkey)) AS book_id, CAST(length('章' || s_suppkey) AS INT) AS n_chars FROM supplier",
    "s08_epub_chapters": """SELECT s_suppkey AS book, i AS idx, CASE i WHEN 0 THEN 'OPS/t/two .xhtml' WHEN 1 THEN 'OPS/t/one.xhtml' ELSE 'OPS/t/three.xhtml' END AS path, CASE i WHEN 0 THEN 'Two x' WHEN 1 THEN 'One &amp; all' ELSE '第 3 章' END AS title,
 CAST(CASE i WHEN 0 THEN 4 WHEN 1 THEN 2 + 3 + 4 + length(CAST(s_suppkey AS VARCHAR)) + 3 + 1 ELSE 5 END AS INT) AS n_chars, CASE i WHEN 0 THEN '<h2>Two <i>x</i></h2>' WHEN 1 THEN '<p>Text ' || s_suppkey || '</p><img src="/assets/a.png">f<br/>' ELSE '<p>three</p>' END AS markup FROM supplier, (VALUES (0), (1), (2)) v(i)""",
    "j04_ncx_titles": "SELECT c_custkey AS book, i AS idx, ['a 1.html', 'b.html'][i + 1] AS path, CASE WHEN i = 0 THEN 'Part &amp; ' || c_custkey WHEN c_custkey % 3 = 0 THEN 'End' WHEN c_custkey % 3 = 1 THEN 'Own title' ELSE '第 2 章' END AS title FROM customer, (VALUES (0), (1)) v(i)",
    "j04_covers": "SELECT c_custkey AS book, ['img/p.jpg', 'img/a.png', 'img/The Cover.gif'][c_custkey % 4 + 1] AS path FROM customer WHERE c_custkey % 4 < 3",
    "s15_defaults": """WITH c AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'anna' ELSE 'ben' END AS user_ns, 's' || (c_custkey % 40) AS source_url FROM customer)
 SELECT * FROM c UNION ALL SELECT n, source_url FROM c, (VALUES ('__default__'), ('new')) v(n) WHERE user_ns = 'anna'""",
    "s09_feed_articles": """SELECT CAST(s_suppkey AS VARCHAR) AS origin, 0 AS pos, 'A' || s_suppkey AS title, 'http://a/' || s_suppkey AS link, 'd' AS description, 'full' AS content, 'i.png' AS image, 1704164645 AS ord FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 1, 'B', 'http://b', NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 0, 'E' || s_suppkey, 'http://e/' || s_suppkey, 's', NULL, NULL, 1704164645 FROM supplier WHERE s_suppkey % 3 = 1""",
    "s10_feed_sources": "SELECT s_suppkey, 0 AS pos, 'f' || s_suppkey AS url FROM supplier",
    "s11_content_store": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'again' ELSE md5(text) END AS content FROM documents WHERE doc_id % 7 <> 0",
    "s12_toc_store": "SELECT 't' || conv_id AS toc_url, CAST(turn AS INT) AS idx, role FROM conversations WHERE conv_id % 10 <> 3",
    "s13_bundle": "SELECT '/o/' || o_orderkey AS book_url, o_totalprice, CAST(o_orderdate AS VARCHAR) AS day FROM orders",
    "s14_recovery": "SELECT '/o/' || o_orderkey AS book_url, 'w' AS origin, '1' AS z FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT '/p/' || o_orderkey, 'v', NULL FROM orders WHERE o_orderkey % 3 = 1",
    "s15_copy_sources": """WITH c AS (SELECT DISTINCT ['default', 'anna'][c_custkey // 2 % 2 + 1] AS user_ns, 's' || (c_custkey - c_custkey % 3) AS source_url FROM customer), d AS (SELECT source_url FROM c WHERE user_ns = 'default')
 SELECT user_ns, source_url, user_ns || ':' || source_url AS name FROM c WHERE user_ns = 'default' OR source_url NOT IN (SELECT source_url FROM d) UNION ALL SELECT 'anna', source_url, 'default:' || source_url FROM d""",
    "u02_absolute_url": """WITH b AS (SELECT s_suppkey, s_suppkey % 10 AS i, 'http://h/a/b' || s_suppkey AS b FROM supplier)
 SELECT s_suppkey, CASE i WHEN 0 THEN b || '?q=1#f' WHEN 1 THEN '' WHEN 2 THEN 'data:text/plain,a' WHEN 3 THEN 'https://c.org/z' WHEN 4 THEN 'http://h/r' WHEN 5 THEN 'http://h/a/q?x=1' WHEN 6 THEN b || '?y=2' WHEN 7 THEN 'http://o/' WHEN 8 THEN 'http://h/opt' ELSE 'http://h/up' END AS url FROM b""",
    "u06_request_options": """WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS i FROM supplier) SELECT s_suppkey, CASE i WHEN 1 THEN 'POST' ELSE 'GET' END AS method, CASE i WHEN 2 THEN 'gbk' END AS charset, CASE i WHEN 1 THEN 'a=1' END AS body, CAST(CASE i WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE 2 END AS INT) AS retry,
 CASE i WHEN 1 THEN 'p:1' END AS proxy, i = 2 AS web_view, CAST(0 AS BIGINT) AS delay, CASE i WHEN 1 THEN '1' WHEN 2 THEN '9' ELSE '0' END AS h_x, CASE i WHEN 1 THEN 'me' ELSE 'Mozilla/5.0' END AS h_user_agent, 'a' AS h_accept FROM s""",
    "u07_encode_query": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'q=' || p_name || '&中=x%20' ELSE 'q=' || url_encode(p_name) || '&' || url_encode('中') || '=' || CASE p_partkey % 4 WHEN 0 THEN 'a%20b' WHEN 1 THEN 'c%2A~' ELSE '%C3%A9' END END AS query FROM part""",
    "u08_form_body": f"""WITH p AS (SELECT p_partkey, p_partkey % 6 AS i, p_partkey // 6 % 2 = 1 AS esc, p_partkey // 12 % 5 = 0 AS typed FROM part)
 SELECT p_partkey, CASE WHEN typed OR i IN (1, 2, 3) THEN ['a=1 2&b', '{{"j":1}}', ' <x/>', 'a=%20', 'k=é*&é', 'x=~'][i + 1] WHEN esc THEN ['a=1%202&b', '', '', '', 'k=%E9*&%E9', 'x=%7E'][i + 1] ELSE ['a=1%202&b', '', '', '', 'k=%C3%A9%2A&%C3%A9', 'x=~'][i + 1] END AS body FROM p""",
    "u09_url_text": """SELECT s_suppkey, ['http://a/bc', 'http%3A//x%3Fa%3D1%26b%23c', 'http://x?a%3D1', 'plain'][s_suppkey % 4 + 1] AS plain, [' http://a/b' || chr(7) || 'c ', 'http%3A//x?a=1&b#c', 'http://x?a%3D1', 'plain'][s_suppkey % 4 + 1] AS repaired FROM supplier""",
    "u26_json_text": "SELECT event_id, ['t', '12', '1.5', 'true', '1' || chr(10) || 'b', '{\"a\":1}', NULL, NULL][event_id % 8 + 1] AS text FROM events",
    "g01_page_walk": """SELECT s_suppkey AS book, '/' || s_suppkey || '/' || i AS url, i AS page_ord FROM supplier, range(150) v(i) WHERE s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND i < 5) OR (s_suppkey % 3 = 2 AND i < 3)""",
    "g02_whole_content": "SELECT 'http://h/c' || p_partkey || '.html' AS url, (SELECT string_agg('t' || p_partkey || '.' || i, chr(10) ORDER BY i) FROM range(1, 5) v(i) WHERE i <= p_partkey % 4 + 1) AS content FROM part",
    "st1_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "st2_counters": "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count_if(event_type = 'purchase') AS cached, count_if(event_type NOT IN ('purchase', 'error')) AS success, count_if(event_type = 'error') AS failed FROM events GROUP BY 1",
    "st3_latest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1",
    "st4_coalesced": "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS \"at\", user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2 HAVING floor(epoch(min(ts)) / 21600) * 21600 + 43200 <= (SELECT epoch(max(ts)) FROM events)",
    "st4_timers": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), s AS (SELECT user_id, min(t) AS since FROM e GROUP BY 1
 UNION ALL SELECT s.user_id, (SELECT min(t) FROM e WHERE e.user_id = s.user_id AND t >= s.since + 21600000000) FROM s WHERE s.since IS NOT NULL)
 SELECT s.user_id, since, (SELECT arg_max(event_id, (t, event_id)) FROM e WHERE e.user_id = s.user_id AND t >= since AND t < since + 21600000000) AS event_id FROM s WHERE since + 25200000000 <= (SELECT max(t) FROM e)""",
    "st5_new_articles": "SELECT DISTINCT 'o' || (event_id % 3) AS origin, 'l' || (user_id % 20) AS link FROM events",
    "st6_knowledge": """WITH e AS (SELECT user_id % 10 AS book, event_id % 50 AS idx, event_id AS ord, 'n' || (event_id % 5) AS key, 's' || event_id AS status FROM events), m AS (SELECT book, max(idx) AS processed FROM e GROUP BY 1)
 SELECT e.book, key, arg_max(status, (idx >= 25, ord)) AS status, CAST(any_value(processed) AS INT) AS processed FROM e JOIN m USING (book) GROUP BY 1, 2""",
    "st7_least_gap": "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) < 60000000, false) AS too_soon FROM events",
    "f01_hooks": "SELECT conv_id, turn AS idx, lpad(CAST(turn + 1 AS VARCHAR), 3, '0') || ' ' || upper(role) AS title FROM conversations",
    "f02_shred_table": "SELECT page_id, len(regexp_extract_all(html, '<li[ >]')) AS n_li, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages",
    "f03_sql_functions": f"SELECT page_id, {_H} AS host, string_split({_H}, '.')[-2] AS label, CAST(length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', '', 'g')) AS INT) AS n, 'a|' AS k, 0 AS unread, false AS flag FROM pages",
    "j03_all_scopes": """SELECT doc_id, r AS rule_id FROM documents, (VALUES (1), (2), (8)) v(r) UNION ALL SELECT doc_id, 3 FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, 4 FROM documents WHERE doc_id = 3 UNION ALL SELECT doc_id, 5 FROM documents WHERE lang = 'de'
 UNION ALL SELECT doc_id, 6 FROM documents WHERE lang = 'en' AND doc_id = 4 UNION ALL SELECT doc_id, 9 FROM documents WHERE lang = 'fr'""",
}
