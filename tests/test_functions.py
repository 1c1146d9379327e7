"""Column functions and rules on small inputs."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from folio_spark.functions import text as X
from folio_spark.functions import urls as U
from folio_spark.operators import chapters, rules, shelf
from folio_spark.operators.shred import shred, shred_page, trees
from folio_spark.sources import stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_written_numbers(spark):
    for s, n in (("12", 12), ("十", 10), ("十二", 12), ("二十", 20), ("一百零五", 105), ("一千二百三十四", 1234), ("三万零二", 30002), ("两千", 2000), ("x", None), ("", None)):
        assert one(spark, X.written_number(F.lit(s))) == n, s
    for t, n in (("第十二章 开始", 12), ("第3回", 3), ("Chapter 7", 7), ("12 Up", 12), ("序章", None)):
        assert one(spark, X.chapter_ordinal(F.lit(t))) == n, t


def test_groups_and_flags(spark):
    assert one(spark, X.split_groups(F.lit("a, b;；c、a,,"))) == ["a", "b", "c"]
    assert one(spark, X.mark_group(F.lit("bad"), "bad", False)) is None
    assert one(spark, X.mark_group(F.lit(None).cast("string"), "bad", True)) == "bad"
    for s, want in (("", False), ("0", False), ("False", False), ("none", False), ("off", False), ("1", True), ("VIP", True), ("not", True), (None, False)):
        assert one(spark, X.is_truthy(F.lit(s).cast("string"))) is want, s


def test_in_context_and_chunks(spark):
    got = one(spark, X.in_context(F.lit("The cat  and the CAT sat"), "cat", around=4))
    assert [(r["place"], r["at"], r["snippet"]) for r in got] == [(1, 4, "The cat and…"), (2, 16, "…the CAT sat")]
    parts = one(spark, X.chunks(F.lit("One two. Three four five! " + "x" * 25), 20))
    assert all(len(p) <= 20 for p in parts) and "".join(parts).replace(" ", "") == "Onetwo.Threefourfive!" + "x" * 25


def test_replace_rules_in_order(spark):
    r = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(q).alias("replacement"), F.lit(x).alias("is_regex")) for p, q, x in (("^a", "b", True), ("b.", "c", False))))
    assert one(spark, X.replace_rules(F.lit("a.\nab."), r)) == "c\nbc"


@pytest.mark.parametrize(
    ("link", "want"),
    [("", "https://h.com/a/b?q=1"), ("c", "https://h.com/a/c"), ("/c", "https://h.com/c"), ("//x.org/y", "https://x.org/y"), ("../c/./d", "https://h.com/c/d"), ("?p=2", "https://h.com/a/b?p=2"), ("http://z/", "http://z/"), ("../../../e", "https://h.com/e")],
)
def test_resolve(spark, link, want):
    assert one(spark, U.resolve(F.lit(link), F.lit("https://h.com/a/b?q=1#f"))) == want


def test_request_rules(spark):
    url, options = U.split_options(F.lit('/s?q={{key}}&p=<1,2,9> , {"method":"POST"}'))
    assert one(spark, url) == "/s?q={{key}}&p=<1,2,9>" and one(spark, options) == '{"method":"POST"}'
    filled = U.page_choice(U.fill_placeholders(url, F.lit("k v"), F.lit(5)), F.lit(5))
    assert one(spark, filled) == "/s?q=k v&p=9"
    assert one(spark, U.page_choice(F.lit("<a,b>/<x,y>"), F.lit(1))) == "a/x"
    assert one(spark, U.encode_query(F.lit("q=a b*~&中=é"))) == "q=a%20b%2A~&%E4%B8%AD=%C3%A9"
    assert one(spark, U.encode_query(F.lit("q=%20x y"))) == "q=%20x y"
    assert one(spark, U.continues(F.lit("http://a/c_2.html"), F.lit("http://a/c.html"), F.lit("http://a/d.html"))) is True
    assert one(spark, U.continues(F.lit("http://a/c_1.html"), F.lit("http://a/c.html"), F.lit(None).cast("string"))) is False


PAGE = """<html><body><h1>Top</h1><ul class="list big" id=main><li><a href="/1">One</a><span>A</span><li><a href="/2">Two &amp; more</a><li><b>Three</ul>
<div class=list><p>x<p>y<br>z</div><script>var a = "<li>";</script></body></html>"""


def picked(spark, rule, html=PAGE):
    pages = trees(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string"))
    return [r["value"] for r in rules.values(pages, rule).orderBy("page_id", "place").collect()]


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("tag.li@tag.a@text", ["One", "Two & more"]),
        ("class.list@tag.a@href", ["/1", "/2"]),
        ("class.list big@tag.li.-1@text", ["Three"]),
        ("#main@children@text", ["One A", "Two & more", "Three"]),
        ("id.main@tag.li!0@text", ["Two & more", "Three"]),
        ("tag.li[2,0]@text", ["Three", "One A"]),
        ("tag.li[-1:0]@text", ["Three", "Two & more", "One A"]),
        ("tag.li[0:9:2]@text", ["One A", "Three"]),
        ("tag.h2@text||tag.h1@text", ["Top"]),
        ("tag.h1@text&&tag.p@text", ["Top", "x", "y z"]),
        ("tag.a@text%%tag.a@href", ["One", "/1", "Two & more", "/2"]),
        ("[href=/2]@text", ["Two & more"]),
        ("tag.a@href##^/##p", ["p1", "p2"]),
        ("tag.ul@id", ["main"]),
        ("tag.li.0@tag.a@ownText", ["One"]),
        ("tag.nothing@text", []),
    ],
)
def test_rules(spark, rule, want):
    assert picked(spark, rule) == want


def test_unsupported_rules_are_named(spark):
    pages = trees(spark.createDataFrame([(1, PAGE)], "page_id int, html string"))
    for rule in ("<js>x</js>@text", "tag.a@text##(?=x)##", "a > b@text", "tag.a@{{x}}"):
        with pytest.raises(rules.UnsupportedRule):
            rules.values(pages, rule)


def test_source_text_of_elements_and_pages_in_pages(spark):
    assert picked(spark, "tag.a@html") == ['<a href="/1">One</a>', '<a href="/2">Two &amp; more</a>']
    assert picked(spark, "tag.li.1@all") == ['<li><a href="/2">Two &amp; more</a>']
    assert picked(spark, "tag.ul@html@@tag.li@tag.a@text") == ["One", "Two & more"]
    assert picked(spark, "tag.ul@html&&tag.div@html@@tag.b@text") == ["Three"]
    assert picked(spark, "tag.ul@textNodes") == ["One\nA\nTwo & more\nThree"]
    assert picked(spark, "tag.a@text##o##0###") == ["One", "Tw0 & more"]
    assert picked(spark, "text.Two@href") == ["/2"]


def test_rules_need_no_join_and_one_reading(spark):
    pages = trees(spark.createDataFrame([(1, PAGE)], "page_id int, html string"))
    listed = rules.listing(pages, "class.list@tag.li", {"name": "tag.a@text", "link": "tag.a@href", "more": "tag.span@text||tag.b@text"})
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan and "Window" not in plan
    assert [tuple(r) for r in listed.collect()] == [(1, 0, "One", "/1", "A"), (1, 1, "Two & more", "/2", None), (1, 2, None, None, "Three")]


def test_elements_nest():
    rows, runs = shred_page(PAGE)
    for i, r in enumerate(rows):
        assert r[0] >= i and r[1] < i and (r[1] < 0 or rows[r[1]][0] >= r[0])
        assert r[8] <= r[9] and PAGE[r[8] :].startswith("<" + r[4])
    assert [t for _, shown, t in runs if not shown] == ['var a = "<li>";']


@pytest.mark.parametrize("piece", ["<b>", "</i>", "<![foo[", "<!", "<!--", "<a ", '<a x="', "</", "<p><select>", "<li>", "<![CDATA[", "<?", "&", "a<", "<td><tr>"])
def test_hostile_pages(piece):
    import time

    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        for tail in ("", ">", "</b>" * n):
            shred_page(piece * n + tail)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_chapters_rebuild_the_text(spark):
    text = "intro\n第一章 A\nbody\n\nChapter 2\n第3章\nlast"
    rows = chapters.split_chapters(spark.createDataFrame([(1, text), (2, "no heading"), (3, None)], "doc_id int, text string")).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["idx"], r["title"], r["content"], r["char_start"]) for r in rows] == [(1, 0, "序章", "intro", 0), (1, 1, "第一章 A", "body\n", 6), (1, 2, "Chapter 2", "", 18), (1, 3, "第3章", "last", 28), (2, 0, "正文", "no heading", 0)]


def test_walk_stops_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "url string, next_url string")
    start = spark.createDataFrame([("1", "a"), ("2", "x")], "book string, url string")
    got = {(r["book"], r["url"], r["page_ord"]) for r in chapters.walk_pages(start, edges).collect()}
    assert got == {("1", "a", 0), ("1", "b", 1), ("1", "c", 2), ("2", "x", 0), ("2", "y", 1)}
    parts = spark.createDataFrame([("1", 1, "two"), ("1", 0, "one")], "book string, page_ord int, content string")
    assert chapters.stitch(parts).first()["content"] == "one\ntwo"


def test_upsert_falls_back(spark):
    old = spark.createDataFrame([("a", "n", "k"), ("b", "m", "l")], "book_url string, name string, kind string")
    new = spark.createDataFrame([("a", "N", None), ("c", "x", None)], "book_url string, name string, kind string")
    got = {tuple(r) for r in shelf.upsert(old, new, ["book_url"], keep=("kind",)).collect()}
    assert got == {("a", "N", "k"), ("b", "m", "l"), ("c", "x", None)}


def test_content_store(spark, tmp_path):
    store = stores.ContentStore(spark, f"file://{tmp_path}/s")
    rows = lambda *v: stores.with_keys(spark.createDataFrame(list(v), "book_url string, chapter_url string, content string"))
    assert store.read() is None
    store.put(rows(("a", "1", "x"), ("a", "2", "y")))
    store.put(rows(("a", "2", "z"), ("b", "1", "w")))
    assert {(r["book_url"], r["chapter_url"], r["content"]) for r in store.read().collect()} == {("a", "1", "x"), ("a", "2", "z"), ("b", "1", "w")}
    store.remove(rows(("a", "1", "")).select("book_key"))
    assert [r["content"] for r in store.read().collect()] == ["w"]
    assert store.exists(rows(("a", "1", ""), ("b", "1", ""))).count() == 1


def test_bundle_round_trip(spark, tmp_path):
    books = spark.createDataFrame([("u", 1)], "book_url string, n int")
    stores.export_bundle({"books": books, "rules": spark.createDataFrame([("p",)], "pattern string")}, f"file://{tmp_path}/b")
    back = stores.restore_bundle(spark, f"file://{tmp_path}/b")
    assert back["books"].collect() == books.collect() and set(back) == {"books", "rules"}
    stores.export_bundle({"books": books.drop("book_url")}, f"file://{tmp_path}/c")
    with pytest.raises(ValueError, match="book_url"):
        stores.restore_bundle(spark, f"file://{tmp_path}/c")


def test_listing_modes(spark):
    from folio_spark.operators import extract

    html = '<ul><li><a href="/1">A</a></li><li><a href="/2">B</a></li></ul>'
    js = '{"data":[{"n":"A","u":"/1"},{"n":"B","u":"/2"}]}'
    want = {"css": [("A", "/1"), ("B", "/2")]}
    for body, rule, fields in (
        (html, "tag.li", {"name": "tag.a@text", "link": "tag.a@href"}),
        (html, ':<a href="([^"]*)">([^<]*)</a>', {"name": "$2", "link": "$1"}),
        (html, "//li", {"name": "a/text()", "link": "a/@href"}),
        (js, "$.data", {"name": "$.n", "link": "u"}),
    ):
        pages = spark.createDataFrame([(1, body), (2, None)], "page_id int, html string")
        for sign, order in (("", 1), ("-", -1)):
            rows = extract.listing(pages, sign + rule, fields).orderBy("page_id", "item_ix").collect()
            assert [(r["name"], r["link"]) for r in rows] == want["css"][::order], (rule, sign)
    broken = spark.createDataFrame([(1, "<ul><li>")], "page_id int, html string")
    assert extract.listing(broken, "//li", {"name": "text()"}).count() == 0
    with pytest.raises(rules.UnsupportedRule):
        extract.listing(broken, "$..x[?(@.a)]", {"name": "$.n"})


def test_search_over_sources(spark):
    from folio_spark.operators import extract

    pages = spark.createDataFrame(
        [(1, "s1", "http://s1.com/list", "<ul><li><a href='b1'>One</a></li><li><a href='/b2'>Two</a></li></ul>"), (2, "s2", "http://s2.com/x", "<div><a href='/d'>Detail</a></div>"), (3, "s3", "http://s3.com/", '{"l":[{"n":"J","u":"/j"}]}')],
        "page_id int, source_url string, url string, html string",
    )
    css = {"list": "tag.li", "fields": {"name": "tag.a@text", "book_url": "tag.a@href"}}
    rows = extract.search(pages, [{"source_url": "s1", "source_ord": 0, **css}, {"source_url": "s2", "source_ord": 1, **css}, {"source_url": "s3", "source_ord": 2, "list": "$.l", "fields": {"name": "$.n", "book_url": "$.u"}}])
    got = {(r["source_ord"], r["item_ix"], r["name"], r["book_url"]) for r in rows.collect()}
    assert got == {(0, 0, "One", "http://s1.com/b1"), (0, 1, "Two", "http://s1.com/b2"), (1, 0, "Detail", "http://s2.com/d"), (2, 0, "J", "http://s3.com/j")}


def test_long_texts_take_time_in_proportion(spark):
    """A megabyte with 50,000 places of a word, a sentence of as much, and as many sentences."""
    texts = [("words", "hit word " * 50_000 + "end " * 100_000), ("sentence", "word, " * 170_000), ("bare", "x" * 1_000_000), ("sentences", "short one! " * 90_000)]
    df = spark.createDataFrame(texts, "k string, t string")
    began = time.time()
    got = {r["k"]: r for r in df.select("k", X.in_context(F.col("t"), "hit").alias("hits"), X.chunks(F.col("t")).alias("chunks")).collect()}
    assert time.time() - began < 60
    assert [h["at"] for h in got["words"]["hits"]] == list(range(0, 450_000, 9)) and got["words"]["hits"][1]["snippet"] == "hit word hit word hit word hit…"
    assert "".join(got["bare"]["chunks"]) == "x" * 1_000_000 and max(map(len, got["sentence"]["chunks"])) <= 70
    assert "".join(got["sentences"]["chunks"]).replace(" ", "") == ("short one! " * 90_000).replace(" ", "")


def test_parts_of_texts(spark):
    text = "".join(chr(97 + i % 26) for i in range(3 * X.PIECE + 7))
    df = spark.createDataFrame([(lo, n) for lo in (0, 1, X.PIECE - 1, X.PIECE, 2 * X.PIECE - 3, 3 * X.PIECE) for n in (0, 1, 6, X.PIECE + 1)], "lo int, n int").withColumn("t", F.lit(text))
    for r in df.select("lo", "n", X.let(X.in_pieces(F.col("t")), lambda p: X.part(p, F.col("lo"), F.col("n"))).alias("got")).collect():
        assert r["got"] == text[r["lo"] : r["lo"] + r["n"]]
    sums = spark.range(1).select(X.starts(F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: i.cast("int"))).alias("s")).first()["s"]
    assert sums == [i * (i - 1) // 2 for i in range(2001)]


def selected(html, rule):
    """What a rule of one chain selects, by walking every element."""
    nodes, runs = shred_page(html)
    *steps, take = rule.split("@")
    now = [-1]
    for text in steps:
        s, out = rules.parse_step(text), []
        for i in now:
            below = range(i + 1, (len(nodes) if i < 0 else nodes[i][0] + 1))
            match = {"tag": lambda k: nodes[k][4] == s.value, "class": lambda k: s.value in nodes[k][5].get("class", "").split(), "children": lambda k: nodes[k][1] == i}[s.kind]  # noqa: B023
            found, at = [k for k in below if match(k)], []
            n = len(found)
            for p in s.picks:
                if isinstance(p, tuple):
                    a, b = (max(0, min(n - 1, x + n if x < 0 else x)) for x in (p[0] if p[0] is not None else 0, p[1] if p[1] is not None else -1))
                    at += [] if not n else range(a, b + 1, p[2]) if a <= b else range(a, b - 1, -p[2])
                else:
                    at.append(p + n if p < 0 else p)
            at = list(dict.fromkeys(at))
            out += (found if not s.picks else [x for j, x in enumerate(found) if j not in at] if s.exclude else [found[j] for j in at if 0 <= j < n])
        now = list(dict.fromkeys(out))
    return [v for k in now if (v := nodes[k][5].get(take))]


def test_steps_and_programs_by_walking(spark):
    """Random pages of nested elements: compiled rules and rules as data against a walk over every element."""
    from folio_spark.operators import programs

    r = random.Random(6)

    def page(depth):
        out = []
        for _ in range(r.randrange(1, 4)):
            tag = r.choice(["div", "span", "ul"])
            out.append(f'<{tag} class="{r.choice(["a", "b", "a b", ""])}" id=n{r.randrange(10**6)}>{page(depth - 1) if depth else "t"}</{tag}>')
        return "".join(out)

    pages = [page(r.randrange(1, 6)) for _ in range(25)]
    chains = ["tag.div@tag.div@id", "tag.div@class.a@tag.span@id", "children@children@tag.div@id", "tag.div@children@class.b@id", "tag.div@tag.span.0@id", "class.a@tag.div.-1@id", "tag.div@children.-1@tag.span[0:1]@id", "class.a[-1:0]@class.b@id", "tag.span!0@class.a!-1@id", "class.a@class.b[1,0]@id", "tag.ul@children@children!0@id"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    trees_ = trees(df)
    catalog = spark.createDataFrame([(c, {"value": c}) for c in chains], "source_url string, r map<string,string>")
    compiled = programs.compiled(catalog, None, "r", ("value",))
    read = programs.read(df.crossJoin(catalog.select("source_url")), compiled)
    by_data = {(x["page_id"], x["source_url"]): x["v"] for x in read.select("page_id", "source_url", programs.strings(F.get("fields", F.lit(0)), F.lit(-1)).alias("v")).collect()}
    for c in chains:
        by_plan = {x["page_id"]: x["v"] for x in trees_.select("page_id", rules.strings(c, F.lit(-1)).alias("v")).collect()}
        for i, html in enumerate(pages):
            want = selected(html, c)
            assert by_plan[i] == want, (c, html)
            assert by_data[i, c] == want, (c, html)


def test_nested_elements_take_time_in_proportion(spark):
    n = 20_000
    pages = trees(spark.createDataFrame([(1, "<div>" * n + "<a>x</a><a>y</a>" + "</div>" * n)], "page_id int, html string"))
    began = time.time()
    for rule, want in (("tag.div@tag.div@tag.a@text", ["x", "y"]), ("tag.div@tag.div@tag.a.0@text", ["x"]), ("tag.div@children@tag.a.-1@text", ["y"])):
        assert [r["value"] for r in rules.values(pages, rule).collect()] == want
    assert time.time() - began < 60


def test_programs_that_are_none_say_so(spark):
    from folio_spark.operators import extract, programs

    rows = [("ok", "tag.li", {"name": "tag.a@text"}), ("script", "<js>x</js>", {"name": "a"}), ("xpath", "//li", {"name": "text()"}), ("put", "tag.li", {"name": "@put:{a:tag.a@text}"}), ("look", ":(?=x)", {"name": "$1"}), ("empty", None, None)]
    got = {r["source_url"]: r["error"] for r in programs.compiled(spark.createDataFrame(rows, "source_url string, list string, fields map<string,string>"), "list", "fields").collect()}
    assert {k for k, v in got.items() if v} == {"script", "xpath", "put", "look"}
    pages = spark.createDataFrame([(1, "ok", "http://h/", "<li><a>A</a></li>"), (2, "xpath", "http://h/", "<li/>"), (3, "empty", "http://h/", "x"), (4, None, "http://h/", None), (5, "ok", "http://h/", None)], "page_id int, source_url string, url string, html string")
    listed = programs.search(pages, programs.compiled(spark.createDataFrame(rows, "source_url string, list string, fields map<string,string>"), "list", "fields"))
    assert [(r["page_id"], r["name"], r["book_url"], r["author"]) for r in listed.collect()] == [(1, "A", "http://h/", None)]
    js = '{"data":[{"n":"A","u":["/1","/2"]},{"n":"B"}]}'
    for rule, fields in (("$.data", {"name": "$.n", "kind": "u"}), ("data", {"name": "n##A##Z", "kind": "$.u[*]"})):
        one = [(1, "s", "http://h/", js)]
        mine = programs.search(spark.createDataFrame(one, "page_id int, source_url string, url string, html string"), programs.compiled(spark.createDataFrame([("s", rule, fields)], "source_url string, list string, fields map<string,string>"), "list", "fields")).collect()
        same = extract.listing(spark.createDataFrame([(1, js)], "page_id int, html string"), rule, fields).collect()
        assert [(r["name"], r["kind"]) for r in mine] == [(r["name"], r["kind"]) for r in same]


def test_scans_of_json(spark):
    from folio_spark.operators import extract

    doc = {"name": "top", "b": [{"name": "x", "c": {"name": ["y", "z"]}}, {"name": None}, 5], "a": {"name": {"d": 1}, "name2": "no"}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "{"), (4, '{"q":' * 100 + '{"name":"deep"}' + "}" * 100)], "page_id int, html string")

    def of(path):
        v = F.transform(extract.json_all(F.try_parse_json("html"), path), lambda x: F.to_json(x))
        return {r["page_id"]: r["v"] for r in df.select("page_id", v.alias("v")).collect()}

    assert of("$..name")[1] == ['"top"', '{"d":1}', '"x"', '"y"', '"z"', "null"] and of("$..name")[4] == ['"deep"'] and not of("$..name")[3]
    assert of("$.b[*].c.name")[1] == ['"y"', '"z"'] and of("$.b[0]['c']..name")[1] == ['"y"', '"z"'] and of("$.*.name")[1] == ['{"d":1}']
    assert of("$.b[*].*")[1] == ['{"name":["y","z"]}', '"x"', "null"]
    listed = extract.listing(df, "$..c", {"first": "$..name", "all": "name", "none": "$..zzz"}).collect()
    assert [(r["page_id"], r["first"], r["all"], r["none"]) for r in listed] == [(1, "y", "y\nz", None)]
    plan = df.withColumn("source", F.col("html")).select(extract.items("$.b[*]", {"n": "name", "m": "$.c.name"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") == 1


def test_sources_of_books(spark):
    from folio_spark.operators import resolve

    catalog = spark.createDataFrame([("http://m.one.com/", 2), (" http://one.net", 1), ("http://xone.com", 3), ("http://deep." + "l." * 20 + "org", 4), ("http://two.com", 5), ("http://two.com", 7)], "source_url string, source_ord long")
    shelf = spark.createDataFrame([("http://s/1", "http://two.com "), ("http://s/2", "gone"), ("http://s/2", None)], "book_url string, origin string")
    books = [("http://a/", "http://two.com"), ("http://a/", "http://gone"), ("http://s/1", None), ("http://s/2", " "), ("http://m.one.com/b", None), ("http://yxone.com/b", None), ("http://a.b.deep." + "l." * 20 + "org/x", ""), ("local-txt:1", None), ("http://a/", "local-epub"), (None, None), ("http://l.org/", None)]
    got = {(r["book_url"], r["given"]): (r["source_ord"], r["how"]) for r in resolve.resolve_sources(spark.createDataFrame(books, "book_url string, given string"), catalog, shelf).collect()}
    want = [(5, "given"), (None, None), (5, "shelf"), (None, None), (1, "host"), (3, "host"), (4, "host"), (None, "local"), (None, "local"), (None, None), (4, "host")]
    assert [got[b] for b in books] == want


def test_upsert_takes_the_last_of_a_key(spark):
    stored = spark.createDataFrame([(1, "a", 1), (None, "n", 2)], "k int, name string, n int")
    new = spark.createDataFrame([(1, "b", None, 1), (1, "c", None, 2), (None, "m", 9, 1), (3, "d", 4, 1)], "k int, name string, n int, at int")
    got = sorted((tuple(r) for r in shelf.upsert(stored, new, ["k"], keep=("n",), order="at").collect()), key=repr)
    assert got == sorted([(1, "c", 1), (None, "m", 9), (3, "d", 4)], key=repr)


def test_requests_of_a_hot_source(spark):
    r = random.Random(8)
    rows = [(i, "hot" if i % 10 else "cold", r.randrange(0, 4000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id int, source string, s int").withColumn("ts", F.timestamp_seconds("s"))
    rated = shelf.request_rate(df, 60, 20)
    for x in rated.collect():
        n = sum(1 for y in rows if y[1] == x["source"] and x["s"] - 60 <= y[2] <= x["s"])
        assert x["in_window"] == n and x["over"] == (n > 20)
    plan = rated._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source" in plan and "_bucket" in plan.split("hashpartitioning(source")[1].split(")")[0]
