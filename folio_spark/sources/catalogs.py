"""Rule catalogs and text files: tolerant import, legacy fields, decoding."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The keys under which a catalog's array may stand.
WRAPPERS = ("bookSourceList", "bookSources", "data", "sources")
#: The keys under which an array of feeds may stand.
FEED_WRAPPERS = ("rssSources", "sources", "data", "list")
#: Old names of a source's fields.
LEGACY = {"ruleBookUrlPattern": "bookUrlPattern", "serialNumber": "customOrder", "ruleFindUrl": "exploreUrl", "ruleSearchUrl": "searchUrl", "enable": "enabled"}
#: Endings of old flat names of a list's fields, and what each names now.
_LISTED = {"List": "bookList", "Name": "name", "Author": "author", "Intro": "intro", "Kind": "kind", "LastChapter": "lastChapter", "UpdateTime": "updateTime", "NoteUrl": "bookUrl", "BookUrl": "bookUrl", "CoverUrl": "coverUrl", "WordCount": "wordCount"}
#: Flat rule fields, in order, and the field of the nested rule that each becomes.
FOLDED = {
    "ruleSearch": [(f"ruleSearch{k}", v) for k, v in _LISTED.items()],
    "ruleExplore": [(f"ruleFind{k}", v) for k, v in _LISTED.items()],
    "ruleBookInfo": [
        ("ruleBookInfoInit", "init"), ("ruleBookName", "name"), ("ruleBookAuthor", "author"), ("ruleIntroduce", "intro"), ("ruleBookIntro", "intro"), ("ruleBookKind", "kind"), ("ruleBookLastChapter", "lastChapter"),
        ("ruleBookUpdateTime", "updateTime"), ("ruleCoverUrl", "coverUrl"), ("ruleBookCoverUrl", "coverUrl"), ("ruleBookWordCount", "wordCount"), ("ruleChapterUrl", "tocUrl"), ("ruleBookTocUrl", "tocUrl"),
    ],
    "ruleToc": [("ruleChapterList", "chapterList"), ("ruleChapterName", "chapterName"), ("ruleContentUrl", "chapterUrl"), ("ruleChapterUrl", "chapterUrl"), ("ruleChapterUpdateTime", "updateTime"), ("ruleChapterUrlNext", "nextTocUrl"), ("ruleTocUrlNext", "nextTocUrl")],
    "ruleContent": [("ruleBookContent", "content"), ("ruleBookContentReplace", "replaceRegex"), ("ruleContentUrlNext", "nextContentUrl"), ("ruleContentTitle", "title")],
}


def catalog_rows(texts: DataFrame, text_col: str = "value", wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """The other columns, pos and source (variant) of each source of JSON texts that are arrays or hold one under a known key."""
    keep = [c for c in texts.columns if c != text_col]
    rows = texts.withColumn("v", F.try_parse_json(text_col))
    lists = [F.try_variant_get("v", f"$.{k}", "variant") for k in wrappers]
    whole = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v")).otherwise(F.coalesce(*lists))
    rows = rows.select(*keep, whole.alias("list")).where("list is not null")
    names = "".join(f"t.`{c}`, " for c in keep)
    return texts.sparkSession.sql("SELECT " + names + "e.pos AS pos, e.value AS source FROM {t} AS t, LATERAL variant_explode(t.list) AS e", t=rows)


def read_catalog(spark: SparkSession, path: str, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """A row (pos, source variant) for each source of a JSON file."""
    return catalog_rows(spark.read.text(path, wholetext=True), "value", wrappers)


def field(source: str, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(source, f"$.{name}", kind)


def int_or_text(source: str, name: str) -> Column:
    """An integer that may stand as text."""
    return F.coalesce(field(source, name, "bigint"), field(source, name).try_cast("bigint"))


def rule_object(source: str, name: str) -> Column:
    """A rule object that may be an object or a JSON text; '' and 'null' are none."""
    text = F.nullif(F.nullif(field(source, name), F.lit("")), F.lit("null"))
    return F.coalesce(F.expr(f"to_json(try_variant_get({source}, '$.{name}', 'map<string,variant>'))"), F.when(F.call_function("try_parse_json", text).isNotNull(), text))


def with_legacy(source: str, new: str) -> Column:
    """A field, or the old one that it replaces."""
    old = [o for o, n in LEGACY.items() if n == new]
    return F.coalesce(field(source, new), *(field(source, o) for o in old))


def _balanced(c: Column) -> Column:
    """Characters of an object in braces, nested to any depth, with which c begins; null if it doesn't or never closes."""
    tokens = F.regexp_extract_all(c, F.lit(r"[{}]|[^{}]++"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("closed"))

    def step(a: Column, t: Column) -> Column:
        depth = a["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(a["closed"], a).otherwise(F.struct(depth.alias("depth"), (a["n"] + F.length(t)).alias("n"), (depth == 0).alias("closed")))

    return F.when(c.startswith("{"), F.aggregate(tokens, start, step, lambda a: F.when(a["closed"], a["n"])))


def legacy_url_rule(raw: Column) -> Column:
    """An old URL rule as a new one: '@Header:{}', '|charset=' and '@body' become JSON options behind the URL, searchKey and
    searchPage placeholders, and '{1,2}' the choice '<1,2>'. Header objects may nest to any depth."""
    mark = "@Header:"
    before = F.substring_index(raw, mark, 1)
    after = F.regexp_replace(F.substring(raw, F.length(before) + len(mark) + 1, F.length(raw)), r"^\s+", "")
    size = F.when(F.contains(raw, F.lit(mark)), _balanced(after))
    header = F.substring(after, F.lit(1), size)
    url = F.when(size.isNotNull(), F.concat(before, F.substring(after, size + 1, F.length(after)))).otherwise(raw)
    charset = F.nullif(F.trim(F.regexp_extract(url, r"(?s)\|charset=(.*)$", 1)), F.lit(""))
    url = F.regexp_replace(url, r"(?s)\|charset=.*$", "")
    body = F.when(F.contains(url, F.lit("@body")), F.trim(F.regexp_replace(F.regexp_replace(url, "(?s)^.*?@body", ""), "^[:=]+", "")))
    url = F.regexp_replace(url, "(?s)@body.*$", "")
    url = F.regexp_replace(F.replace(F.replace(url, F.lit("searchKey"), F.lit("{{key}}")), F.lit("searchPage"), F.lit("{{page}}")), r"\{([^{}]*,[^{}]*)\}", "<$1>")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    headers = F.when(F.try_parse_json(header).isNotNull(), header).otherwise(quoted(header))
    parts = F.concat_ws(",", F.when(body.isNotNull(), F.concat(F.lit('"body":'), quoted(body))), F.when(charset.isNotNull(), F.concat(F.lit('"charset":'), quoted(charset))), F.when(header.isNotNull(), F.concat(F.lit('"headers":'), headers)), F.when(body.isNotNull(), F.lit('"method":"POST"')))
    return F.when(parts == "", url).otherwise(F.concat(url, F.lit(",{"), parts, F.lit("}")))


def migrated(source: str) -> dict[str, Column]:
    """The columns of a source (variant) by their present names, old ones taken where the new is absent: plain fields as
    texts, the five rule objects as maps. An old flat rule goes into its nested rule where that lacks it and it isn't blank."""
    some = lambda name: F.nullif(F.trim(field(source, name)), F.lit(""))
    out = {n: with_legacy(source, n) for n in ("bookSourceUrl", "bookSourceName", "bookSourceGroup", "bookUrlPattern", "customOrder", "enabled")}
    kind = field(source, "bookSourceType")
    out["bookSourceType"] = F.when(F.lower(kind) == "audio", "1").when(kind.isNotNull() & kind.try_cast("int").isNull(), "0").otherwise(kind)
    agent = some("httpUserAgent")
    out["header"] = F.coalesce(field(source, "header"), F.when(agent.isNotNull(), F.to_json(F.struct(agent.alias("User-Agent")))))
    for n in ("searchUrl", "exploreUrl", "loginUrl"):
        out[n] = legacy_url_rule(with_legacy(source, n))
    empty = F.create_map().cast("map<string,string>")
    given = {target: F.coalesce(F.from_json(rule_object(source, target), "map<string,string>"), empty) for target in FOLDED}
    for target, pairs in FOLDED.items():
        names = list(dict.fromkeys(new for _, new in pairs))
        taken = {n: [some(old) for old, new in pairs if new == n] for n in names}
        if target == "ruleToc":  # a chapter URL that the detail rule took is gone
            taken["chapterUrl"] = [some("ruleContentUrl"), F.when(F.map_contains_key(given["ruleBookInfo"], "tocUrl"), some("ruleChapterUrl"))]
        entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.coalesce(*taken[n]).alias("value")) for n in names)), lambda e: e["value"].isNotNull())
        fresh = _missing(F.map_from_entries(entries), given[target])
        out[target] = F.map_concat(given[target], fresh)
    return out


def _missing(new: Column, given: Column) -> Column:
    return F.map_filter(new, lambda k, v: ~F.map_contains_key(given, k))


def copy_sources(catalog: DataFrame, source_ns: str, target_ns: str, key: str = "source_url", ns: str = "user_ns") -> DataFrame:
    """A catalog after one namespace's sources are copied into another: same keys are replaced, others stay."""
    copied = catalog.where(F.col(ns) == source_ns).withColumn(ns, F.lit(target_ns))
    return catalog.join(copied.select(ns, key), [ns, key], "left_anti").unionByName(copied)


#: Fixed value: the namespace of the sources that new users get.
DEFAULTS = "__default__"


def set_defaults(catalog: DataFrame, source_ns: str, **columns: str) -> DataFrame:
    """A catalog after one namespace's sources have become defaults, over those of equal keys."""
    return copy_sources(catalog, source_ns, DEFAULTS, **columns)


def copy_defaults(catalog: DataFrame, target_ns: str, **columns: str) -> DataFrame:
    """A catalog after a namespace has got the defaults; without any nothing changes."""
    return copy_sources(catalog, DEFAULTS, target_ns, **columns)


_MARKS = re.compile(r'["\\{}\n]')


def _closed_objects(text: str, lo: int, strings: bool) -> tuple[list[tuple[int, int]], int | None]:
    """Outermost objects that close from place lo on, and where the first that never does begins. strings: braces in those don't count."""
    open_at, closed = [], []
    quoted, skip = False, -1
    for m in _MARKS.finditer(text, lo):
        at, mark = m.start(), m[0]
        if at == skip or not (open_at or mark == "{"):
            continue
        if mark == "\\":
            skip = at + 1 if quoted else skip
        elif mark == '"':
            quoted = strings and not quoted
        elif mark == "\n":
            quoted = False
        elif not quoted and mark == "{":
            open_at.append(at)
        elif not quoted:
            start = open_at.pop()
            while closed and closed[-1][0] > start:
                closed.pop()
            closed.append((start, at + 1))
    return closed, open_at[0] if open_at else None


def objects_in(text: str) -> list[tuple[int, int]]:
    """Places of the outermost objects of a text that close, whatever stands around them, in one pass over its marks.

    Braces in strings don't count, and a line break ends a string, which JSON writes otherwise. From an object that never
    closes on, a quotation mark may be what is missing: there a second pass goes by the braces alone."""
    found, cut = _closed_objects(text, 0, True)
    if cut is not None:
        ends = [y for _, y in found]
        starts = [x for x, _ in found]
        for x, y in _closed_objects(text, cut, False)[0]:
            i = bisect.bisect_right(ends, x)  # of the first object that ends behind x
            if i == len(found) or starts[i] >= y:
                found.append((x, y))
    return sorted(found)


#: Objects, and characters of them, that one batch of a scan holds.
MOST_ROWS, MOST_CHARS = 10_000, 8 << 20


def found_objects(rows: DataFrame) -> DataFrame:
    """i (place), item (JSON text) and the other columns for each object of the texts in the first column."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, places, items, size = [], [], [], 0

            def batch(b=b):
                same = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(items, pa.string()), *(b.column(i).take(same) for i in range(1, b.num_columns))], ["i", "item", *b.schema.names[1:]])

            for row, text in enumerate(b.column(0).to_pylist()):
                for i, (x, y) in enumerate(objects_in(text or "")):
                    at.append(row)
                    places.append(i)
                    items.append(text[x:y])
                    size += y - x
                    if len(items) >= MOST_ROWS or size >= MOST_CHARS:
                        yield batch()
                        at, places, items, size = [], [], [], 0
            if items:
                yield batch()

    return rows.mapInArrow(scan, T.StructType([T.StructField("i", T.LongType()), T.StructField("item", T.StringType()), *rows.schema.fields[1:]]))


def recovered(texts: DataFrame, text_col: str = "value", keys: tuple[str, ...] = ("bookUrl", "origin"), order: tuple[str, ...] = ()) -> DataFrame:
    """The objects that can still be read in damaged or concatenated JSON, each key once: item (JSON text) and its keys.

    Of objects with equal keys the first stays, by the order columns of its text, then by the text, then by its place there.
    Objects within objects are part of them; what doesn't parse is left out."""

    before = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    rows = texts.select(F.col(text_col).cast("string").alias("t"), F.md5(F.col(text_col).cast("string")).alias("hash"), *before)
    found = found_objects(rows).where(F.try_parse_json("item").isNotNull())
    place = F.struct(*(f"o{i}" for i in range(len(order))), "hash", "i")
    kept = found.select("item", place.alias("_at"), *(F.get_json_object("item", f"$['{k}']").alias(k) for k in keys)).where(F.col(keys[0]).isNotNull())
    return kept.groupBy(*keys).agg(F.min_by("item", "_at").alias("item"))


#: Names of charsets that the JVM's decode lacks here, and Python's for them.
PYTHON_CHARSETS = {"gbk": "gb18030", "gb2312": "gb18030", "gb18030": "gb18030", "big5": "big5", "shift_jis": "cp932", "shift-jis": "cp932", "euc-kr": "cp949", "euc-jp": "euc_jp", "windows-1251": "cp1251", "windows-1252": "cp1252"}


@F.pandas_udf(T.StringType())
def _decoded(bodies: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else bytes(b).decode(n or "gb18030", "replace") for b, n in zip(bodies, names)])


def page_rows(pages: DataFrame, body: str = "html") -> DataFrame:
    """Fetched pages with what a scan needs of each, where the table lacks it: final_url (the URL), status (200) and headers
    (lower-case names); pages of other statuses than 2xx, and without a body, have no text to read."""
    rows = pages
    if "final_url" not in rows.columns:
        rows = rows.withColumn("final_url", F.col("url"))
    rows = rows.withColumn("final_url", F.coalesce(F.nullif("final_url", F.lit("")), "url"))
    if "status" not in rows.columns:
        rows = rows.withColumn("status", F.lit(200))
    headers = F.transform_keys("headers", lambda k, _: F.lower(k)) if "headers" in rows.columns else F.create_map().cast("map<string,string>")
    return rows.withColumn("headers", headers).withColumn(body, F.when(F.coalesce("status", F.lit(200)).between(200, 299), F.col(body)))


def read_texts(spark: SparkSession, path: str, most: int = 50 << 20, namespace: str = "default") -> DataFrame:
    """Text files up to a size, decoded by their byte-order mark, as UTF-8, or else as GB18030, with a stable id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where(F.col("length") <= most)
    return decoded_texts(files.select("path", "content"), namespace)


def decoded_texts(files: DataFrame, namespace: str = "default") -> DataFrame:
    """path, title, text, book_id and n_chars of files (path, content)."""
    from folio_spark.functions.text import safe_file_name, title_from_file_name

    mark = F.hex(F.substring("content", 1, 3))
    body = F.when(mark == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    utf8 = F.try_validate_utf8(body.cast("string"))
    rows = files.withColumn("_utf8", utf8).withColumn("_rest", F.when(F.col("_utf8").isNull(), F.col("content")))
    wide = F.when(mark.startswith("FFFE") | mark.startswith("FEFF"), F.decode("content", "UTF-16"))
    rows = rows.withColumn("text", F.coalesce("_utf8", wide, _decoded("_rest", F.lit("gb18030"))))
    book = F.md5(F.concat_ws(":", F.lit(namespace), safe_file_name(F.col("path")), F.md5("text")))
    return rows.select("path", title_from_file_name(F.col("path")).alias("title"), "text", book.alias("book_id"), F.length("text").alias("n_chars"))


def decode_body(body: Column, declared: Column, content_type: Column | None = None, response_type: Column | None = None) -> Column:
    """A page's bytes as text: by the declared charset, else the content type's, else one that a meta element in the first
    4096 bytes names, else UTF-8. With a response type the bytes come as hex digits. An XML body without a declaration gets one."""
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    kind = content_type if content_type is not None else F.lit("")
    named = [F.nullif(F.trim(declared), F.lit("")), F.nullif(F.regexp_extract(kind, r"(?i)charset=[\"']?([\w-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"(?i)<meta[^>]*charset=[\"']?([\w-]+)", 1), F.lit("")), F.lit("utf-8")]
    name = F.lower(F.coalesce(*named))
    other = F.create_map(*(F.lit(x) for kv in PYTHON_CHARSETS.items() for x in kv))
    python = F.try_element_at(other, name)
    out = F.when(python.isNotNull(), _decoded(F.when(python.isNotNull(), body), python)).otherwise(F.decode(body, "UTF-8"))
    for label, charset in (("iso-8859-1", "ISO-8859-1"), ("latin1", "ISO-8859-1"), ("utf-16", "UTF-16"), ("us-ascii", "US-ASCII")):
        out = F.when(name == label, F.decode(body, charset)).otherwise(out)
    xml = F.coalesce(F.regexp_like(kind, F.lit("(?i)[/+]xml")), F.lit(False))
    out = F.when(xml & ~F.ltrim(out).startswith("<?xml"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), out)).otherwise(out)
    return out if response_type is None else F.when(F.coalesce(F.trim(response_type) != "", F.lit(False)), F.lower(F.hex(body))).otherwise(out)


#: Fixed value: a feed's date.
_RFC = "d MMM yyyy HH:mm:ss Z"


def feed_articles(feeds: DataFrame, body: str = "body") -> DataFrame:
    """The other columns of feeds and pos, title, link, description, content, image, pub_date and ord (the published, else
    the updated second) of each article, RSS items and Atom entries alike. A feed that isn't well-formed gives none."""
    keep = [c for c in feeds.columns if c != body]
    person = "title string, link string, description string, pubDate string, encoded string, enclosure struct<_url:string,_type:string>"
    entry = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, published string, updated string"
    flat = F.regexp_replace(F.regexp_replace(body, r"<(/?)[A-Za-z]+:encoded", "<$1encoded"), r"(?s)<!DOCTYPE[^>]*>", "")
    plain = F.regexp_replace(F.regexp_replace(flat, r"(<(?:title|summary|content|description)) [^>]*>", "$1>"), r' xmlns(:\w+)?="[^"]*"', "")
    rss = F.from_xml(plain, f"channel struct<item:array<struct<{_colons(person)}>>>", {"mode": "PERMISSIVE"})
    atom = F.from_xml(plain, f"entry array<struct<{_colons(entry)}>>", {"mode": "PERMISSIVE"})
    none = F.lit(None).cast("string")
    when = lambda c: F.coalesce(F.unix_seconds(F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]+, ", ""), F.lit(_RFC))), F.unix_seconds(F.try_to_timestamp(c)))
    item = lambda i: F.struct(F.trim(i["title"]).alias("title"), F.trim(i["link"]).alias("link"), i["description"].alias("description"), i["encoded"].alias("content"), F.when(i["enclosure"]["_type"].startswith("image"), i["enclosure"]["_url"]).alias("image"), i["pubDate"].alias("pub_date"), when(i["pubDate"]).alias("ord"))
    href = lambda e: F.coalesce(F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])
    told = lambda e: F.struct(F.trim(e["title"]).alias("title"), href(e).alias("link"), e["summary"].alias("description"), e["content"].alias("content"), none.alias("image"), F.coalesce(e["published"], e["updated"]).alias("pub_date"), F.coalesce(when(e["published"]), when(e["updated"])).alias("ord"))
    rows = F.concat(F.coalesce(F.transform(rss["channel"]["item"], item), F.array()), F.coalesce(F.transform(atom["entry"], told), F.array()))
    return feeds.select(*keep, F.posexplode(rows).alias("pos", "a")).select(*keep, "pos", "a.*")


def _colons(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ":", 1) for f in fields.split(", "))


def read_feed(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """Articles of RSS items: origin, title, link, description, pub_date and the published second as `ord`."""
    schema = "title string, link string, description string, pubDate string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    at = F.unix_seconds(F.expr("try_to_timestamp(regexp_replace(pubDate, '^[A-Za-z]+, ', ''), 'd MMM yyyy HH:mm:ss Z')"))
    return rows.select(F.lit(origin).alias("origin"), "title", F.trim("link").alias("link"), "description", F.col("pubDate").alias("pub_date"), at.alias("ord"))
