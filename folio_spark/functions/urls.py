"""URLs: resolving, splitting off options, placeholders, encoding, hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def root_label(h: Column) -> Column:
    """The label before the last one of a host: 'example' of 'www.example.com'."""
    return F.coalesce(F.try_element_at(F.split(h, r"\."), F.lit(-2)), h)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def without_dots(path: Column) -> Column:
    """A path with its '.' and '..' segments taken out."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x)))
    return F.array_join(kept, "/")


def resolve(url: Column, base: Column) -> Column:
    """A link against its page. The base's fragment doesn't count, '//' means https, an empty link is the base."""
    link, page = F.trim(url), F.regexp_replace(base, "#.*$", "")
    folder = F.regexp_replace(F.regexp_extract(page, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    return (
        F.when(link == "", page)
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(origin(page), link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(page, r"\?.*$", ""), link))
        .when(link.startswith("#"), F.concat(page, link))
        .otherwise(F.concat(origin(page), without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), link))))
    )


def split_options(rule: Column) -> tuple[Column, Column]:
    """(url, JSON options or null): cut at the first comma that a brace follows."""
    options = F.regexp_extract(rule, r"(?s)^.*?\s*,\s*(\{.*)$", 1)
    return F.when(options != "", F.trim(F.regexp_extract(rule, r"(?s)^(.*?)\s*,\s*\{", 1))).otherwise(F.trim(rule)), F.nullif(options, F.lit(""))


def fill_placeholders(rule: Column, key: Column, page: Column) -> Column:
    out = rule
    for name, value in (("{{key}}", key), ("{{page}}", page.cast("string")), ("{key}", key), ("{page}", page.cast("string")), ("searchKey", key), ("searchPage", page.cast("string"))):
        out = F.replace(out, F.lit(name), value)
    return out


def page_choice(rule: Column, page: Column) -> Column:
    """Each <a,b,c> replaced by its item for the page, the last one for later pages."""
    found = F.regexp_extract_all(rule, F.lit("<([^<>]*)>"), F.lit(1))

    def pick(acc: Column, list_: Column) -> Column:
        items = F.split(list_, ",")
        item = F.coalesce(F.try_element_at(items, page), F.element_at(items, -1))
        return F.replace(acc, F.concat(F.lit("<"), list_, F.lit(">")), F.trim(item))

    return F.aggregate(found, rule, pick)


def encode_component(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def encode_query(query: Column) -> Column:
    """Keys and values of a query encoded one by one; a query that holds '%' stays."""
    pair = lambda p: F.when(F.contains(p, F.lit("=")), F.concat(encode_component(F.substring_index(p, "=", 1)), F.lit("="), encode_component(F.regexp_replace(p, "^[^=]*=", "")))).otherwise(encode_component(p))
    return F.when(F.contains(query, F.lit("%")), query).otherwise(F.array_join(F.transform(F.split(query, "&"), pair), "&"))


def normalise(c: Column) -> Column:
    """Without control characters (line ends and tabs apart), trimmed."""
    return F.trim(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def repair(c: Column) -> Column:
    """Encoded delimiters put back where a URL has no query of its own."""
    plain = c
    for code, char in (("%3F", "?"), ("%26", "&"), ("%3D", "="), ("%23", "#")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return F.when(F.contains(c, F.lit("?")), c).otherwise(plain)


def page_stem(url: Column) -> Column:
    """Origin and path without extension and a page suffix -N or _N with N of 2 or more."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(path, r"[-_](?:[2-9]|[1-9][0-9]+)$", "")


def continues(next_url: Column, url: Column, next_chapter: Column) -> Column:
    """Whether next_url is another page of the same text: same stem, and not the next chapter."""
    return F.coalesce((page_stem(next_url) == page_stem(url)) & (next_url != url) & ~next_url.eqNullSafe(next_chapter), F.lit(False))


#: Fixed value: the agent of requests that name none.
USER_AGENT = "Mozilla/5.0"


def absolute(url: Column, base: Column) -> Column:
    """A request's URL against its base, whose query and fragment don't count: scripts give nothing, data stays as it is."""
    bare = lambda c: normalise(split_options(c)[0])
    link, page = bare(url), bare(base)
    plain = F.regexp_replace(page, "[?#].*$", "")
    return F.when(link == "", page).when(link.startswith("javascript"), "").when(link.rlike("^(data:|https?://)"), link).otherwise(resolve(link, plain))


def _headers(json: Column) -> Column:
    """A JSON object, or a text that holds one, as a map with lower-case names."""
    text = F.when(F.trim(json).startswith("{"), json).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"))
    read = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    named = F.map_filter(read, lambda k, v: F.trim(k) != "")
    last = F.aggregate(F.map_entries(named), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def request_options(options: Column, source_header: Column | None = None) -> Column:
    """What the JSON options of a request rule say, as a struct: method, charset, headers (the source's, then the request's;
    no proxy; an agent always), proxy, body, retry (2; 0 if it can't be read), type, web_view, delay (0 or more)."""
    get = lambda name: F.get_json_object(options, f"$.{name}")
    given = lambda name: F.nullif(F.trim(get(name)), F.lit(""))
    own = F.when(get("headers").isNotNull(), _headers(get("headers"))).otherwise(F.create_map().cast("map<string,string>"))
    first = _headers(source_header) if source_header is not None else F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(first, lambda k, v: ~F.coalesce(F.map_contains_key(own, k), F.lit(False))), own)
    agent = F.when(F.map_contains_key(both, "user-agent"), both).otherwise(F.map_concat(both, F.create_map(F.lit("user-agent"), F.lit(USER_AGENT))))
    view = get("webView")
    return F.struct(
        F.when(F.upper(get("method")) == "POST", "POST").otherwise("GET").alias("method"),
        given("charset").alias("charset"),
        F.map_filter(agent, lambda k, v: k != "proxy").alias("headers"),
        F.try_element_at(both, F.lit("proxy")).alias("proxy"),
        get("body").alias("body"),
        F.when(get("retry").isNull(), 2).otherwise(F.coalesce(F.when(get("retry").rlike("^[0-9]+$"), get("retry").try_cast("int")), F.lit(0))).alias("retry"),
        given("type").alias("type"),
        F.coalesce(view.isNotNull() & (F.trim(view) != "") & (F.lower(F.trim(view)) != "false"), F.lit(False)).alias("web_view"),
        F.greatest(F.coalesce(get("webViewDelayTime").try_cast("long"), F.lit(0)), F.lit(0)).alias("delay"),
    )


def escape_component(c: Column) -> Column:
    """Percent escapes of code points; letters, digits and * @ - _ + . / stay."""
    one = lambda x: F.when(x.rlike("^[A-Za-z0-9*@_+./-]$"), x).otherwise(F.concat(F.lit("%"), F.when(code_point(x) < 16, F.concat(F.lit("0"), F.hex(code_point(x)))).otherwise(F.hex(code_point(x)))))
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), one), "")


def code_point(x: Column) -> Column:
    """The code point of a text of one character."""
    return F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")


def form_body(body: Column, charset: Column, typed: Column) -> Column:
    """Keys and values of a request's body encoded one by one; JSON, XML, encoded and typed bodies stay. The charset
    'escape' has its own encoding."""
    start = F.ltrim(body)
    stays = typed | start.rlike(r"^[{\[<]") | F.contains(body, F.lit("%"))

    def parts(encode) -> Column:
        pair = lambda p: F.when(F.contains(p, F.lit("=")), F.concat(encode(F.substring_index(p, "=", 1)), F.lit("="), encode(F.regexp_replace(p, "^[^=]*=", "")))).otherwise(encode(p))
        return F.array_join(F.transform(F.split(body, "&"), pair), "&")

    return F.when(stays, body).when(F.coalesce(F.lower(charset) == "escape", F.lit(False)), parts(escape_component)).otherwise(parts(encode_component))
