"""Rules of a catalog applied to a page table: listings, categories, details, tables of contents, contents.

Every rule compiles to a column of the page's row, whatever its mode: an array of structs for a list, a string for a value.
Pages of many sources go through one plan: sources that share their rules form a group, and a page takes the branch of
its group. Pages are tokenised once, and those whose rules are all JSON, XPath or patterns not at all.

Fields are evaluated in the order they are declared in. '@put:{k:rule}' keeps a value under a name, '@get:{k}' and '{{k}}'
give it back to later fields of the same item; '{{$.path}}' and '{$.path}' stand for values of a JSON item. A rule with
such parts is a template: what it renders is the value. Scripts are refused by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio_spark.functions import text as X
from folio_spark.functions import urls as U

from . import rules
from .shred import trees

JSON, XPATH, REGEX, CSS, AUTO = "json", "xpath", "regex", "css", "auto"
_TEMPLATE = re.compile(r"\{\{@get:\{([^}]+)\}\}\}|@get:\{([^}]+)\}|\{\{(.+?)\}\}|\{(\$[^{}]+)\}")


def mode_of(rule: str) -> str:
    """The branch a rule takes, by its prefix, then by its shape; AUTO where the body decides (JSON or CSS)."""
    bare = rule.strip().lstrip("+-").strip()
    low = bare.lower()
    if low.startswith(("js:", "@js:", "<js>")):
        raise rules.UnsupportedRule(f"rule {rule!r}: script")
    for mode in (CSS, XPATH, JSON, REGEX):
        if low.startswith(f"@{mode}:"):
            return mode
    if bare.startswith(("/", "./")):
        return XPATH
    if bare.startswith("$"):
        return JSON
    return REGEX if bare.startswith(":") else AUTO


def bare_rule(rule: str) -> str:
    """A rule without the signs of a list and a mode."""
    rule = re.sub(r"^[+-]", "", rule.strip()).strip()
    return re.sub(r"(?i)^@(css|xpath|json|regex):", "", rule).removeprefix(":").strip()


def is_json(body: Column) -> Column:
    t = F.trim(body)
    return F.coalesce((t.startswith("{") | t.startswith("[")) & F.try_parse_json(t).isNotNull(), F.lit(False))


def is_xml(body: Column) -> Column:
    parsed = F.from_xml(body, "struct<_ok:string,_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(body.isNotNull() & parsed["_bad"].isNull(), F.lit(False))


def with_variables(fields: dict[str, str], value: Callable[[str], Column], path: Callable[[str], Column] | None = None) -> list[Column]:
    """The columns of fields, in their order. value: a plain rule's column; path: that of a JSON path or key."""
    known: dict[str, Column] = {}
    nothing = F.lit(None).cast("string")

    def named(key: str) -> Column:
        return known.get(key.strip(), F.lit(""))

    def part(m: re.Match) -> Column:
        if m[1] or m[2]:
            return named(m[1] or m[2])
        expr = (m[3] or m[4]).strip()
        if expr in known:
            return known[expr]
        if path is None:
            raise rules.UnsupportedRule(f"template {expr!r}")
        return F.coalesce(path(expr), F.lit(""))

    def one(rule: str) -> Column:
        rule = rule.strip()
        if m := re.fullmatch(r"@put:\{(.*)\}", rule):
            for entry in m[1].split(","):
                key, mark, inner = entry.partition(":")
                if mark:
                    known[key.strip()] = F.coalesce(one(inner.strip().strip('"')), F.lit(""))
            return F.lit("")
        if m := re.fullmatch(r"@get:\{([^}]+)\}", rule):
            return known.get(m[1].strip(), nothing)
        if not _TEMPLATE.search(rule):
            return value(rule)
        template, changes, once = rules.split_changes(rule)
        parts, at = [], 0
        for m in _TEMPLATE.finditer(template):
            parts += [F.lit(template[at : m.start()]), part(m)]
            at = m.end()
        return F.nullif(rules.changed(F.concat(*parts, F.lit(template[at:])), changes, once), F.lit(""))

    return [one(r).cast("string").alias(c) for c, r in fields.items()]


def json_path(rule: str) -> str:
    """A path or key as a path."""
    return rule if rule.startswith("$") else f"$.{rule}" if re.fullmatch(r"[\w-]+(\.[\w-]+|\[\d+\])*", rule) else f"$['{rule}']"


#: Levels to which a scan goes down; parsers of such bodies refuse deeper ones.
DEEPEST = 128
_JSON_STEP = re.compile(r"\.\.(?:(\*)|([\w-]+)|\['([^']*)'\])|\.(\*)|\.([\w-]+)|\[(\*)\]|\[(\d+)\]|\['([^']*)'\]|\[\"([^\"]*)\"\]")


def json_steps(path: str) -> list[tuple[str, str]]:
    """The steps of a path: (key, name), (item, number), (each, ''), (deep, name), (all, '')."""
    out, at = [], 1
    while at < len(path):
        m = _JSON_STEP.match(path, at)
        if not m:
            raise rules.UnsupportedRule(f"path {path!r}: {path[at:]!r}")
        star, name, quoted, dot_star, key, any_item, number, single, double = m.groups()
        if star:
            out.append(("all", ""))
        elif name is not None or quoted is not None:
            out.append(("deep", name if name is not None else quoted))
        elif dot_star or any_item:
            out.append(("each", ""))
        elif number is not None:
            out.append(("item", number))
        else:
            out.append(("key", next(x for x in (key, single, double) if x is not None)))
        at = m.end()
    return out


def is_deep(path: str) -> bool:
    """Whether a path holds what Spark's own paths don't: a scan, or steps below an asterisk that stand for many values."""
    return ".." in path or path.count("*") > 1 or ".*" in path


def _under(v: Column) -> Column:
    """The items of an array, or the values of an object by the order of their names."""
    kind = "array<variant>"
    return F.coalesce(F.try_variant_get(v, "$", kind), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast(kind))


def _scanned(v: Column) -> Column:
    """A value and all below it, each before what it holds."""
    node = "struct<p:array<int>,v:variant>"
    none = F.array().cast(f"array<{node}>")
    first = F.array(F.struct(F.array().cast("array<int>").alias("p"), v.alias("v")))

    def level(state: Column, _: Column) -> Column:
        held = lambda n: F.transform(_under(n["v"]), lambda x, i: F.struct(F.array_append(n["p"], i).alias("p"), x.alias("v")))
        return F.struct(F.flatten(F.transform(state["now"], held)).alias("now"), F.array_append(state["got"], state["now"]).alias("got"))

    start = F.struct(first.cast(f"array<{node}>").alias("now"), F.array().cast(f"array<array<{node}>>").alias("got"))
    step = lambda state, i: F.when(F.size(state["now"]) > 0, level(state, i)).otherwise(state)
    every = F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), start, step, lambda s: F.flatten(s["got"]))
    order = lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)
    return F.transform(F.array_sort(F.coalesce(every, none), order), lambda n: n["v"])


def _getting(path: str) -> Callable[[Column], Column]:
    return lambda x: F.try_variant_get(x, path, "variant")


def json_all(v: Column, path: str) -> Column:
    """All values (variants) that a path gives of a value; arrays among them as their items."""
    now = F.array(v)
    for kind, name in json_steps(path):
        quoted = name.replace("'", "\\'")
        if kind in ("deep", "all"):
            now = F.flatten(F.transform(now, lambda x: _scanned(x)))
        if kind == "all":
            now = F.flatten(F.transform(now, _under))
        elif kind == "each":
            now = F.flatten(F.transform(now, _under))
        else:
            get = f"$[{name}]" if kind == "item" else f"$['{quoted}']"
            now = F.filter(F.transform(now, _getting(get)), lambda x: x.isNotNull())
    one = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
    return F.filter(F.flatten(F.transform(now, one)), lambda x: x.isNotNull())


def json_value(item: Column, rule: str, parsed: Column | None = None) -> Column:
    """The value of a path or key: arrays as lines, null and missing ones as null; of a path with a scan the first. parsed: the
    item as variant, where several fields share it."""
    path = json_path(rule)
    v = F.try_parse_json(item) if parsed is None else parsed
    if is_deep(path):
        return X.json_text(F.get(json_all(v, path), F.lit(0)))
    if "*" in path:
        found = F.get_json_object(item, path)
        return F.when(found.startswith("["), F.array_join(F.from_json(found, "array<string>"), "\n")).otherwise(found)
    return X.json_text(F.try_variant_get(v, path, "variant"))


def json_field(rule: str, item: Column, parsed: Column | None = None) -> Column:
    """A field of a JSON item. A value with one of / ? & = , in it is a literal."""
    rule, changes, once = rules.split_changes(bare_rule(rule))
    found = F.lit(rule) if any(c in rule for c in "/?&=,") else json_value(item, rule, parsed)
    return F.nullif(rules.changed(found, changes, once), F.lit(""))


def _json_fields(fields: dict[str, str], item: Column) -> Column:
    """The fields of an item as a struct; it is parsed once for all of them."""
    return rules.let(F.try_parse_json(item), lambda v: F.struct(*with_variables(fields, lambda r: json_field(r, item, v), lambda p: json_value(item, p, v))))


def json_items(rule: str, fields: dict[str, str], body: Column) -> Column:
    """An array's items are rows; anything else is one."""
    path = json_path(bare_rule(rule))
    if is_deep(path):
        each = F.transform(json_all(F.try_parse_json(body), path), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))
    else:
        found = F.get_json_object(body, path)
        each = F.when(found.startswith("["), F.from_json(found, "array<string>")).otherwise(F.filter(F.array(found), lambda x: x.isNotNull()))
    return F.transform(each, lambda x: _json_fields(fields, x))


def regex_items(rule: str, fields: dict[str, str], body: Column) -> Column:
    """Each match of an all-in-one pattern is a row; fields refer to its groups as $1 to $99. Rows without name go."""
    pattern = F.lit(rules.checked_pattern(bare_rule(rule)))
    used = sorted({int(g) for r in fields.values() for g in re.findall(r"\$([1-9]\d?)", r)})
    groups = F.arrays_zip(*(F.regexp_extract_all(F.coalesce(body, F.lit("")), pattern, F.lit(g)).alias(f"g{g}") for g in used or [0]))

    def value(r: str, m: Column) -> Column:
        r, changes, once = rules.split_changes(r)
        parts = [m[f"g{p[1:]}"] if re.fullmatch(r"\$[1-9]\d?", p) else F.lit(p) for p in re.split(r"(\$[1-9]\d?)", r) if p]
        return rules.changed(F.concat(*parts) if parts else F.lit(""), changes, once)

    rows = F.transform(groups, lambda m: F.struct(*(value(r, m).alias(c) for c, r in fields.items())))
    return F.filter(rows, lambda r: r["name"] != "") if "name" in fields else rows


def xpath_items(rule: str, fields: dict[str, str], body: Column) -> Column:
    """Lists by XPath; a body that isn't well-formed gives no rows. The nth of each field's nodes belongs to the nth item."""
    path = bare_rule(rule)
    rows = F.arrays_zip(*(F.xpath(body, F.lit(f"{path}/{bare_rule(r).removeprefix('./').lstrip('/')}")).alias(c) for c, r in fields.items()))
    return F.when(is_xml(body), rows)


def xpath_value(rule: str, body: Column) -> Column:
    """The first node's text, or a string, number or boolean result as text; null where the body isn't well-formed."""
    rule, changes, once = rules.split_changes(bare_rule(rule))
    if re.match(r"(count|sum|number|string-length|floor|ceiling|round|position|last)\(", rule):
        n = F.xpath_double(body, F.lit(rule))
        found = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    elif re.match(r"(boolean|not|contains|starts-with)\(", rule) or re.search(r"[^\[\]]*[=<>][^\[\]]*$", re.sub(r"\[[^\]]*\]", "", rule)):
        found = F.xpath_boolean(body, F.lit(rule)).cast("string")
    elif re.match(r"(string|concat|substring|normalize-space|translate|name|local-name)", rule):
        found = F.xpath_string(body, F.lit(rule))
    else:
        found = F.get(F.xpath(body, F.lit(rule)), F.lit(0))
    return F.when(is_xml(body), F.nullif(rules.changed(found, changes, once), F.lit("")))


def css_field(rule: str, i: Column) -> Column:
    """A field of an element; JSON and XPath rules have no value there."""
    return F.lit(None).cast("string") if mode_of(rule) in (JSON, XPATH) else rules.first(rule, i)


def css_items(rule: str, fields: dict[str, str]) -> Column:
    return F.transform(rules.item_places(bare_rule(rule)), lambda i: F.struct(*with_variables(fields, lambda r: css_field(r, i))))


def items(rule: str, fields: dict[str, str], body: str = "source") -> Column:
    """The rows of a list rule, as an array of structs; '-' in front reverses them."""
    b, mode = F.col(body), mode_of(rule)
    if mode == AUTO:
        rows = F.when(is_json(b), json_items(rule, fields, b)).otherwise(css_items(rule, fields))
    else:
        rows = {JSON: json_items, REGEX: regex_items, XPATH: xpath_items}[mode](rule, fields, b) if mode != CSS else css_items(rule, fields)
    rows = F.coalesce(rows, F.array().cast("array<struct<" + ",".join(f"{c}:string" for c in fields) + ">>"))
    return F.reverse(rows) if rule.strip().startswith("-") else rows


def record(fields: dict[str, str], body: str = "source", init: str = "") -> Column:
    """The fields of a whole page as one struct. The name's rule, or the first one, gives the mode. init: '@put' of
    variables, or for JSON the path of the part that the fields are read from."""
    b, mode = F.col(body), mode_of(fields.get("name") or next(iter(fields.values())))
    puts = init.strip().startswith("@put:")
    before = {"_init": init} if puts else {}

    def css() -> Column:
        return F.struct(*with_variables(before | fields, lambda r: css_field(r, F.lit(-1)))[len(before) :])

    def of_json() -> Column:
        scope = F.coalesce(F.get_json_object(b, json_path(bare_rule(init))), b) if init and not puts else b
        return rules.let(F.struct(scope.alias("t"), F.try_parse_json(scope).alias("v")), lambda z: F.struct(*with_variables(before | fields, lambda r: json_field(r, z["t"], z["v"]), lambda p: json_value(z["t"], p, z["v"]))[len(before) :]))

    if mode == XPATH:  # read as HTML where it isn't well-formed and the rules allow it
        return F.struct(*with_variables(before | fields, lambda r: xpath_value(r, b))[len(before) :])
    if mode == JSON:
        return of_json()
    return css() if mode == CSS else F.when(is_json(b), of_json()).otherwise(css())


def value(rule: str, body: str = "source") -> Column:
    """The first value of a page's rule."""
    return record({"value": rule}, body)["value"]


def content(rule: str, body: str = "source") -> Column:
    """A page's text: all that the rule selects, element by element, joined by line breaks; by JSON and XPath the first value."""
    b, mode = F.col(body), mode_of(rule)

    def css() -> Column:
        pure, changes, once = rules.split_changes(bare_rule(rule))
        first, _, rest = pure.partition("@")
        roots = rules.elements(first.strip(), F.lit(-1))
        if not rest:
            texts = F.transform(roots, lambda i: rules.extracted("textNodes", i))
        elif rest in rules.TEXTS + rules.SOURCES or ("@" not in rest and re.fullmatch(r"attr\[.+\]|[a-z-]+", rest)):
            texts = F.transform(roots, lambda i: rules.extracted(rest, i))
        else:
            texts = F.flatten(F.transform(roots, lambda i: rules.strings(rest, i)))
        return rules.changed(F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n"), changes, once)

    if mode == JSON:
        return json_value(b, bare_rule(rule))
    if mode == XPATH:
        return xpath_value(rule, b)
    return css() if mode == CSS else F.when(is_json(b), json_value(b, bare_rule(rule)) if re.fullmatch(r"[\w.$\[\]-]+", bare_rule(rule)) else F.lit(None).cast("string")).otherwise(css())


def needs_tree(*all_rules: str) -> bool:
    return any(r and mode_of(r) in (CSS, AUTO) for r in all_rules)


def listing(pages: DataFrame, rule: str, fields: dict[str, str], page: str = "page_id", body: str = "html") -> DataFrame:
    """page, item_ix and fields by whichever mode the list rule has."""
    read = trees(pages, body) if needs_tree(rule) else pages.withColumn("source", F.col(body))
    return read.select(page, F.posexplode(items(rule, fields)).alias("item_ix", "_f")).select(page, "item_ix", *(F.col(f"_f.{c}").alias(c) for c in fields))


def _of_sources(pages: DataFrame, catalog: list[dict], body: str, build: Callable[[dict], Column], used: Callable[[dict], list[str]]) -> DataFrame:
    """pages of the catalog's sources with source_ord and `found`, each by its source's rules. pages carry source_url.

    A catalog of rules is small by nature; sources with equal rules share a branch.
    """
    groups: dict[str, tuple[int, dict]] = {}
    known = []
    for s in catalog:
        key = repr(sorted((k, v) for k, v in s.items() if k not in ("source_url", "source_ord")))
        known.append((s["source_url"], s["source_ord"], groups.setdefault(key, (len(groups), s))[0]))
    mine = pages.join(F.broadcast(pages.sparkSession.createDataFrame(known, "source_url string, source_ord long, _group int")), "source_url")
    by_tree = [n for n, s in groups.values() if needs_tree(*used(s))]
    read = mine.withColumn("_tree", F.when(F.col("_group").isin(by_tree), F.col(body))) if by_tree else mine
    read = trees(read, "_tree").withColumn("source", F.col(body)) if by_tree else read.withColumn("source", F.col(body))
    found = None
    for n, s in groups.values():
        column = build(s)
        found = F.when(F.col("_group") == n, column) if found is None else found.when(F.col("_group") == n, column)
    return read.withColumn("found", found).drop("_group", "_tree", "source", "nodes", "runs")


#: What a caller may put into an extraction, each a function of columns (an Arrow or pandas UDF too): `body` changes a page
#: before it is read, `items` the list of a page's rows (structs), and a field's name the field, given its place and value.
Hooks = dict[str, Callable[..., Column]]


def _hooked(pages: DataFrame, body: str, hooks: Hooks | None) -> DataFrame:
    return pages.withColumn(body, hooks["body"](F.col(body))) if hooks and "body" in hooks else pages


def _formatted(columns: dict[str, Column], place: Column, hooks: Hooks | None) -> dict[str, Column]:
    return {c: hooks[c](place, v) if hooks and c in hooks else v for c, v in columns.items()}


def _listed(pages: DataFrame, catalog: list[dict], list_key: str, fields_key: str, page: str, body: str, url: str, hooks: Hooks | None = None) -> DataFrame:
    pages = _hooked(pages, body, hooks)
    names = list(dict.fromkeys(c for s in catalog for c in s[fields_key]))
    blank = {c: F.lit(None).cast("string").alias(c) for c in names}

    def whole(row: Column, own: dict) -> Column:
        return F.struct(*(row[c].alias(c) if c in own else blank[c] for c in names))

    def build(s: dict) -> Column:
        own = s[fields_key]
        rows = F.transform(items(s[list_key], own), lambda r: whole(r, own)) if s[list_key].strip() else F.array().cast("array<struct<" + ",".join(f"{c}:string" for c in names) + ">>")
        rows = hooks["items"](rows) if hooks and "items" in hooks else rows
        if (s.get("url_pattern") or "").strip():
            return rows
        alone = {c: r for c, r in s.get("detail", own).items() if c in names}
        if mode_of(next(iter(alone.values()))) == REGEX or any("$1" in r for r in alone.values()):
            return rows
        one = record(alone)
        only = F.when(F.trim(F.coalesce(one["name"], F.lit(""))) != "", F.array(whole(one, alone))).otherwise(F.slice(rows, 1, 0)) if "name" in alone else F.array(whole(one, alone))
        return rules.let(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(only))

    read = _of_sources(pages, catalog, body, build, lambda s: [s[list_key], *s.get("detail", s[fields_key] if not (s.get("url_pattern") or "").strip() else {}).values()])
    rows = read.select(page, "source_url", "source_ord", F.col(url).alias("_url"), F.posexplode("found").alias("item_ix", "_f"))
    absolute = {c: U.resolve(F.coalesce(F.col(f"_f.{c}"), F.lit("")), F.col("_url")) if c == "book_url" else F.when(F.col(f"_f.{c}") != "", U.resolve(F.col(f"_f.{c}"), F.col("_url"))) if c == "cover_url" else F.col(f"_f.{c}") for c in names}
    return rows.select(page, "item_ix", *(v.alias(c) for c, v in _formatted(absolute, F.col("item_ix"), hooks).items()), "source_url", "source_ord")


def search(pages: DataFrame, catalog: list[dict], page: str = "page_id", body: str = "html", url: str = "url", hooks: Hooks | None = None) -> DataFrame:
    """Listings of all sources. catalog: dicts of source_url, source_ord, list, fields and optionally url_pattern, detail.

    Book and cover URLs are made absolute. A page whose list is empty, of a source without url_pattern, is read as one book
    by the source's detail rules (its fields, where it has none) and dropped if it then has no name.
    """
    return _listed(pages, catalog, "list", "fields", page, body, url, hooks)


def explore(pages: DataFrame, catalog: list[dict], page: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """Category listings: by explore_list and explore_fields, by the search rules where that list rule is empty."""
    chosen = [{**s, "list": s["explore_list"], "fields": s.get("explore_fields") or s["fields"]} if (s.get("explore_list") or "").strip() else s for s in catalog]
    return _listed(pages, [{k: v for k, v in s.items() if not k.startswith("explore")} for s in chosen], "list", "fields", page, body, url)


DETAIL = ("name", "author", "intro", "kind", "last_chapter", "update_time", "cover_url", "word_count", "toc_url", "can_re_name", "download_urls")


def details(pages: DataFrame, catalog: list[dict], page: str = "page_id", body: str = "html", url: str = "url") -> DataFrame:
    """One row a page: its book's fields. Missing name and author are empty, toc_url is the page itself where its rule gives none.

    catalog: dicts of source_url, source_ord, detail (rules by field) and optionally init.
    """

    def build(s: dict) -> Column:
        one = record(s["detail"], init=s.get("init", ""))
        return F.struct(*((one[c] if c in s["detail"] else F.lit(None).cast("string")).alias(c) for c in DETAIL))

    read = _of_sources(pages, catalog, body, build, lambda s: list(s["detail"].values()))
    column = {c: F.col(f"found.{c}") for c in DETAIL}
    for c in ("name", "author"):
        column[c] = F.coalesce(column[c], F.lit(""))
    column["cover_url"] = F.when(column["cover_url"] != "", U.resolve(column["cover_url"], F.col(url)))
    column["toc_url"] = F.when(column["toc_url"] != "", U.resolve(column["toc_url"], F.col(url))).otherwise(F.col(url))
    return read.select(page, "source_url", "source_ord", F.col(url).alias("book_url"), *(v.alias(c) for c, v in column.items()))


TOC = ("title", "url", "tag", "is_volume", "is_vip", "is_pay")


def tocs(pages: DataFrame, catalog: list[dict], page: str = "page_id", body: str = "html", url: str = "url", hooks: Hooks | None = None) -> DataFrame:
    """Chapters of every page: idx, title, absolute url, tag and three flags; of equal URLs the first stays.

    A chapter without URL has the page's; a volume without one has its title and place. catalog: dicts of source_url,
    source_ord, toc_list and toc (rules by field). '-' in front of toc_list numbers the kept chapters backwards.
    """
    pages = _hooked(pages, body, hooks)

    def build(s: dict) -> Column:
        forward = s["toc_list"].strip().lstrip("-")
        return F.struct(F.lit(s["toc_list"].strip().startswith("-")).alias("back"), F.transform(items(forward, s["toc"]), lambda r: F.struct(*((r[c] if c in s["toc"] else F.lit(None).cast("string")).alias(c) for c in TOC))).alias("rows"))

    read = _of_sources(pages, catalog, body, build, lambda s: [s["toc_list"]])
    rows = read.select(page, "source_ord", F.col(url).alias("_url"), F.col("found.back").alias("_back"), F.posexplode("found.rows").alias("_at", "r"))
    flag = {c: X.is_truthy(F.col(f"r.{c}")) for c in ("is_volume", "is_vip", "is_pay")}
    raw = F.coalesce(F.trim("r.url"), F.lit(""))
    own = F.when(raw != "", U.resolve(raw, F.col("_url"))).when(flag["is_volume"], F.lit(None).cast("string")).otherwise(F.col("_url"))
    placed = rows.select(page, "source_ord", "_back", "_at", F.coalesce("r.title", F.lit("")).alias("title"), own.alias("url"), F.col("r.tag").alias("tag"), *(v.alias(c) for c, v in flag.items()))
    kept = placed.withColumn("_n", F.row_number().over(W.partitionBy(page, "url").orderBy("_at"))).where("_n = 1 or url is null")
    before = F.row_number().over(W.partitionBy(page).orderBy("_at")) - 1
    total = F.count("*").over(W.partitionBy(page))
    numbered = kept.withColumn("_i", before).withColumn("_total", total)
    idx = F.when(F.col("_back"), F.col("_total") - 1 - F.col("_i")).otherwise(F.col("_i")).cast("int")
    title = _formatted({"title": F.col("title")}, idx, hooks)["title"]
    return numbered.select(page, "source_ord", idx.alias("idx"), title.alias("title"), F.coalesce("url", F.concat("title", F.col("_i").cast("string"))).alias("url"), "tag", "is_volume", "is_vip", "is_pay")


def next_pages(pages: DataFrame, rule: str, page: str = "page_id", body: str = "html", url: str = "url", all_of_them: bool = True) -> DataFrame:
    """page, ix and absolute next_url of every URL that a rule gives (only the first, if not all_of_them)."""
    mode = mode_of(rule)
    if mode == CSS or mode == AUTO:
        read, found = trees(pages, body), rules.strings(bare_rule(rule), F.lit(-1))
    else:
        read = pages.withColumn("source", F.col(body))
        found = F.filter(F.array(value(rule)), lambda v: v.isNotNull())
    rows = read.select(page, F.col(url).alias("_url"), F.posexplode(found if all_of_them else F.slice(found, 1, 1)).alias("ix", "_next"))
    return rows.select(page, "ix", U.resolve(F.col("_next"), F.col("_url")).alias("next_url"))


def contents(pages: DataFrame, catalog: list[dict], page: str = "page_id", body: str = "html", url: str = "url", hooks: Hooks | None = None) -> DataFrame:
    """One row a page: its content and the absolute next_url, or null.

    catalog: dicts of source_url, source_ord, content and optionally source_regex (changes of the body before it is read),
    replace_regex (changes of the content) and next (rule of the next page's URL).
    """

    pages = _hooked(pages, body, hooks)

    def changes(s: dict, key: str) -> tuple[list[tuple[str, str]], bool]:
        return rules.split_changes("##" + s[key].removeprefix("##"))[1:] if (s.get(key) or "").strip() else ([], False)

    cleaned, sources = None, sorted({repr(changes(s, "source_regex")) for s in catalog})
    for key in sources:
        some = [s for s in catalog if repr(changes(s, "source_regex")) == key]
        new = rules.changed(F.col(body), *changes(some[0], "source_regex"))
        at = F.col("source_url").isin([s["source_url"] for s in some])
        cleaned = F.when(at, new) if cleaned is None else cleaned.when(at, new)

    def build(s: dict) -> Column:
        text = rules.changed(F.coalesce(content(s["content"]), F.lit("")), *changes(s, "replace_regex"))
        return F.struct(text.alias("content"), (value(s["next"]) if s.get("next") else F.lit(None).cast("string")).alias("next"))

    read = _of_sources(pages.withColumn("_body", cleaned), catalog, "_body", build, lambda s: [s["content"], s.get("next", "")])
    text = _formatted({"content": F.col("found.content")}, F.lit(0), hooks)["content"]
    return read.select(page, "source_ord", text.alias("content"), F.when(F.col("found.next") != "", U.resolve(F.col("found.next"), F.col(url))).alias("next_url"))


def relaxed_json(text: Column) -> Column:
    """JSON in which '<' and '>' outside of strings stand for braces."""
    # possessive, so that a string of any length takes no stack; one that never ends takes the rest
    tokens = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"?+|\'(?:[^\'\\]++|\\.)*+\'?+|[^"\']++'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"') | t.startswith("'"), t).otherwise(F.translate(t, "<>", "{}"))), "")


def explore_kinds(text: Column) -> Column:
    """Categories (structs of title, url and style) of a source: a JSON array, strict or relaxed, else 'title::url' items
    split at '&&' or line ends. Items without title go."""
    schema = "array<struct<title:string,url:string,style:string>>"
    body = F.trim(text)
    strict, relaxed = body, relaxed_json(body)
    read = lambda t: F.when(F.try_parse_json(t).isNotNull() & t.startswith("["), F.from_json(t, schema))
    listed = F.filter(F.coalesce(read(strict), read(relaxed)), lambda k: F.trim(F.coalesce(k["title"], F.lit(""))) != "")
    none = F.lit(None).cast("string")
    plain = F.transform(F.split(body, r"(?:&&|\n)++"), lambda t: F.struct(F.trim(F.regexp_extract(F.trim(t), r"(?s)^(.*?)(?:::|$)", 1)).alias("title"), F.when(F.contains(t, F.lit("::")), F.nullif(F.trim(F.regexp_replace(F.trim(t), r"(?s)^.*?::", "")), F.lit(""))).otherwise(none).alias("url"), none.alias("style")))
    return F.coalesce(listed, F.filter(plain, lambda k: k["title"] != ""))
