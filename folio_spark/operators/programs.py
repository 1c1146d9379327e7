"""Rules as data: a catalog of any number of rule sets is a table of programs, and one plan runs them all.

A rule is parsed where its row is, into structs: steps with their positions, an extractor, a JSON path, changes of the value,
the groups of a pattern. A page meets its sources' programs in a join, and array functions interpret them: the plan is the
same for three rule sets and for a million. A page that many sources read is one row with a list of them: programs are
gathered by such list, pages meet those, so a page is shuffled and tokenised once however many programs read it (and not
at all tokenised if none of them selects). Programs are as many as sources, so no join broadcasts them by an estimate.

Programs hold selection rules (also by the body: JSON or page), JSON paths and all-in-one patterns. XPath, variables, templates
and scripts, which only columns of a plan express, and chains over pages make a program's `error` say so; the sources that
have one give no rows here and are for `extract`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio_spark.functions import text as X
from folio_spark.functions import urls as U
from folio_spark.functions.text import let

from . import extract, rules
from .shred import trees

STEP = "struct<kind:string,value:string,other:string,picks:array<struct<lo:int,hi:int,by:int>>,exclude:boolean>"
PART = f"struct<steps:array<{STEP}>,take:string,arg:string>"
CHANGE = "struct<pattern:string,new:string>"
RULE = f"struct<mode:string,joint:string,parts:array<{PART}>,path:string,keys:array<struct<name:string,item:int>>,literal:string,pieces:array<struct<group:int,text:string>>,changes:array<{CHANGE}>,once:boolean,back:boolean>"
#: Fields of a listing, in their order.
LISTED = ("name", "author", "book_url", "cover_url", "intro", "kind", "last_chapter", "update_time", "word_count")


def _step(text: str) -> dict:
    s = rules.parse_step(text)
    name, eq, value = s.value.partition("=") if s.kind == "attr" else (s.value.lower() if s.kind == "tag" else s.value, "", None)
    picks = [{"lo": p[0], "hi": p[1], "by": p[2]} if isinstance(p, tuple) else {"lo": p, "hi": None, "by": 0} for p in s.picks]
    return {"kind": "equal" if eq else s.kind, "value": name, "other": value.strip("'\"") if eq else None, "picks": picks, "exclude": s.exclude}


def _steps(text: str) -> list[dict]:
    return [_step(t) for t in text.split("@")] if text else []


@lru_cache(maxsize=4096)
def _part(text: str, is_list: bool) -> dict:
    if is_list:
        return {"steps": _steps(text), "take": None, "arg": None}
    steps, _, last = text.rpartition("@")
    if not steps and re.match(r"(tag|class|id|text)\.|[.#\[]", last):
        steps, last = last, "text"
    if last in rules.TEXTS + rules.SOURCES:
        return {"steps": _steps(steps), "take": last, "arg": None}
    name = last[5:-1] if last.startswith("attr[") else last
    if not re.fullmatch(r"[\w:-]+", name):
        raise rules.UnsupportedRule(f"extractor {last!r}")
    return {"steps": _steps(steps), "take": "attr", "arg": name}


def _keys(path: str) -> list[dict] | None:
    """The steps of a path of names and numbers; null if it holds others."""
    try:
        steps = extract.json_steps(path)
    except rules.UnsupportedRule:
        return None
    if any(kind not in ("key", "item") or (kind == "item" and int(x) >= 1 << 31) for kind, x in steps):
        return None
    return [{"name": x if kind == "key" else None, "item": int(x) if kind == "item" else None} for kind, x in steps]


def parse_rule(text: str, is_list: bool = False, of: str | None = None) -> dict:
    """A rule as a program. of: the mode of the list rule whose field it is."""
    mode = of if of == extract.REGEX else extract.mode_of(text)
    if mode == extract.XPATH or "@@" in text or "@put:" in text or "@get:" in text or "{{" in text or "{$" in text:
        raise rules.UnsupportedRule(f"rule {text!r}: XPath, variables, templates and chains over pages are no programs")
    out = {"mode": mode, "joint": None, "parts": [], "path": None, "keys": None, "literal": None, "pieces": [], "changes": [], "once": False, "back": is_list and text.strip().startswith("-")}
    bare = text if mode == extract.REGEX and not is_list else extract.bare_rule(text)
    if not (mode == extract.REGEX and is_list):
        bare, changes, out["once"] = rules.split_changes(bare)
        out["changes"] = [{"pattern": p, "new": n} for p, n in changes]
    if mode == extract.REGEX:
        if is_list:
            out["literal"] = rules.checked_pattern(bare)
        else:
            out["pieces"] = [{"group": int(p[1:]) if re.fullmatch(r"\$[1-9]\d?", p) else None, "text": p} for p in re.split(r"(\$[1-9]\d?)", bare) if p]
        return out
    if mode in (extract.JSON, extract.AUTO):
        if not is_list and any(c in bare for c in "/?&=,"):
            out["literal"] = bare
        elif mode == extract.JSON or ".." not in bare:
            out["path"] = extract.json_path(bare)
            if extract.is_deep(out["path"]):
                raise rules.UnsupportedRule(f"rule {text!r}: scans are no programs")
            out["keys"] = _keys(out["path"])
    if mode != extract.JSON:
        joint = next((j for j in ("&&", "||", "%%") if j in bare), None)
        try:
            out["joint"], out["parts"] = joint, [_part(r.strip(), is_list) for r in (bare.split(joint) if joint else [bare])]
        except rules.UnsupportedRule:
            if mode == extract.CSS or out["path"] is None:
                raise
    return out


@lru_cache(maxsize=4096)
def _parsed(text: str, is_list: bool, of: str | None) -> tuple[str, str]:
    """Mode and text of a rule's program; sources share most of their rules."""
    rule = parse_rule(text, is_list, of)
    return rule["mode"], json.dumps(rule)


def compiled(catalog: DataFrame, list_col: str | None, fields_col: str, names: tuple[str, ...] = LISTED) -> DataFrame:
    """catalog, for its rules, with `items` (the list rule's program), `fields` (a program for each of names, or null) and `error`.

    list_col: a column of list rules (null: fields of whole pages); fields_col: maps of rules by name."""
    kept = catalog.select(*catalog.columns, (F.col(list_col) if list_col else F.lit(None).cast("string")).alias("_list"), F.col(fields_col).alias("_rules"))
    keys = [c for c, t in catalog.dtypes if c not in (list_col, fields_col) and "map<" not in t and "variant" not in t]
    kept = kept.repartition(*keys) if keys else kept  # a catalog is a small file, often of one split; its rules take time

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for list_rule, fields in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                own = {k: v for k, v in dict(fields or []).items() if v and v.strip()}
                try:
                    of, items = _parsed(list_rule, True, None) if list_rule and list_rule.strip() else (None, "null")
                    out.append((f'{{"items":{items},"fields":[{",".join(_parsed(own[n], False, of)[1] if n in own else "null" for n in names)}]}}', None))
                except (rules.UnsupportedRule, re.error) as e:
                    out.append((None, str(e)))
            arrays = [pa.array([x[i] for x in out], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *arrays], [*b.schema.names[:-2], "_program", "error"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in catalog.dtypes), "_program string", "error string"])
    program = F.from_json("_program", f"items {RULE}, fields array<{RULE}>")
    return kept.mapInArrow(parse, schema).withColumn("_p", program).select(*(c for c in catalog.columns if c not in (list_col, fields_col)), "_p.items", "_p.fields", "error")


def _matches(step: Column, i: Column) -> Column:
    n = rules._node(i)
    kind, value = step["kind"], step["value"]
    own = F.filter(F.transform(rules._span(n["run_lo"], n["run_hi"] - 1), lambda r: F.get("runs", r)), lambda r: r["owner"] == i)
    return (
        F.when(kind == "tag", n["tag"] == value)
        .when(kind == "class", F.forall(F.filter(F.split(value, " "), lambda c: c != ""), lambda c: F.array_contains(F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+"), c)))
        .when(kind == "id", F.coalesce(n["attrs"]["id"] == value, F.lit(False)))
        .when(kind == "attr", F.try_element_at(n["attrs"], value).isNotNull())
        .when(kind == "equal", F.coalesce(F.try_element_at(n["attrs"], value) == step["other"], F.lit(False)))
        .otherwise(F.contains(F.array_join(F.transform(own, lambda r: F.trim(r["text"])), ""), value))
    )


def _picked(step: Column, found: Column) -> Column:
    """The places of found that a step's positions name, in the positions' order."""

    def named(m: Column) -> Column:
        n = F.size(m)

        def one(p: Column) -> Column:
            start = F.coalesce(p["lo"], F.when(p["by"] > 0, 0).otherwise(-1))
            end = F.coalesce(p["hi"], F.when(p["by"] > 0, -1).otherwise(0))
            lo, hi = (F.greatest(F.lit(0), F.least(n - 1, F.when(x < 0, x + n).otherwise(x))) for x in (start, end))
            span = F.when(n == 0, F.array().cast("array<int>")).when(lo <= hi, F.sequence(lo, hi, F.abs(p["by"]))).otherwise(F.sequence(lo, hi, -F.abs(p["by"])))
            return F.when(p["by"] == 0, F.array(F.when(p["lo"] < 0, p["lo"] + n).otherwise(p["lo"]))).otherwise(span)

        at = F.array_distinct(F.flatten(F.transform(step["picks"], one)))
        kept = F.transform(F.filter(at, lambda j: (j >= 0) & (j < n)), lambda j: F.get(m, j))
        return F.when(step["exclude"], let(at, lambda a: F.filter(m, lambda x, j: ~F.array_contains(a, j)))).otherwise(kept)

    return F.when(F.size(step["picks"]) == 0, found).otherwise(let(found, named))


def _from(step: Column, i: Column) -> Column:
    kids = F.when(i < 0, F.filter(rules._below(i), lambda k: rules._node(k)["parent"] == i)).otherwise(rules._node(i)["kids"])
    own = F.when((step["kind"] == "text") & (i >= 0), F.array(i)).otherwise(F.array().cast("array<int>"))
    return _picked(step, F.when(step["kind"] == "children", kids).otherwise(F.filter(F.concat(own, rules._below(i)), lambda k: _matches(step, k))))


def elements(steps: Column, start: Column) -> Column:
    """Places of the elements that steps (an array of structs) select below element start, each once."""

    def step(now: Column, s: Column) -> Column:
        plain = (F.size(s["picks"]) == 0) & (s["kind"] != "children")
        outer = F.when(plain & (F.size(now) > 1) & (now == F.array_sort(now)), rules._outermost(now)).otherwise(now)
        return F.array_distinct(F.flatten(F.transform(outer, lambda i: _from(s, i))))

    return F.aggregate(steps, F.array(start), step)


def _joined(rule: Column, lists: Column) -> Column:
    def of(some: Column) -> Column:
        longest = F.array_max(F.transform(some, lambda x: F.size(x)))
        between = F.flatten(F.transform(rules._span(F.lit(0), longest - 1), lambda j: F.filter(F.transform(some, lambda x: F.get(x, j)), lambda v: v.isNotNull())))
        return F.when(rule["joint"] == "||", F.coalesce(F.get(F.filter(some, lambda x: F.size(x) > 0), F.lit(0)), F.get(some, F.lit(0)))).when(rule["joint"] == "%%", between).otherwise(F.flatten(some))

    return let(lists, of)


def places(rule: Column) -> Column:
    """Places of the elements of a list rule."""
    return _joined(rule, F.transform(rule["parts"], lambda p: elements(p["steps"], F.lit(-1))))


def _taken(part: Column, i: Column) -> Column:
    take = part["take"]
    return (
        F.when(take == "attr", F.try_element_at(rules._node(i)["attrs"], part["arg"]))
        .when(take == "text", rules.extracted("text", i))
        .when(take == "textNodes", rules.extracted("textNodes", i))
        .when(take == "ownText", rules.extracted("ownText", i))
        .otherwise(rules.extracted("html", i))
    )


def changed(rule: Column, value: Column) -> Column:
    """A value after a rule's changes, all of them or (once) of each the first match."""

    def one(v: Column, c: Column) -> Column:
        hit, at = F.regexp_substr(v, c["pattern"]), F.regexp_instr(v, c["pattern"])
        first = F.concat(F.substring(v, F.lit(1), at - 1), F.regexp_replace(hit, c["pattern"], c["new"]), F.substring(v, at + F.length(hit), F.length(v)))
        return F.when(~rule["once"], F.regexp_replace(v, c["pattern"], c["new"])).when(at > 0, first).otherwise(v)

    return F.aggregate(rule["changes"], value, one)


def strings(rule: Column, start: Column) -> Column:
    """All values of a selection rule below element start; empty and missing ones are left out."""
    found = F.transform(rule["parts"], lambda p: F.filter(F.transform(elements(p["steps"], start), lambda i: _taken(p, i)), lambda v: v.isNotNull() & (v != "")))
    return F.transform(_joined(rule, found), lambda v: changed(rule, v))


def _at(value: Column, key: Column) -> Column:
    """What a step of names and numbers finds in a JSON value (variant)."""
    named = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), key["name"])
    return F.when(key["name"].isNotNull(), named).otherwise(F.get(F.try_variant_get(value, "$", "array<variant>"), key["item"]))


def json_value(rule: Column, item: Column, parsed: Column) -> Column:
    """The value of a JSON field: a literal, or what its path gives, arrays as lines. parsed: item as a variant.

    Steps parsed with the rule are walked; a path as text would be parsed for each value."""
    path = rule["path"]
    starred = F.call_function("get_json_object", item, path)
    lines = F.when(starred.startswith("["), F.array_join(F.from_json(starred, "array<string>"), "\n")).otherwise(starred)
    walked = F.when(rule["keys"].isNotNull(), F.aggregate(rule["keys"], parsed, _at)).otherwise(F.call_function("try_variant_get", parsed, path, F.lit("variant")))
    found = F.when(rule["literal"].isNotNull(), rule["literal"]).when(F.contains(path, F.lit("*")), lines).when(path.isNotNull(), let(walked, X.json_text))
    return F.nullif(changed(rule, found), F.lit(""))


def _json_values(fields: Column, item: Column) -> Column:
    return let(F.try_parse_json(item), lambda v: _values(fields, lambda f: json_value(f, item, v)))


def _css(rule: Column, i: Column) -> Column:
    return F.when(~rule["mode"].isin("json", "xpath"), F.get(strings(rule, i), F.lit(0)))


def _values(fields: Column, value) -> Column:
    return F.transform(fields, lambda f: F.when(f.isNotNull(), value(f)))


def rows_of(body: Column, items: Column, fields: Column, names: tuple[str, ...]) -> Column:
    """The rows of a list rule: arrays of values in the order of names."""
    none = F.array().cast("array<array<string>>")

    def by_path() -> Column:
        found = F.call_function("get_json_object", body, items["path"])
        each = F.when(found.startswith("["), F.from_json(found, "array<string>")).otherwise(F.filter(F.array(found), lambda x: x.isNotNull()))
        return F.transform(each, lambda x: _json_values(fields, x))

    def by_pattern() -> Column:
        used = F.array_distinct(F.filter(F.flatten(F.transform(fields, lambda f: F.transform(F.coalesce(f["pieces"], F.array().cast("array<struct<group:int,text:string>>")), lambda p: p["group"]))), lambda g: g.isNotNull()))
        matched = let(F.array_append(used, F.lit(0)), lambda gs: F.map_from_arrays(gs, F.transform(gs, lambda g: F.regexp_extract_all(F.coalesce(body, F.lit("")), items["literal"], g))))

        def rows(groups: Column) -> Column:
            count = F.size(groups[F.lit(0)])
            one = lambda f, j: changed(f, F.array_join(F.transform(f["pieces"], lambda p: F.when(p["group"].isNotNull(), F.get(F.try_element_at(groups, p["group"]), j)).otherwise(p["text"])), ""))
            found = F.transform(rules._span(F.lit(0), count - 1), lambda j: _values(fields, lambda f: one(f, j)))
            return F.filter(found, lambda r: F.coalesce(F.get(r, F.lit(names.index("name"))), F.lit("x")) != "") if "name" in names else found

        return let(matched, rows)

    css = F.transform(places(items), lambda i: _values(fields, lambda f: _css(f, i)))
    as_json = (items["mode"] == "json") | ((items["mode"] == "auto") & extract.is_json(body))
    found = F.when(items.isNull(), none).when(items["mode"] == "regex", by_pattern()).when(as_json, by_path()).otherwise(css)
    return let(F.coalesce(found, none), lambda r: F.when(F.coalesce(items["back"], F.lit(False)), F.reverse(r)).otherwise(r))


def record(body: Column, fields: Column) -> Column:
    """The values of a whole page; the first field that there is gives the mode."""
    lead = F.get(F.filter(fields, lambda f: f.isNotNull()), F.lit(0))["mode"]
    as_json = (lead == "json") | ((lead == "auto") & extract.is_json(body))
    return F.when(as_json, _json_values(fields, body)).otherwise(_values(fields, lambda f: _css(f, F.lit(-1))))


def read(pages: DataFrame, programs: DataFrame, body: str = "html", source: str = "source_url") -> DataFrame:
    """A row for each page and program of one of its sources, as trees where a program of the page selects; `reader` is the
    source's place. source: a column of a source, or of a list of them. Programs with errors have no pages here."""
    selects = lambda r: ~r["mode"].isin("json", "regex")
    tree = F.coalesce(selects(F.col("items")), F.lit(False)) | F.coalesce(F.exists("fields", lambda f: f.isNotNull() & selects(f)), F.lit(False))
    good = programs.where("error is null").select(F.col(source).alias("_source"), F.struct(*(c for c in programs.columns if c != source)).alias("_own"), tree.alias("_tree"))
    listed = pages.withColumn("_by", F.col(source) if isinstance(pages.schema[source].dataType, T.ArrayType) else F.array(source)).drop(source)
    wanted = listed.select("_by").distinct().select("_by", F.posexplode("_by").alias("reader", "_source"))
    met = wanted.join(good.hint("merge"), "_source").groupBy("_by").agg(F.collect_list(F.struct("reader", F.col("_source").alias(source), "_own")).alias("_programs"), F.bool_or("_tree").alias("_tree"))
    rows = trees(listed.join(met, "_by").drop("_by"), body, "_tree").drop("_tree")
    return rows.select(*rows.columns, F.explode("_programs").alias("_p")).drop("_programs").select("*", "_p.reader", f"_p.{source}", "_p._own.*").drop("_p")


def search(pages: DataFrame, programs: DataFrame, names: tuple[str, ...] = LISTED, page: str = "page_id", body: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """page, item_ix, source_url, names: the listings of all pages by their sources' programs; book and cover URLs made absolute."""
    rows = read(pages, programs, body).select(page, "source_url", *keep, F.col(url).alias("_url"), F.posexplode(rows_of(F.col("source"), F.col("items"), F.col("fields"), names)).alias("item_ix", "_f"))
    value = lambda n: F.get("_f", F.lit(names.index(n)))
    absolute = {n: U.resolve(F.coalesce(value(n), F.lit("")), F.col("_url")) if n == "book_url" else F.when(value(n) != "", U.resolve(value(n), F.col("_url"))) if n == "cover_url" else value(n) for n in names}
    return rows.select(page, "item_ix", "source_url", *keep, *(v.alias(n) for n, v in absolute.items()))


def details(pages: DataFrame, programs: DataFrame, names: tuple[str, ...] = LISTED, page: str = "page_id", body: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """page, source_url, names: one row a page, its fields by its source's program."""
    rows = read(pages, programs, body).select(page, "source_url", *keep, record(F.col("source"), F.col("fields")).alias("_f"))
    return rows.select(page, "source_url", *keep, *(F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)))
