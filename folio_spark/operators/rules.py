"""Selection rules over page trees: steps, positions, combinators and extractors as array functions of a page's row.

A rule is steps joined by '@', the last one an extractor: "class.list@tag.li.0@tag.a@text". Steps: tag.x, class.a b,
id.x, .c, #i, [attr], [attr=value], children, text.x; each may end in a position: .0, .-1, !0:2, [0,2,-1], [1:5:2],
[!0,-1]. Combinators: '&&' joins lists, '||' takes the first that is not empty, '%%' interleaves. 'a@@b' reads what a
gives as pages of their own and goes on with b. '##pattern##replacement' at the end changes each value, with a third '#'
(a closing '###') only its first match.

Elements are places in the page's `nodes`; -1 stands for the whole page. A rule needs no join, window or exchange, since
a page is one row. What a rule holds beyond this is refused by name, when the plan is made.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.functions.text import gathered, let, starts

from .shred import trees

TEXTS = ("text", "textNodes", "ownText")
SOURCES = ("html", "all")


class UnsupportedRule(ValueError):
    """A rule that holds something the compiler doesn't express."""


@dataclass
class Step:
    kind: str
    value: str = ""
    picks: list = field(default_factory=list)  # ints, or (start, end, step)
    exclude: bool = False


def _position(text: str) -> tuple[str, list, bool]:
    """Cut a position off the end of a step."""
    if m := re.fullmatch(r"(.*?)\[(!?)((?:-?\d*(?::-?\d*){0,2})(?:,-?\d*(?::-?\d*){0,2})*)\]", text):
        if re.search(r"\d", m[3]):
            picks = []
            for part in m[3].split(","):
                n = [int(x) if x else None for x in part.split(":")]
                picks.append(n[0] if len(n) == 1 else (n[0], n[1], n[2] if len(n) > 2 and n[2] else 1))
            return m[1], picks, bool(m[2])
    if m := re.fullmatch(r"(.+?)([.!])(-?\d+(?::-?\d+)*)", text):
        return m[1], [int(x) for x in m[3].split(":")], m[2] == "!"
    return text, [], False


def parse_step(text: str) -> Step:
    body, picks, exclude = _position(text.strip())
    if body in ("", "children"):
        return Step("children", "", picks, exclude)
    for kind in ("tag", "class", "id", "text"):
        if body.startswith(kind + "."):
            return Step(kind, body[len(kind) + 1 :], picks, exclude)
    if re.fullmatch(r"\.[\w-]+", body):
        return Step("class", body[1:], picks, exclude)
    if re.fullmatch(r"#[\w-]+", body):
        return Step("id", body[1:], picks, exclude)
    if re.fullmatch(r"\[[\w-]+(=[^\]]*)?\]", body):
        return Step("attr", body[1:-1], picks, exclude)
    if re.fullmatch(r"[a-zA-Z][\w-]*", body):
        return Step("tag", body, picks, exclude)
    raise UnsupportedRule(f"step {text!r}")


NO_PLACES, NO_TEXTS = "array<int>", "array<string>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _node(i: Column) -> Column:
    return F.get("nodes", i)


def _span(lo: Column, hi: Column) -> Column:
    """lo..hi, nothing if hi is less."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(_none(NO_PLACES))


def _below(i: Column) -> Column:
    return _span(i + 1, F.when(i < 0, F.size("nodes") - 1).otherwise(_node(i)["last"]))


def _runs(i: Column) -> Column:
    """The shown texts below element i."""
    lo = F.when(i < 0, F.lit(0)).otherwise(_node(i)["run_lo"])
    hi = F.when(i < 0, F.size("runs")).otherwise(_node(i)["run_hi"])
    return F.filter(F.transform(_span(lo, hi - 1), lambda r: F.get("runs", r)), lambda r: r["shown"])


def _matches(step: Step, i: Column) -> Column:
    n = _node(i)
    if step.kind == "tag":
        return n["tag"] == step.value.lower()
    if step.kind == "class":
        has = F.lit(True)
        for c in step.value.split():
            has = has & F.array_contains(F.split(F.coalesce(n["attrs"]["class"], F.lit("")), r"\s+"), c)
        return has
    if step.kind == "id":
        return F.coalesce(n["attrs"]["id"] == step.value, F.lit(False))
    if step.kind == "attr":
        name, eq, value = step.value.partition("=")
        return F.coalesce(n["attrs"][name] == value.strip("'\""), F.lit(False)) if eq else n["attrs"][name].isNotNull()
    own = F.filter(F.transform(_span(n["run_lo"], n["run_hi"] - 1), lambda r: F.get("runs", r)), lambda r: r["owner"] == i)
    return F.contains(F.array_join(F.transform(own, lambda r: F.trim(r["text"])), ""), F.lit(step.value))


def _picked(step: Step, n: Column, at: Callable[[Column], Column]) -> Column:
    """Those of n places, of which at(j) is the jth, that a step's position names, in the position's order."""
    parts = []
    for p in step.picks:
        if isinstance(p, tuple):
            start = F.lit(p[0] if p[0] is not None else (0 if p[2] > 0 else -1))
            end = F.lit(p[1] if p[1] is not None else (-1 if p[2] > 0 else 0))
            lo, hi = (F.greatest(F.lit(0), F.least(n - 1, F.when(x < 0, x + n).otherwise(x))) for x in (start, end))
            parts.append(F.when(n == 0, _none(NO_PLACES)).when(lo <= hi, F.sequence(lo, hi, F.lit(abs(p[2])))).otherwise(F.sequence(lo, hi, F.lit(-abs(p[2])))))
        else:
            parts.append(F.array(F.lit(p) if p >= 0 else n + p))
    named = F.array_distinct(F.concat(*parts)) if len(parts) > 1 or isinstance(step.picks[0], tuple) else parts[0]
    if step.exclude:
        return let(named, lambda a: F.transform(F.filter(_span(F.lit(0), n - 1), lambda j: ~F.array_contains(a, j)), at))
    return F.transform(F.filter(named, lambda j: (j >= 0) & (j < n)), at)


def _step(step: Step, i: Column) -> Column:
    """What a step selects from one element."""
    if step.kind == "children":
        found = F.when(i < 0, F.filter(_below(i), lambda k: _node(k)["parent"] == i)).otherwise(_node(i)["kids"])
    else:
        below = _below(i)
        if step.kind == "text":
            below = F.when(i >= 0, F.concat(F.array(i), below)).otherwise(below)
        found = F.filter(below, lambda k: _matches(step, k))
    return let(found, lambda m: _picked(step, F.size(m), lambda j: F.get(m, j))) if step.picks else found


def _each(step: Step, places: Column) -> Column:
    return F.flatten(F.transform(places, lambda i: _step(step, i)))


def _outermost(places: Column) -> Column:
    """Elements, in the page's order, without those that stand in others of them."""
    return gathered(places, F.lit(-1), lambda end, i: F.greatest(end, _node(i)["last"]), lambda end, i: F.when(i > end, F.array(i)).otherwise(_none(NO_PLACES)), "int")["got"]


def _ranked(step: Step, places: Column) -> Column:
    """A step with a position, from elements that may stand in each other: what matches is found once for all of them, and each
    element's matches are a range of that."""
    first, end = F.array_min(places), F.array_max(F.transform(places, lambda i: _node(i)["last"]))

    def from_flags(z: Column) -> Column:
        found, before, lo = z["found"], z["before"], z["lo"]

        def of(i: Column) -> Column:
            start = F.get(before, i - lo + (0 if step.kind == "text" else 1))
            return let(F.struct(start.alias("at"), (F.get(before, _node(i)["last"] + 1 - lo) - start).alias("n")), lambda r: _picked(step, r["n"], lambda j: F.get(found, r["at"] + j)))

        return F.flatten(F.transform(places, of))

    def flagged(some: Column) -> Column:
        flags = F.transform(some["all"], lambda k: _matches(step, k).cast("int"))
        return let(flags, lambda f: let(F.struct(F.filter(some["all"], lambda k, j: F.get(f, j) == 1).alias("found"), starts(F.array_append(f, F.lit(0))).alias("before"), some["lo"].alias("lo")), from_flags))

    return let(F.struct(F.sequence(first, end).alias("all"), first.alias("lo")), flagged)


def _from_all(step: Step, places: Column) -> Column:
    """What a step selects from several elements. Those that stand in others of them add nothing to a step without position, and
    with one share the search; either way it takes time in proportion to the part of the page."""
    if step.kind == "children":
        return _each(step, places)
    if step.picks:
        return let(places, lambda p: F.when(F.size(p) > 1, _ranked(step, p)).otherwise(_each(step, p)))
    return _each(step, let(places, lambda p: F.when((F.size(p) > 1) & (p == F.array_sort(p)), _outermost(p)).otherwise(p)))


def elements(rule: str, start: Column) -> Column:
    """Places of the elements that the steps of a rule (without extractor) select below element `start`, each once."""
    steps = [parse_step(text) for text in rule.split("@")] if rule else []
    now = F.array(start)
    for at, step in enumerate(steps):
        now = F.array_distinct(_from_all(step, now)) if at else _step(step, start)
    return now


def item_places(rule: str) -> Column:
    """Places of the elements of a list rule, in which combinators join lists."""
    joint = next((j for j in ("&&", "||", "%%") if j in rule), None)
    return _joined([elements(r.strip(), F.lit(-1)) for r in (rule.split(joint) if joint else [rule])], joint)


def _joined(lists: list[Column], joint: str | None) -> Column:
    if joint == "||":
        return lists[0] if len(lists) == 1 else let(lists[0], lambda v: F.when(F.size(v) > 0, v).otherwise(_joined(lists[1:], joint)))
    if joint == "%%":
        return F.flatten(F.transform(F.arrays_zip(*(x.alias(f"b{i}") for i, x in enumerate(lists))), lambda z: F.filter(F.array(*(z[f"b{i}"] for i in range(len(lists)))), lambda v: v.isNotNull())))
    return F.concat(*lists) if len(lists) > 1 else lists[0]


def extracted(extractor: str, i: Column) -> Column:
    """The value of one element; null if it has none."""
    if extractor in TEXTS:
        found = _runs(i)
        if extractor == "ownText":
            found = F.filter(found, lambda r: r["owner"] == i)
        parts = F.filter(F.transform(found, lambda r: F.trim(F.regexp_replace(r["text"], r"\s+", " "))), lambda x: x != "")
        return F.array_join(parts, "\n" if extractor == "textNodes" else " ")
    if extractor in SOURCES:
        return F.when(i < 0, F.col("source")).otherwise(F.substring("source", _node(i)["src_lo"] + 1, _node(i)["src_hi"] - _node(i)["src_lo"]))
    name = extractor[5:-1] if extractor.startswith("attr[") else extractor
    if not re.fullmatch(r"[\w:-]+", name):
        raise UnsupportedRule(f"extractor {extractor!r}")
    return _node(i)["attrs"][name]


def checked_pattern(pattern: str) -> str:
    """The pattern, if it is one that Java and RE2 read alike."""
    if re.search(r"\(\?[=!<]|\\[1-9]|[*+?}]\+", pattern):
        raise UnsupportedRule(f"pattern {pattern!r}: look-around, back-references and possessive repeats are not common to both dialects")
    re.compile(pattern)
    return pattern


def split_changes(rule: str) -> tuple[str, list[tuple[str, str]], bool]:
    """A rule without its '##' part, the pairs of pattern and replacement in that, and whether they change the first match only."""
    rule, mark, tail = rule.partition("##")
    if not mark:
        return rule, [], False
    once = tail.endswith("###")
    parts = tail.removesuffix("###").split("##") if once else tail.split("##")
    return rule, [(checked_pattern(parts[i]), parts[i + 1] if i + 1 < len(parts) else "") for i in range(0, len(parts), 2)], once


def changed(value: Column, changes: list[tuple[str, str]], once: bool = False) -> Column:
    """A value after its replacements. With once, what stands before the first match stays, and that match alone changes."""
    for pattern, new in changes:
        if once:
            hit = F.regexp_extract(value, pattern, 0)
            at = F.regexp_instr(value, F.lit(pattern))
            value = F.when(at > 0, F.concat(F.substring(value, F.lit(1), at - 1), F.regexp_replace(hit, pattern, new), F.substring(value, at + F.length(hit), F.length(value)))).otherwise(value)
        else:
            value = F.regexp_replace(value, pattern, new)
    return value


def _checked(rule: str) -> str:
    if any(x in rule for x in ("<js>", "@js:", "{{", "$.")):
        raise UnsupportedRule(f"rule {rule!r}")
    return rule.strip().removeprefix("@css:").removeprefix("@CSS:")


def strings(rule: str, start: Column) -> Column:
    """All values of a rule below element `start`, as an array; empty and missing ones are left out."""
    rule, changes, once = split_changes(_checked(rule))
    if "@@" in rule:
        raise UnsupportedRule(f"rule {rule!r}: a chain over pages takes values(), not a field")
    joint = next((j for j in ("&&", "||", "%%") if j in rule), None)

    def one(part: str) -> Column:
        steps, _, last = part.rpartition("@")
        if not steps and re.match(r"(tag|class|id|text)\.|[.#\[]", last):
            steps, last = last, "text"
        return F.filter(F.transform(elements(steps, start), lambda i: extracted(last, i)), lambda v: v.isNotNull() & (v != ""))

    found = _joined([one(r.strip()) for r in (rule.split(joint) if joint else [rule])], joint)
    return F.transform(found, lambda v: changed(v, changes, once)) if changes else found


def first(rule: str, start: Column) -> Column:
    """The first value of a rule below element `start`; null if it has none."""
    return F.get(strings(rule, start), F.lit(0))


def select(pages: DataFrame, rule: str, page: str = "page_id") -> DataFrame:
    """page, place and element of all that a rule (without extractor) selects. pages: page trees."""
    return pages.select(page, F.posexplode(item_places(_checked(rule))).alias("place", "element"))


def values(pages: DataFrame, rule: str, page: str = "page_id") -> DataFrame:
    """page, place and value of a rule. pages: page trees. Each '@@' of a rule reads values as pages and tokenises these."""
    head, *more = _checked(rule).split("@@")
    rows = pages.select(page, F.posexplode(strings(head, F.lit(-1))).alias("place", "value"))
    for part in more:
        inner = trees(rows.select(page, F.col("place").alias("_outer"), F.col("value").alias("_html")), "_html")
        found = inner.select(page, "_outer", F.posexplode(strings(part, F.lit(-1))).alias("_inner", "value"))
        # A page's values, in the order of the pages they were read from: one row a page, as before.
        whole = found.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("_outer", "_inner", "value"))).alias("_all"))
        rows = whole.select(page, F.posexplode(F.transform("_all", lambda x: x["value"])).alias("place", "value"))
    return rows.select(page, "place", "value")


def listing(pages: DataFrame, list_rule: str, fields: dict[str, str], page: str = "page_id") -> DataFrame:
    """A row for each element of the list rule ('-' in front reverses the items) with the first value of each field."""
    backward, list_rule = list_rule.startswith("-"), list_rule.lstrip("+-").strip()
    items = item_places(_checked(list_rule))
    rows = F.transform(items, lambda i: F.struct(*(first(r, i).alias(c) for c, r in fields.items())))
    return pages.select(page, F.posexplode(F.reverse(rows) if backward else rows).alias("item_ix", "_f")).select(page, "item_ix", *(F.col(f"_f.{c}").alias(c) for c in fields))
