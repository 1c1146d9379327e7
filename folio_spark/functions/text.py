"""Text: match keys, white space, paragraphs, chunks, keyword in context, numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits and units of written numbers.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
#: Fixed value: delimiters of a group list.
GROUP_DELIMITERS = "[,;；、]"
FALSE_WORDS = ("", "0", "false", "null", "none", "no", "off")


def split_groups(c: Column, delimiters: str = GROUP_DELIMITERS) -> Column:
    """A group list as an array: trimmed, without empty names, each name once, first places kept."""
    return F.array_distinct(F.filter(F.transform(F.split(c, delimiters), lambda x: F.trim(x)), lambda x: x != ""))


def mark_group(c: Column, name: str, present: bool) -> Column:
    """The group list with or without a name; null when no name is left."""
    rest = F.filter(split_groups(F.coalesce(c, F.lit(""))), lambda x: x != name)
    names = F.array_append(rest, F.lit(name)) if present else rest
    return F.when(F.size(names) > 0, F.array_join(names, ","))


def is_truthy(c: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(c)).isin(*FALSE_WORDS), F.lit(False))


def merge_key(name: Column, author: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.trim(F.coalesce(author, F.lit("")))))


def bare_name(c: Column) -> Column:
    """A name without white space, for matching."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")


def bare_author(c: Column) -> Column:
    """An author without white space and a leading label."""
    return F.regexp_replace(bare_name(c), "^(作者|author)[:：]?", "")


def without_punctuation(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{P}\p{S}]+", ""))


def knowledge_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(F.trim(F.coalesce(c, F.lit(""))), "·•・", "..."), r"\s+", ""))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def paragraphs(c: Column) -> Column:
    """Lines without leading indent, blank ones dropped."""
    return F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[\s\x{00A0}\x{3000}]+|\s+$", "")), lambda x: x != "")


def plain_length(html: Column) -> Column:
    """Characters of a page without tags and white space."""
    return F.length(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", ""))


def clean_feed(html: Column) -> Column:
    """Feed content: nothing if it is a whole page, else without script, style and noscript."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    return F.when(html.rlike(r"(?is)<html[\s>]|<!doctype"), "").otherwise(F.trim(bare))


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Items that one growing array takes; characters of a piece of a text that is read by places, and pieces cut at a time.
TOGETHER, PIECE, SHEET = 512, 512, 64


def gathered(xs: Column, start: Column, follow, emit, kind: str) -> Column:
    """Struct of `at`, the state after all of xs (from start by follow(state, x)), and `got`, the arrays of emit(state, x) in one.

    Arrays grow within blocks of items and those are joined once, so the time is in proportion to what xs holds."""
    none = F.array().cast(f"array<{kind}>")

    def inner(block: Column, state: Column) -> Column:
        return F.aggregate(block, F.struct(state.alias("at"), none.alias("got")), lambda a, x: F.struct(follow(a["at"], x).alias("at"), F.concat(a["got"], emit(a["at"], x)).alias("got")))

    def blocks(all_of_them: Column) -> Column:
        ends = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_of_them) / TOGETHER).cast("int") - 1, F.lit(0)))
        return F.transform(ends, lambda i: F.slice(all_of_them, i * TOGETHER + 1, TOGETHER))

    def outer(a: Column, block: Column) -> Column:
        return let(inner(block, a["at"]), lambda r: F.struct(r["at"].alias("at"), F.array_append(a["got"], r["got"]).alias("got")))

    several = F.array().cast(f"array<array<{kind}>>")
    return let(xs, lambda v: F.aggregate(blocks(v), F.struct(start.alias("at"), several.alias("got")), outer, lambda a: F.struct(a["at"].alias("at"), F.flatten(a["got"]).alias("got"))))


def starts(lengths: Column) -> Column:
    """Where each of adjoining parts begins, by their lengths (integers)."""
    return gathered(lengths, F.lit(0), lambda at, n: at + n, lambda at, _: F.array(at), "int")["got"]


def in_pieces(text: Column) -> Column:
    """A text as pieces of equal length, for part(). Cut twice, as each cut reads from the beginning."""

    def cut(whole: Column, size: int, last: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(whole, i * size + 1, F.lit(size)))

    sheet = PIECE * SHEET
    sheets = let(text, lambda t: cut(t, sheet, F.floor(F.length(t) / sheet).cast("int")))
    return F.flatten(F.transform(sheets, lambda t: cut(t, PIECE, F.greatest(F.ceil(F.length(t) / PIECE).cast("int") - 1, F.lit(0)))))


def part(pieces: Column, lo: Column, n: Column) -> Column:
    """n characters from place lo (from 0); of the pieces only those that hold them are read."""
    first = F.floor(lo / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor((lo + n) / PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), lo - first * PIECE + 1, n)


def chunks(c: Column, size: int = 70) -> Column:
    """Sentences packed greedily up to `size` characters. A longer sentence stands alone, cut at its last comma or space
    within that many, or where there is none at that many."""
    text = F.regexp_replace(F.trim(c), r"\n+", "\n")
    sentences = F.filter(F.transform(F.split(text, r"(?<=[。！？!?；;])"), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")

    def cut(s: Column) -> Column:
        """The parts of a long sentence. The state is the place reached; blanks there are passed over first."""

        def of(both: Column) -> Column:
            pieces, end = both["pieces"], both["size"]

            def window(at: Column) -> Column:
                w = part(pieces, at, F.lit(size + 1))
                blank = F.length(w) - F.length(F.ltrim(w))
                stop = F.length(F.regexp_extract(w, r"(?s)^(.*)[，、, ]", 1))
                return F.struct(blank.alias("blank"), F.when(end - at <= size, end - at).when(stop > 0, stop).otherwise(size).alias("n"), F.substring(w, 1, size).alias("w"))

            # two parts together are longer than size but for blanks; a step passes over blanks or takes a part
            steps = F.sequence(F.lit(1), (F.lit(4) * F.ceil(end / size)).cast("int") + 4)
            follow = lambda at, _: F.when(at >= end, at).otherwise(let(window(at), lambda x: at + F.when(x["blank"] > 0, x["blank"]).otherwise(x["n"])))
            emit = lambda at, _: F.when(at >= end, none).otherwise(let(window(at), lambda x: F.when(x["blank"] > 0, none).otherwise(F.array(F.trim(F.substring(x["w"], F.lit(1), x["n"]))))))
            return F.filter(gathered(steps, F.lit(0), follow, emit, "string")["got"], lambda x: x != "")

        return let(F.struct(in_pieces(s).alias("pieces"), F.length(s).alias("size")), of)

    def follow(current: Column, s: Column) -> Column:
        return F.when(F.length(s) > size, "").when(F.length(current) + F.length(s) > size, s).otherwise(F.concat(current, s))

    def emit(current: Column, s: Column) -> Column:
        sent = F.when(current != "", F.array(current)).otherwise(none)
        return F.when(F.length(s) > size, F.concat(sent, cut(s))).when(F.length(current) + F.length(s) > size, sent).otherwise(none)

    return let(gathered(sentences, F.lit(""), follow, emit, "string"), lambda z: F.when(z["at"] != "", F.array_append(z["got"], z["at"])).otherwise(z["got"]))


def in_context(text: Column, keyword: str, around: int = 18, limit: int | None = None) -> Column:
    """Snippets around each case-insensitive place of a keyword, or the first `limit`: structs of place (1, 2, ...), at and snippet."""
    n = len(keyword)
    none = F.array().cast("array<struct<place:int,at:int,snippet:string>>")

    def found(both: Column) -> Column:
        flat, size = both["flat"], both["size"]
        between = F.transform(F.split(F.lower(flat), "\\Q" + keyword.lower() + "\\E", -1), lambda p: F.length(p) + n)
        count = F.size(between) - 1 if limit is None else F.least(F.size(between) - 1, F.lit(limit))
        places = F.slice(F.transform(starts(between), lambda x: x - n), 2, count)  # each stands before the part that begins there

        def snippets(pieces: Column) -> Column:
            def snippet(at: Column, i: Column) -> Column:
                lo, hi = F.greatest(at - around, F.lit(0)), F.least(at + n + around, size)
                body = F.concat(F.when(lo > 0, "…").otherwise(""), part(pieces, lo, hi - lo), F.when(hi < size, "…").otherwise(""))
                return F.struct((i + 1).alias("place"), at.alias("at"), body.alias("snippet"))

            return F.transform(places, snippet)

        return let(in_pieces(flat), snippets)

    flat = collapse_space(text)
    hits = let(flat, lambda t: let(F.struct(t.alias("flat"), F.length(t).alias("size")), found))
    return F.when(F.contains(F.lower(text), F.lit(keyword.lower().split()[0] if keyword.split() else keyword)), F.coalesce(hits, none)).otherwise(none)


def written_number(c: Column) -> Column:
    """The value of a number written in Arabic or Chinese numerals (up to 万); null if it is none."""
    digit, unit = (F.create_map(*(F.lit(x) for kv in m.items() for x in kv)) for m in (DIGITS, UNITS))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("number"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        d, u = F.try_element_at(digit, x), F.try_element_at(unit, x)
        big = x == "万"
        section = F.when(u.isNotNull(), a["section"] + F.when(a["number"] == 0, 1).otherwise(a["number"]) * u).otherwise(a["section"])
        return F.struct(
            F.when(big, a["total"] + (a["section"] + a["number"]) * 10000).otherwise(a["total"]).alias("total"),
            F.when(big, 0).otherwise(section).alias("section"),
            F.when(d.isNotNull(), d).otherwise(0).alias("number"),
            (a["ok"] & (d.isNotNull() | u.isNotNull() | big)).alias("ok"),
        )

    chars = F.filter(F.split(c, ""), lambda x: x != "")
    value = F.aggregate(chars, start, step, lambda a: F.when(a["ok"], a["total"] + a["section"] + a["number"]))
    return F.coalesce(c.try_cast("int"), F.when(F.length(c) > 0, value))


def chapter_ordinal(title: Column) -> Column:
    """The number of a chapter in its title; null if the title has none."""
    number = F.regexp_extract(title, r"第\s*([0-9]{1,5}|[零〇一二两三四五六七八九十百千万]+)\s*[章节回话集部卷篇]", 1)
    other = F.regexp_extract(title, r"(?i)^\s*(?:chapter\s*)?([0-9]{1,5})\b", 1)
    return F.coalesce(F.when(number != "", written_number(number)), other.try_cast("int"))


def map_characters(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Characters replaced by a map; of a repeated source character the last mapping holds."""
    last = dict(pairs)
    return F.translate(c, "".join(last), "".join(last.values()))


def importance_rank(c: Column) -> Column:
    key = knowledge_key(c)
    return F.when(key.rlike("high|高"), 3).when(key.rlike("medium|中"), 2).when(key.rlike("low|低|低重要性|不重要|路人|背景|minor|background|oneoff|一次性"), 1).otherwise(0)


def safe_file_name(c: Column) -> Column:
    """The last part of a path, trimmed; 'book.txt' where that is empty."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(c, r"([^/\\\\]*)[/\\\\]*$", 1)), F.lit("")), F.lit("book.txt"))


def title_from_file_name(c: Column) -> Column:
    """A book's title from its file's name, without extension."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(safe_file_name(c), r"(?<=.)\.[^.]*$", "")), F.lit("")), F.lit("本地小说"))


def replace_rules(text: Column, rules: Column) -> Column:
    """Ordered rules (structs of pattern, replacement, is_regex) applied one after the other; ^ and $ meet lines."""
    return F.aggregate(rules, text, lambda acc, r: F.when(r["is_regex"], F.regexp_replace(acc, F.concat(F.lit("(?m)"), r["pattern"]), r["replacement"])).otherwise(F.replace(acc, r["pattern"], r["replacement"])))


def limit_summary(c: Column, most: int = 1200) -> Column:
    """A long summary as its first 55 % and its end, with an ellipsis between."""
    head = int((most - 2) * 0.55)
    t = F.trim(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, head), F.lit("……"), F.right(t, F.lit(most - head - 2)))).otherwise(t)


#: Beginnings by which the summary of one chapter is told.
RECAPS = ("^(?:本章|本节|这一章)[：:，,]\\s*", "^第\\s*(?:\\d+|[零〇一二两三四五六七八九十百千万]+)\\s*[章节回话卷篇][^。！？；]{0,40}[：:]\\s*")


def looks_like_recap(c: Column) -> Column:
    """A summary of one chapter rather than of the story so far."""
    return F.trim(c).rlike(RECAPS[0]) | F.trim(c).rlike(RECAPS[1])


def next_summary(previous: Column, new: Column) -> Column:
    """The new summary, cut to length; the previous one if the new is empty or retells one chapter. A first summary loses
    such a beginning instead."""
    old, new = F.trim(F.coalesce(previous, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(new, RECAPS[0], ""), RECAPS[1], ""))
    return F.when(new == "", limit_summary(old)).when(old == "", limit_summary(bare)).when(looks_like_recap(new), limit_summary(old)).otherwise(limit_summary(new))


def json_text(v: Column) -> Column:
    """A JSON value (variant) as text: arrays joined by line breaks, null and missing ones as null."""
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("ARRAY"), F.array_join(F.from_json(F.to_json(v), "array<string>"), "\n")).when(kind.startswith("OBJECT"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def ordered_rules(rules: Column, source: Column, book: Column, name: Column, url: Column) -> Column:
    """The rules (structs of place, pattern, replacement, is_regex, scope, enabled) that hold for a text, in order."""

    def holds(r: Column) -> Column:
        scope = F.trim(F.coalesce(r["scope"], F.lit("")))
        named = F.trim(F.substring_index(scope, ";", 1)) == name
        at = F.trim(F.regexp_replace(scope, "^[^;]*;?", ""))
        both = named & ((at == "") | (at == url))
        return scope.isin("", "*") | (scope == F.concat(F.lit("source:"), source)) | (scope == F.concat(F.lit("book:"), book)) | (~F.contains(scope, F.lit(":")) & both) | (F.contains(scope, F.lit(";")) & both)

    kept = F.filter(rules, lambda r: F.coalesce(r["enabled"], F.lit(True)) & F.coalesce(holds(r), F.lit(False)) & (F.coalesce(r["pattern"], F.lit("")) != ""))
    return F.array_sort(kept, lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
