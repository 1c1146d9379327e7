"""Chapters: headings, tables of contents, ordinals, page walks, stitching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio_spark.functions.text import chapter_ordinal, let, starts

#: A heading line of a text book.
HEADING = r"^\s*(?:第\s*[0-9零〇一二两三四五六七八九十百千万]+\s*[章节回卷部篇]|(?i:chapter)\s+[0-9IVXLC]+\b|(?:序章|楔子|引子|尾声|后记)\s*$)"
PREFACE, WHOLE = "序章", "正文"
#: Words in titles of announcements and extras that are no part of the story, and titles that are.
SKIPPED = "番外|外传|新书|新番外|公告|通知|说明|感言|请假|断更|恢复更新|更新时间|求票|月票|推荐票|打赏|推书|书友群|群号|活动|抽奖|实体书|出版|完本|上架"
KEPT = "^(序章|楔子|引子|序|前言)$"


def _parts(lines: Column, heading: Column, part: Callable[[Column, Column, Column], Column]) -> Column:
    """part(first line behind the heading, number of lines, heading's place or -1) of what stands before the first heading and of
    every chapter. heading: whether each line is one."""
    at = lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i))
    bounds = lambda heads: F.transform(F.concat(F.array(F.lit(-1)), heads), lambda h, j: part(h + 1, F.coalesce(F.get(heads, j), F.size(lines)) - h - 1, h))
    return let(let(heading, at), bounds)


def split_chapters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heading: str = HEADING, longest: int = 80) -> DataFrame:
    """id, idx, title, content, char_start: chapters of each text. Text before the first heading is a preface; a text
    without headings is one chapter. Chapters without content stay. A text is one row: nothing moves."""

    def of(lines: Column) -> Column:
        is_heading = F.transform(lines, lambda x: (F.length(F.trim(x)) <= longest) & x.rlike(heading))

        def chapters(begin: Column) -> Column:
            one = lambda lo, n, h: F.struct(F.when(h >= 0, F.trim(F.get(lines, h))).alias("title"), F.trim(F.array_join(F.slice(lines, lo + 1, n), "\n")).alias("content"), F.when(h >= 0, F.get(begin, h)).otherwise(0).cast("long").alias("char_start"))
            return _parts(lines, is_heading, one)

        return let(starts(F.transform(lines, lambda x: F.length(x) + 1)), chapters)

    found = let(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), of)
    kept = F.filter("_c", lambda c, j: (j > 0) | (c["content"] != ""))
    rows = docs.select(id_col, found.alias("_c")).select(id_col, (F.size("_c") == 1).alias("_one"), F.posexplode(kept).alias("idx", "c"))
    return rows.select(id_col, "idx", F.coalesce("c.title", F.when(F.col("_one"), WHOLE).otherwise(PREFACE)).alias("title"), "c.content", "c.char_start")


#: Fixed value: a heading line, by number and unit, alone or with a title that doesn't end like a sentence.
NUMBERED = r"^(?:第[\p{N}零〇一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟]+[章节回卷部集篇]|卷[\p{N}零〇一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟]+)(?:$|[\s:：、.．\-—].*|[^\s:：、.．\-—](?:.*[^。！？!?；;，,、])?)$"


def text_chapters(books: DataFrame, heading: str = NUMBERED, longest: int = 80) -> DataFrame:
    """book_url, idx, title, url (book_url#idx), start, end (code points, end exclusive) and content of text books.

    books: book_url, text. Contents are the text from behind the heading's line to the next heading, without line breaks
    at their end; start and end are those of the content. Text before the first heading is a preface; a text without
    headings is one chapter; chapters without content stay.
    """
    line = lambda raw: F.regexp_replace(raw, "\r+$", "")
    title = lambda raw: F.regexp_replace(line(raw), r"^[\s\x{3000}\x{00A0}]+|[\s\x{3000}\x{00A0}]+$", "")

    def of(z: Column) -> Column:
        lines, size = z["lines"], z["size"]
        is_heading = F.transform(lines, lambda raw: let(title(raw), lambda t: (t != "") & (F.length(t) <= longest) & t.rlike(heading)))

        def chapters(begin: Column) -> Column:
            behind = lambda h: F.when(h >= 0, F.least(F.get(begin, h) + F.length(F.get(lines, h)) + 1, size)).otherwise(0)
            one = lambda lo, n, h: F.struct(F.when(h >= 0, title(F.get(lines, h))).alias("title"), behind(h).alias("start"), F.array_join(F.slice(lines, lo + 1, n), "\n").alias("body"))
            return _parts(lines, is_heading, one)

        return let(starts(F.transform(lines, lambda x: F.length(x) + 1)), chapters)

    text = F.coalesce("text", F.lit(""))
    found = let(F.struct(F.split(text, "\n").alias("lines"), F.length(text).alias("size")), of)
    none = F.col("_one")
    bare = lambda c: F.when(none, c["body"]).otherwise(F.regexp_replace(c["body"], "[\r\n]+$", ""))
    kept = F.filter(F.transform("_c", lambda c: F.struct(c["title"].alias("title"), c["start"].alias("start"), bare(c).alias("content"))), lambda c, j: (j > 0) | (F.trim(F.regexp_replace(c["content"], r"\s+", "")) != "") | none)
    rows = books.select("book_url", found.alias("_c")).withColumn("_one", F.size("_c") == 1).select("book_url", "_one", F.posexplode(kept).alias("idx", "c"))
    named = F.coalesce("c.title", F.when(none, WHOLE).otherwise(PREFACE))
    return rows.select("book_url", "idx", named.alias("title"), F.concat(F.regexp_replace("book_url", "#+$", ""), F.lit("#"), F.col("idx").cast("string")).alias("url"), F.col("c.start").cast("long").alias("start"), (F.col("c.start") + F.length("c.content")).cast("long").alias("end"), "c.content")


def assemble_toc(rows: DataFrame, book: str = "book", reverse: bool = False) -> DataFrame:
    """Items of all pages in order, each URL once (its first place), numbered from 0. rows: book, page_ord, item_ix, url, title."""
    first = rows.groupBy(book, "url").agg(F.min(F.struct("page_ord", "item_ix", "title")).alias("f"))
    order = [F.col("f.page_ord"), F.col("f.item_ix"), F.col("url")]
    w = W.partitionBy(book).orderBy(*([c.desc() for c in order] if reverse else order))
    return first.select(book, (F.row_number().over(w) - 1).alias("idx"), "url", F.col("f.title").alias("title"))


def repeated_pages(rows: DataFrame, book: str = "book") -> DataFrame:
    """Pages all of whose URLs stand on earlier pages of the book."""
    first = rows.groupBy(book, "url").agg(F.min("page_ord").alias("first_page"))
    return rows.join(first, [book, "url"]).groupBy(book, "page_ord").agg(F.every(F.col("first_page") < F.col("page_ord")).alias("repeated")).where("repeated").select(book, "page_ord")


def front_loaded(rows: DataFrame, book: str, idx: str, title: str) -> DataFrame:
    """rows with `front`: a late chapter that a list shows before its first ones."""
    numbered = rows.withColumn("ordinal", chapter_ordinal(F.col(title)))
    own = W.partitionBy(book)
    first = F.min(F.when(F.col("ordinal") == 1, F.col(idx))).over(own)
    soon = F.min("ordinal").over(own.orderBy(idx).rowsBetween(1, 19)) <= 10
    front = (F.col(idx) <= 30) & (F.col("ordinal") >= 50) & (F.coalesce(F.col(idx) < first, F.lit(False)) | F.coalesce(soon, F.lit(False)))
    return numbered.withColumn("front", F.coalesce(front, F.lit(False)))


def title_matches(title: Column, search: str) -> Column:
    """A search among titles; a blank one finds all."""
    return F.contains(F.lower(title), F.lit(search.strip().lower()))


def bare_title(title: Column) -> Column:
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"[\s【】《》（）()]+", "")


def is_story(title: Column) -> Column:
    """Whether a chapter belongs to the story by its title; one without title doesn't."""
    bare = bare_title(title)
    return (bare != "") & (bare.rlike(KEPT) | ~bare.rlike(SKIPPED))


def walk_pages(start: DataFrame, edges: DataFrame, single: bool = False) -> DataFrame:
    """book, url and page_ord of the pages that following next links reaches; each page once, by its shortest way.

    start: book, url. edges: url, next_url. A first page with one next link is followed page by page (of a later page's
    links the first counts); one with several has them all taken, in the order of `ix` where edges carry it, and these are
    followed no further, as a list of all pages has no next one (single=True: followed like others).

    Known pages and the length of a jump double in each round, and both are written, so a walk of n pages takes the
    logarithm of n in rounds, and ends at cycles.
    """
    from folio_spark.sources.stores import checkpointed

    order = F.col("ix") if "ix" in edges.columns else F.lit(0)
    links = edges.where("next_url is not null").groupBy("url", "next_url").agg(F.min(order).alias("ix"))
    first = links.groupBy("url").agg(F.min(F.struct("ix", "next_url")).alias("f"), F.count("*").alias("n"))
    begun = start.select("book", "url").distinct().join(first.select("url", "n"), "url", "left").select("book", "url", (F.coalesce("n", F.lit(0)) > 1).alias("hub"))
    begun = checkpointed(begun.withColumn("hub", F.col("hub") & F.lit(not single)))
    seen = checkpointed(begun.where("not hub").select("book", "url", F.lit(0).cast("long").alias("page_ord")))
    jump, step, known = first.select("url", F.col("f.next_url").alias("to")), 1, seen.count()
    while True:
        further = seen.join(jump, "url").select("book", F.col("to").alias("url"), (F.col("page_ord") + step).alias("page_ord"))
        seen = checkpointed(seen.unionByName(further).groupBy("book", "url").agg(F.min("page_ord").alias("page_ord")))
        before, known = known, seen.count()
        if known == before:
            break
        jump = checkpointed(jump.join(jump.select(F.col("url").alias("to"), F.col("to").alias("_next")), "to").select("url", F.col("_next").alias("to")))
        step *= 2
    hubs = begun.where("hub").select("book", "url")
    taken = hubs.join(links, "url").where("next_url <> url").groupBy("book", F.col("next_url").alias("url")).agg(F.min("ix").alias("ix"))
    at = F.row_number().over(W.partitionBy("book").orderBy("ix", "url")).cast("long")
    return seen.unionByName(hubs.withColumn("page_ord", F.lit(0).cast("long"))).unionByName(taken.select("book", "url", at.alias("page_ord")))


def whole_content(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """book, chapter url and content: each chapter's pages joined by line breaks, following next_url while it is another
    page of the same text. pages: url, content, next_url. chapters: book, url, next_chapter (the next chapter's URL or null)."""
    from folio_spark.functions.urls import continues

    same = pages.withColumn("_next", F.col("next_url"))
    first = chapters.join(same, "url").where(continues(F.col("_next"), F.col("url"), F.col("next_chapter"))).select("url", "next_url")
    later = same.where(continues(F.col("_next"), F.col("url"), F.lit(None).cast("string"))).select("url", "next_url")
    later = later.join(chapters.select(F.col("next_chapter").alias("next_url")).where("next_url is not null").distinct(), "next_url", "left_anti").join(chapters.select("url").distinct(), "url", "left_anti")
    walked = walk_pages(chapters.select(F.struct("book", "url").alias("book"), "url"), first.unionByName(later.select("url", "next_url")), single=True)
    parts = walked.join(pages.select("url", "content"), "url").select("book", "page_ord", "content")
    return stitch(parts).select("book.book", "book.url", "content")


def stitch(pages: DataFrame, book: str = "book") -> DataFrame:
    """Parts of a text joined in page order, one to a line."""
    return pages.groupBy(book).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_ord", "content"))), lambda x: x["content"]), "\n").alias("content"))
