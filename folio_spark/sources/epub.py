"""EPUB archives as tables: member files, manifest and spine, titles, chapters, and chapter markup made plain.

The archive reader is the one Python stage; package documents are read with XPath functions and met by joins.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio_spark.functions.text import collapse_space, plain_length
from folio_spark.sources.stores import checkpointed

#: Limits of an archive, as parameters of its reader: members, bytes of one, bytes of all.
MOST_FILES, MOST_BYTES, MOST_TOTAL = 5000, 50 << 20, 500 << 20
#: Members, and bytes of them, that one batch of the reader holds.
MOST_ROWS, MOST_BATCH = 2000, 8 << 20
#: Media types of chapters, and what chapter markup may keep.
PAGES = ("application/xhtml+xml", "text/html")
KEPT = "p|br|hr|div|span|h1|h2|h3|h4|h5|h6|b|strong|i|em|u|s|sub|sup|ul|ol|li|dl|dt|dd|blockquote|pre|code|table|thead|tbody|tr|td|th|ruby|rt|rp"


def read_files(archives: DataFrame, id_col: str = "book", content: str = "content", most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_total: int = MOST_TOTAL) -> DataFrame:
    """book, path and bytes of every member of every archive. Members with absolute or climbing paths are left out; an
    archive that can't be read, or holds or unpacks to more than the limits, gives one row with a null path and its error."""

    def members(data: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
            files = [i for i in archive.infolist() if not i.is_dir()]
            if len(files) > most_files or sum(i.file_size for i in files) > most_total or any(i.file_size > most_bytes for i in files):
                raise ValueError("too large")
            out = []
            for i in files:
                path = posixpath.normpath(i.filename.replace("\\", "/"))
                if not path.startswith(("/", "..")) and ":" not in path.split("/")[0]:
                    out.append((path, archive.read(i), None))
        except Exception as e:  # the archive is the input: whatever is wrong with it is its row
            yield None, None, f"{type(e).__name__}: {e}"
            return
        yield from out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, size = [], [], 0

            def batch(b=b):
                columns = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.string())))], [id_col, "path", "bytes", "error"])

            for i in range(b.num_rows):
                for row in members(b.column(1)[i].as_py() or b""):
                    at.append(i)
                    rows.append(row)
                    size += len(row[1] or b"")
                    if len(rows) >= MOST_ROWS or size >= MOST_BATCH:
                        yield batch()
                        at, rows, size = [], [], 0
            if rows:
                yield batch()

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, archives.schema[id_col].dataType), T.StructField("path", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("error", T.StringType())])
    return archives.select(id_col, content).mapInArrow(run, schema)


def stored_files(archives: DataFrame, id_col: str = "book", content: str = "content") -> DataFrame:
    """read_files, written once to the session's checkpoint folder: packages, titles and chapters each read it again."""
    return checkpointed(read_files(archives, id_col, content))


def _xml(c: Column) -> Column:
    """A document's text as the XPath functions take it: no byte-order mark, no document type (it may name files elsewhere)."""
    text = F.regexp_replace(F.decode(c, "UTF-8"), r"^\x{FEFF}", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", ""), r"&(?!amp;|lt;|gt;|quot;|apos;|#)[A-Za-z]+;", " ")


def _tag(name: str) -> str:
    return f"//*[local-name()='{name}']"


def joined(folder: Column, href: Column) -> Column:
    """A member's path from a package's folder and a link, without fragment and dot segments."""
    from folio_spark.functions.urls import without_dots

    plain = F.url_decode(F.replace(F.regexp_replace(href, "[#?].*$", ""), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(without_dots(F.concat(folder, plain)), "^/+", "")


def packages(files: DataFrame, book: str = "book") -> DataFrame:
    """book, opf (its path), folder and xml of each archive's package: the container's first root file, else the first .opf."""
    root = files.where("lower(path) = 'meta-inf/container.xml'").select(book, F.get(F.xpath(_xml(F.col("bytes")), F.lit(f"{_tag('rootfile')}/@full-path")), F.lit(0)).alias("_root"))
    opfs = files.where("lower(path) like '%.opf'").groupBy(book).agg(F.min("path").alias("_first"))
    named = opfs.join(root, book, "full_outer").select(book, F.coalesce(F.nullif("_root", F.lit("")), "_first").alias("path"))
    own = files.select(book, "path", "bytes").join(named, [book, "path"])
    return own.select(book, F.col("path").alias("opf"), F.regexp_extract("path", "^(.*/)?[^/]*$", 1).alias("folder"), _xml(F.col("bytes")).alias("xml"))


def books(packs: DataFrame, book: str = "book") -> DataFrame:
    """book, title, author and description by the package's metadata."""
    first = lambda name: F.nullif(collapse_space(F.coalesce(F.get(F.xpath("xml", F.lit(f"{_tag(name)}/text()")), F.lit(0)), F.lit(""))), F.lit(""))
    return packs.select(book, first("title").alias("title"), first("creator").alias("author"), first("description").alias("description"))


def manifest(packs: DataFrame, book: str = "book") -> DataFrame:
    """book, id, path, media_type and properties of each item; of equal ids the first."""
    # Attributes that an item lacks are found item by item, so that the arrays stay aligned.
    items = F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?item\b[^>]*>"), F.lit(0))
    value = lambda t, a: F.regexp_extract(t, rf"\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    rows = packs.select(book, "folder", F.posexplode(items).alias("_at", "t")).select(book, "_at", value(F.col("t"), "id").alias("id"), joined(F.col("folder"), F.replace(value(F.col("t"), "href"), F.lit("&amp;"), F.lit("&"))).alias("path"), F.lower(value(F.col("t"), "media-type")).alias("media_type"), value(F.col("t"), "properties").alias("properties"))
    return rows.where("id <> ''").groupBy(book, "id").agg(F.min(F.struct("_at", "path", "media_type", "properties")).alias("m")).select(book, "id", "m.path", "m.media_type", "m.properties")


def spine(packs: DataFrame, book: str = "book") -> DataFrame:
    return packs.select(book, F.posexplode(F.xpath("xml", F.lit(f"{_tag('itemref')}/@idref"))).alias("pos", "id"))


def titles(files: DataFrame, items: DataFrame, book: str = "book") -> DataFrame:
    """book, path and title by the navigation document, else by the NCX; of a path's titles the first."""
    docs = files.join(items, [book, "path"])
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    nav = docs.where("array_contains(split(properties, ' '), 'nav')").select(book, folder.alias("folder"), F.regexp_extract_all(_xml(F.col("bytes")), F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0)).alias("links"))
    nav = nav.select(book, "folder", F.lit(0).alias("how"), F.posexplode("links").alias("at", "t")).select(book, "folder", "how", "at", F.regexp_extract("t", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), collapse_space(F.regexp_replace("t", "<[^>]*>", " ")).alias("title"))
    ncx = docs.where("media_type = 'application/x-dtbncx+xml' or lower(path) like '%.ncx'").select(book, folder.alias("folder"), F.regexp_extract_all(_xml(F.col("bytes")), F.lit(r"(?is)<(?:\w+:)?text\b[^>]*>(.*?)</(?:\w+:)?text>\s*</(?:\w+:)?navLabel>\s*<(?:\w+:)?content\b[^>]*>"), F.lit(0)).alias("links"))
    ncx = ncx.select(book, "folder", F.lit(1).alias("how"), F.posexplode("links").alias("at", "t")).select(book, "folder", "how", "at", F.regexp_extract("t", r"(?is)src\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), collapse_space(F.regexp_replace("t", "<[^>]*>", " ")).alias("title"))
    rows = nav.unionByName(ncx).where("title <> '' and href <> ''").withColumn("path", joined(F.col("folder"), F.col("href")))
    return rows.groupBy(book, "path").agg(F.min(F.struct("how", "at", "title")).alias("t")).select(book, "path", "t.title")


def own_title(markup: Column) -> Column:
    """The title or first heading of a chapter's markup."""
    found = [F.nullif(collapse_space(F.regexp_replace(F.regexp_extract(markup, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1), "<[^>]*>", "")), F.lit("")) for t in ("title", "h1", "h2", "h3")]
    return F.coalesce(*found)


def chapters(files: DataFrame, book: str = "book") -> DataFrame:
    """book, idx, path, title, markup and n_chars of each chapter: the spine's pages in order, each path once, with the title
    of the navigation, else the page's own, else its number."""
    packs = checkpointed(packages(files, book))  # read by manifest and spine
    items = manifest(packs, book)
    pages = spine(packs, book).join(items.where(F.col("media_type").isin(*PAGES)), [book, "id"]).join(files.select(book, "path", "bytes"), [book, "path"])
    first = pages.groupBy(book, "path").agg(F.min(F.struct("pos", "bytes")).alias("p")).select(book, "path", "p.pos", F.decode("p.bytes", "UTF-8").alias("markup"))
    numbered = first.withColumn("idx", (F.row_number().over(W.partitionBy(book).orderBy("pos")) - 1).cast("int")).join(titles(files, items, book), [book, "path"], "left")
    number = F.concat(F.lit("第 "), (F.col("idx") + 1).cast("string"), F.lit(" 章"))
    return numbered.select(book, "idx", "path", F.coalesce("title", own_title(F.col("markup")), number).alias("title"), "markup", plain_length(F.col("markup")).alias("n_chars"))


def clean_markup(markup: Column, assets: Column, folder: Column) -> Column:
    """Chapter markup made plain: the body without scripts, styles and comments, tags of the allowed kinds without their
    attributes, and images whose file is known as links to it. assets: map of a member's path to its URL."""
    body = F.coalesce(F.nullif(F.regexp_extract(markup, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1), F.lit("")), markup)
    body = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", ""), r"(?s)<!--.*?-->|<!\[CDATA\[|\]\]>|<\?.*?\?>", "")
    images = F.regexp_extract_all(body, F.lit(r"(?i)<(?:\w+:)?(?:img|image)\b[^>]*>"), F.lit(0))
    between = F.split(body, r"(?i)<(?:\w+:)?(?:img|image)\b[^>]*>", -1)
    plain = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, rf"(?i)<(/?)({KEPT})\b[^>]*?(/?)>", "\u0001$1$2$3\u0002"), r"<[^>]*>", ""), "\u0001([^\u0001\u0002]*)\u0002", "<$1>")

    def image(tag: Column) -> Column:
        src = F.regexp_extract(tag, r"(?i)(?:src|xlink:href|href)\s*=\s*[\"']([^\"']*)[\"']", 1)
        known = F.try_element_at(assets, joined(folder, src))
        return F.when((src != "") & known.isNotNull(), F.concat(F.lit('<img src="'), known, F.lit('">'))).otherwise("")

    pieces = F.transform(between, lambda t, i: F.concat(plain(t), F.coalesce(image(F.get(images, i)), F.lit(""))))
    return F.trim(F.array_join(pieces, ""))


def cover(packs: DataFrame, items: DataFrame, book: str = "book") -> DataFrame:
    """book and path of the cover: the item marked as one, else the one that a meta element names, else an image called so."""
    named = packs.select(book, F.get(F.xpath("xml", F.lit(f"{_tag('meta')}[@name='cover']/@content")), F.lit(0)).alias("_cover"))
    pictures = items.where("media_type like 'image/%'").join(named, book, "left")
    how = F.when(F.array_contains(F.split("properties", " "), "cover-image"), 0).when(F.col("id") == F.col("_cover"), 1).when(F.lower(F.concat("id", "path")).contains("cover"), 2)
    return pictures.withColumn("how", how).where("how is not null").groupBy(book).agg(F.min(F.struct("how", "path")).alias("c")).select(book, "c.path")
