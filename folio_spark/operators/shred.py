"""Pages as trees: one row a page, with its elements and texts in document order.

The tokeniser is the only Python stage, and a query runs it once: rules are array functions over a page's row. An element
is known by its place among the page's elements; those below it are the places up to its `last`, and the texts below it
are the page's texts from run_lo to run_hi, so no step of a rule searches more than the part of the page it stands in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of HTML: elements without content, and elements that a start tag of the key closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ["li"], "option": ["option"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "dt": ["dt", "dd"], "dd": ["dt", "dd"]}
BLOCKS = frozenset("p div ul ol dl table section article header footer nav h1 h2 h3 h4 h5 h6 pre blockquote form hr".split())
SCOPES = frozenset("ul ol table dl select html body div article section".split())
HIDDEN = frozenset(("script", "style"))

ELEMENT = "last int, parent int, depth int, child_ix int, tag string, attrs map<string,string>, run_lo int, run_hi int, src_lo int, src_hi int, kids array<int>"
RUN = "owner int, shown boolean, text string"
#: Pages, and characters of them, that one batch of the tokeniser holds.
ROWS, SIZE = 64, 8 << 20


class _Shredder(HTMLParser):
    """Elements as [last, parent, depth, child_ix, tag, attrs, run_lo, run_hi, src_lo, src_hi, kids] and texts as (owner, shown, text).

    Each step takes the same time however many elements are open: places of open elements are kept by name.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.runs: list[list] = []
        self.open: list[int] = []
        self.children = [0]
        self.places: dict[str, list[int]] = {}  # of open elements, by name: depths
        self.scopes: list[int] = []
        self.joins = False
        self.lines = [0]

    def read(self, html: str) -> None:
        at = html.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = html.find("\n", at + 1)
        self.size = len(html)
        whole = html.rfind(">") + 1  # behind the last '>' there can only be text and the beginning of a tag
        self.feed(html[:whole])
        self.close()
        if tail := re.split(r"<[a-zA-Z/!?]", html[whole:], maxsplit=1)[0]:
            self.handle_data(unescape(tail))
        self._close(0, self.size)

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)  # one that never ends takes the rest

    def parse_html_declaration(self, i: int) -> int:
        try:
            end = super().parse_html_declaration(i)
        except AssertionError:  # a declaration that none is: skipped like a comment
            end = -1
        return end if end >= 0 else self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def _close(self, depth: int, end: int) -> None:
        while len(self.open) > depth:
            row = self.rows[self.open.pop()]
            row[0], row[7], row[9] = len(self.rows) - 1, len(self.runs), end
            self.children.pop()
            self.places[row[4]].pop()
            if row[4] in SCOPES:
                self.scopes.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.joins = False
        start = self.at()
        ends = [self.places[t][-1] for t in CLOSES.get(tag, ()) if self.places.get(t)]
        if tag in BLOCKS and self.places.get("p"):
            ends.append(self.places["p"][-1])
        if ends and max(ends) > (self.scopes[-1] if self.scopes else -1):
            self._close(max(ends), start)
        depth = len(self.open)
        end = start + len(self.get_starttag_text() or "")
        self.rows.append([None, self.open[-1] if depth else -1, depth, self.children[-1], tag, {k: v or "" for k, v in reversed(attrs)}, len(self.runs), None, start, end, []])
        self.children[-1] += 1
        if depth:
            self.rows[self.open[-1]][10].append(len(self.rows) - 1)
        self.open.append(len(self.rows) - 1)
        self.children.append(0)
        self.places.setdefault(tag, []).append(depth)
        if tag in SCOPES:
            self.scopes.append(depth)
        if tag in VOID:
            self._close(depth, end)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1, self.rows[-1][9])

    def handle_endtag(self, tag: str) -> None:
        self.joins = False
        if self.places.get(tag):
            start, depth = self.at(), self.places[tag][-1]
            self._close(depth + 1, start)
            end = self.rawdata.find(">", start)
            self._close(depth, end + 1 if end >= 0 else self.size)

    def handle_comment(self, data: str) -> None:
        self.joins = False

    def handle_data(self, data: str) -> None:
        if self.joins:  # the parser may hand out one text in parts
            self.runs[-1][2].append(data)
            return
        owner = self.open[-1] if self.open else -1
        self.runs.append([owner, owner < 0 or self.rows[owner][4] not in HIDDEN, [data]])
        self.joins = True


def shred_page(html: str | None) -> tuple[list[list], list[list]]:
    """Elements and texts of one page; whatever it holds, it gives some."""
    p = _Shredder()
    p.read(html or "")
    return p.rows, [[owner, shown, "".join(parts)] for owner, shown, parts in p.runs]


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _batch(b: pa.RecordBatch, at: int, where: int | None = None) -> pa.RecordBatch:
    pages = [shred_page(t.as_py() if where is None or b.column(where)[i].as_py() else None) for i, t in enumerate(b.column(at))]
    rows, runs = [r for p in pages for r in p[0]], [r for p in pages for r in p[1]]
    columns = list(zip(*rows)) or [()] * 11
    keys = [(k, v) for a in columns[5] for k, v in a.items()]
    offsets = pa.array(np.append(0, np.cumsum([len(a) for a in columns[5]])), pa.int32())
    attrs = pa.MapArray.from_arrays(offsets, pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string()))
    kinds = {4: pa.string(), 10: pa.list_(pa.int32())}
    parts = [attrs if i == 5 else pa.array(c, kinds.get(i, pa.int32())) for i, c in enumerate(columns)]
    elements = pa.StructArray.from_arrays(parts, [f.split()[0] for f in ELEMENT.split(", ")])
    texts = list(zip(*runs)) or [()] * 3
    texts = pa.StructArray.from_arrays([pa.array(texts[0], pa.int32()), pa.array(texts[1], pa.bool_()), pa.array(texts[2], pa.string())], ["owner", "shown", "text"])
    return pa.RecordBatch.from_arrays([*b.columns, _lists([len(p[0]) for p in pages], elements), _lists([len(p[1]) for p in pages], texts)], [*b.schema.names, "nodes", "runs"])


def trees(pages: DataFrame, html_col: str = "html", where: str | None = None) -> DataFrame:
    """pages with `nodes`, `runs` and `source` (the page's text). A null or empty page has no elements, nor has one for which
    where (a column) doesn't hold."""
    rows = pages.drop("nodes", "runs", "source").withColumnRenamed(html_col, "source")  # the text goes to Python once
    at, holds = rows.columns.index("source"), rows.columns.index(where) if where else None
    schema = T.StructType([*rows.schema, T.StructField("nodes", T.ArrayType(T._parse_datatype_string(ELEMENT))), T.StructField("runs", T.ArrayType(T._parse_datatype_string(RUN)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                hi, size = lo, 0
                while hi < b.num_rows and hi - lo < ROWS and (hi == lo or size < SIZE):
                    size += len(b.column(at)[hi].as_buffer() or b"") if b.column(at)[hi].is_valid else 0
                    hi += 1
                yield _batch(b.slice(lo, hi - lo), at, holds)
                lo = hi

    names = [F.col("source").alias(html_col) if c == "source" else F.col(c) for c in rows.columns]
    return rows.mapInArrow(run, schema).select(*names, "source", "nodes", "runs")


def shred(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The node table: id, pre and last (d is below a if a.pre < d.pre <= a.last), parent, depth, child_ix, tag, attrs and
    the element's own text of every element of every page."""
    rows = trees(pages.select(id_col, html_col), html_col).select(id_col, "runs", F.posexplode("nodes").alias("pre", "n"))
    own = F.array_join(F.transform(F.filter(F.slice("runs", F.col("n.run_lo") + 1, F.col("n.run_hi") - F.col("n.run_lo")), lambda r: r["owner"] == F.col("pre")), lambda r: r["text"]), "")
    return rows.select(id_col, "pre", *(F.col(f"n.{c}").alias(c) for c in ("last", "parent", "depth", "child_ix", "tag", "attrs")), own.alias("text"))
