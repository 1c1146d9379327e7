"""Token counts: edit-aware counting with a segment tree of pre-tokens for each document.

A document is cut before spaces that start a word (where the tokenizer's pre-tokens end whatever follows) into
leaves of about LEAF characters. The tree keeps the characters and tokens below each node. An edit finds its leaves
by descending the tree, re-encodes them with one leaf of context on each side, and updates the sums above; all other
leaves keep their counts. Edits are (start, end, replacement) in code points of the text as it was. Trees are columns
(their leaves' lengths and counts), so a written table of them is edited again and again without counting texts anew.

Defined results: a null text is an empty one with no tokens; edits beyond the end are cut to it; where edits overlap,
the later one begins where the earlier ended; a null or empty list of edits changes nothing; repeated rows are
counted one by one; an empty table gives no rows; a text of any length is one tree, built and edited alone. Extra
columns pass through, but those named as an output give way to it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices
from .packing import Encoder, encoder, tokenizer_path
from .pii import find_spans

LEAF = 160
_CUT = re.compile(r"(?<=\S) (?=\S)")
EDITS = "array<struct<start:int,end:int,new:string>>"


def cut_points(text: str, size: int = LEAF) -> list[int]:
    """Where leaves begin: at 0, then at the first proper cut after each `size` characters."""
    out, at = [0], size
    while at < len(text):
        m = _CUT.search(text, at)
        if not m:
            break
        out.append(m.start())
        at = m.start() + size
    return out


class TokenTree:
    """Leaves with their texts; chars and tokens of the nodes above them, children of i at 2i and 2i + 1."""

    def __init__(self, leaves: list[str], counts: list[int], count: Callable[[str], int]):
        self.count, self.n, self.encoded = count, max(1, len(leaves)), 0
        self.leaves = leaves or [""]
        self.size = 1
        while self.size < self.n:
            self.size *= 2
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        self.chars[self.size : self.size + self.n] = map(len, self.leaves)
        self.tokens[self.size : self.size + self.n] = counts or [0]
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one for the end) and the leaf's first character."""
        node, before = 1, 0
        if at >= self.chars[1]:
            return self.n - 1, self.chars[1] - self.chars[self.size + self.n - 1]
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _set(self, i: int, text: str, tokens: int) -> None:
        self.leaves[i] = text
        node = self.size + i
        chars, more = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += more
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        first, before = self.find(max(0, start - 1))
        last, _ = self.find(end + 1)
        if first:  # one leaf of context: its own start is then untouched
            first -= 1
            while first and not self.leaves[first]:  # left empty by an earlier edit
                first -= 1
            before -= len(self.leaves[first])
        last = min(self.n - 1, last + 1)
        while last < self.n - 1 and not self.leaves[last]:
            last += 1
        text = "".join(self.leaves[first : last + 1])
        text = text[: start - before] + new + text[end - before :]
        room = last - first + 1
        cuts = cut_points(text, max(LEAF, -(-len(text) // room)))[:room]
        parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])] + [""] * (room - len(cuts))
        for i, part in enumerate(parts):
            self._set(first + i, part, self.count(part) if part else 0)
        self.encoded += len(text)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)


def token_trees(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with leaf_chars, leaf_tokens (the leaves of each document's tree) and n_tokens."""
    docs = docs.drop("leaf_chars", "leaf_tokens", "n_tokens")  # an input's columns of these names give way
    path, keep = path or tokenizer_path(), docs.columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as encode:
            for b in slices(batches, keep.index(text_col)):
                yield measured(b, encode)

    def measured(b: pa.RecordBatch, encode: Encoder) -> pa.RecordBatch:
        chars, tokens = [], []
        for t in b.column(keep.index(text_col)):
            text = t.as_py() or ""
            cuts = cut_points(text) if text else []
            parts = [text[x:y] for x, y in zip(cuts, [*cuts[1:], len(text)])]
            chars.append([len(p) for p in parts])
            tokens.append([len(encode(p)) // 4 for p in parts])
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array(map(sum, tokens), pa.int64())], [*keep, "leaf_chars", "leaf_tokens", "n_tokens"])

    schema = T.StructType([*docs.schema, T.StructField("leaf_chars", T.ArrayType(T.IntegerType())), T.StructField("leaf_tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(build, schema)


def apply_edits(trees: DataFrame, edits_col: str = "edits", text_col: str = "text", path: str | None = None) -> DataFrame:
    """trees with the text after its edits, the leaves and n_tokens brought up to date, and reencoded_chars."""
    trees = trees.drop("reencoded_chars")
    path, keep = path or tokenizer_path(), trees.columns
    at = {c: keep.index(c) for c in (text_col, "leaf_chars", "leaf_tokens", "n_tokens", edits_col)}

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as encode:
            for b in slices(batches, at[text_col]):
                yield updated(b, lambda part: len(encode(part)) // 4)

    def updated(b: pa.RecordBatch, count: Callable[[str], int]) -> pa.RecordBatch:
        texts, chars, tokens, totals, encoded = [], [], [], [], []
        for text, lens, counts, edits in zip(b.column(at[text_col]), b.column(at["leaf_chars"]).to_pylist(), b.column(at["leaf_tokens"]).to_pylist(), b.column(at[edits_col]).to_pylist()):
            whole = text.as_py()
            ends = [0]
            for n in lens:
                ends.append(ends[-1] + n)
            tree = TokenTree([(whole or "")[x:y] for x, y in zip(ends, ends[1:])], counts, count)
            shift, done, n = 0, 0, len(whole or "")
            for e in sorted((e for e in edits or [] if e and e["start"] is not None and e["end"] is not None), key=lambda e: (e["start"], e["end"])):
                lo, hi = max(done, min(e["start"], n)), min(max(e["end"], done, e["start"]), n)
                new = e["new"] or ""
                tree.edit(lo + shift, hi + shift, new)
                shift, done = shift + len(new) - (hi - lo), hi
            texts.append(tree.text if edits else whole)
            chars.append(tree.chars[tree.size : tree.size + tree.n])
            tokens.append(tree.tokens[tree.size : tree.size + tree.n])
            totals.append(tree.total)
            encoded.append(tree.encoded)
        columns = list(b.columns)
        columns[at[text_col]] = pa.array(texts, pa.string())
        columns[at["leaf_chars"]] = pa.array(chars, pa.list_(pa.int32()))
        columns[at["leaf_tokens"]] = pa.array(tokens, pa.list_(pa.int32()))
        columns[at["n_tokens"]] = pa.array(totals, pa.int64())
        return pa.RecordBatch.from_arrays([*columns, pa.array(encoded, pa.int64())], [*keep, "reencoded_chars"])

    return trees.mapInArrow(update, T.StructType([*trees.schema, T.StructField("reencoded_chars", T.LongType())]))


def cleaning_edits(docs: DataFrame, text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """docs with `edits`: personal data replaced by its kind, and a first line with a tag."""
    found = find_spans(docs, text_col, "_spans")
    marks = F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("new")))
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.concat(F.lit("<"), F.coalesce(tag if tag is not None else F.lit(""), F.lit("")), F.lit(">\n")).alias("new")))
    return found.withColumn("edits", F.concat(first, marks)).drop("_spans")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    trees = materialize(token_trees(docs), "trees")
    edited = cleaning_edits(trees, tag=F.col("lang")).drop("lang").withColumn("tokens_before", F.col("n_tokens")).withColumn("n_edits", F.size("edits").cast("long"))
    after = apply_edits(edited)
    return after.select("doc_id", "n_edits", "tokens_before", F.col("n_tokens").alias("tokens_after"), F.length("text").cast("long").alias("chars_after"), "reencoded_chars")
