"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are sequences of words (letters and digits, lower-cased). A window of a text matches an item if
their word edit distance is at most (100 - percent) % of the item's words.

The CGK random walk turns a sequence into another in which edits show up as few differing places: at each step the
current symbol is put out and a random bit of (step, symbol) says whether to go on to the next one. Walks that
start at an item and at a window with a few edits fall back into step, so their Hamming distance stays small.
REPEATS independent walks are sampled at SAMPLES places each and hashed; a window whose hash under any repetition
equals an item's becomes a candidate, and an edit distance over words decides.

Windows are item-sized, and only those are embedded that share enough runs of three words with some item: an edit
touches at most three runs, so a match of n words within k edits keeps n - 2 - 3k of them, each at most k places
off the window's own start. Nothing is lost by it. Items of fewer than three words are looked up whole; items that may
keep no run (five words, one edit; longer ones at a lower percentage) by pairs of words, or single ones, and the edit
distance decides at once. The allowed edits depend on an item's words and the percentage alone.

Items travel in blocks of fixed size, whatever their number.

Defined results: null or wordless texts and items match nothing; repeated items and repeated rows are reported one
by one; of places that match equally well the first stands; an empty table gives no rows and an empty benchmark leaves
every document clean; a text of any length is searched whole; columns beyond id and text play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, join_small, materialize, mix, same_row

#: Repetitions and sampled places: measured recall of items with 10, 15 and 20 % of their words edited is in the README.
REPEATS, SAMPLES, RUN = 32, 4, 3
#: Items in a block: with 24 numbers each and their words, some MB at most.
BLOCK = 4096
#: Kept strings of a Python worker, for one task.
CACHE = 400_000
_WORD = re.compile(r"[^\W_]+")
_words: dict[str, bytes] = {}


def symbols(text: str | None) -> np.ndarray:
    """A 64-bit number for each word. What stands between white spaces is looked up as a whole: it may hold several words."""
    parts = text.lower().split() if text else []
    try:
        return np.frombuffer(b"".join(map(_words.__getitem__, parts)), "<u8")
    except KeyError:
        if len(_words) > CACHE:
            _words.clear()
        for p in set(parts):
            if p not in _words:
                _words[p] = b"".join(xxhash.xxh3_64_intdigest(w).to_bytes(8, "little") for w in _WORD.findall(p))
        return np.frombuffer(b"".join(map(_words.__getitem__, parts)), "<u8")


def runs(s: np.ndarray) -> np.ndarray:
    """A number for each three words in a row."""
    if len(s) < RUN:
        return np.zeros(0, np.uint64)
    x = np.zeros(len(s) - RUN + 1, np.uint64)
    for i in range(RUN):
        x = (x + s[i : len(s) - RUN + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x)


@lru_cache(maxsize=1024)
def reading(n: int) -> list[np.ndarray]:
    """For each step of the walks over n words, up to the last that is read: which of the REPEATS read it, a mask for
    each time. Every walk is read at SAMPLES steps, drawn from 2n."""
    places = np.random.default_rng(1000 + n).integers(0, max(1, 2 * n), (REPEATS, SAMPLES))
    times = [(places == step).sum(1) for step in range(int(places.max()) + 1)]
    return [np.stack([t > i for i in range(t.max())]) if t.any() else np.zeros((0, REPEATS), bool) for t in times]


def cgk_keys(s: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """REPEATS keys for each window of n words of s that begins at starts (past its end the walk reads a filler)."""
    padded = np.append(s, np.zeros(1, np.uint64))
    salt = mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))[None, :]
    at = np.zeros((len(starts), REPEATS), np.int64)
    key = np.repeat(salt, len(starts), axis=0)
    begin = starts[:, None]
    for step, masks in enumerate(reading(n)):
        word = padded[np.minimum(begin + at, len(s))]
        word[at >= n] = 0
        for mask in masks:
            key[:, mask] = mix(key[:, mask] * np.uint64(31) + word[:, mask] + np.uint64(step))
        at += (mix(word ^ salt ^ np.uint64(step * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(np.int64)
    return key


def _edits(a: np.ndarray, b: np.ndarray, row: np.ndarray, limit: int) -> tuple[int, int]:
    steps = np.arange(len(b) + 1)
    for x in a:
        new = np.minimum(row + 1, np.append(row[0] + 1, row[:-1] + (b != x)))
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > limit:
            return limit + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


def best_place(item: np.ndarray, span: np.ndarray, limit: int) -> tuple[int, int, int]:
    """Least word edits between item and any part of span, and where that part begins and ends; limit + 1 if more."""
    d, end = _edits(item, span, np.zeros(len(span) + 1, np.int64), limit)
    if d > limit:
        return d, 0, 0
    back = span[:end][::-1]
    return d, end - _edits(item[::-1], back, np.arange(len(back) + 1), d)[1], end


class Index:
    """Items by run and, for each length, by the keys of each repetition."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items, self.run_of, self.keys, self.allowed, self.loose = [], defaultdict(list), {}, [], []
        for item, text in items:
            s = symbols(text)
            if not len(s):
                continue
            k = len(self.items)
            edits = len(s) * (100 - percent) // 100
            self.items.append((item, s))
            self.allowed.append(edits)
            if len(s) >= RUN and len(s) - RUN + 1 - RUN * edits < 1:
                self.loose.append(k)
            for at, run in enumerate(runs(s) if len(s) >= RUN else [mix(np.array([s.sum()], np.uint64))[0]]):
                self.run_of[int(run)].append((k, at))
            table = self.keys.setdefault(len(s), defaultdict(set))
            for r, key in enumerate(cgk_keys(s, np.zeros(1, np.int64), len(s))[0]):
                table[r, int(key)].add(k)
        self.runs = np.sort(np.fromiter((np.uint64(x) for x in self.run_of), np.uint64, len(self.run_of)))
        self.shortest = min((len(s) for _, s in self.items), default=0)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.runs >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, s: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first word, words, edits) of each item's best place in s."""
        if not len(s) or not self.items:
            return []
        x = runs(s)
        near = np.flatnonzero(self.bits[(x >> np.uint64(44)).astype(np.int64)]) if len(x) else x.astype(np.int64)
        hits = near[self.runs[np.minimum(np.searchsorted(self.runs, x[near]), len(self.runs) - 1)] == x[near]] if len(near) and len(self.runs) else near[:0]
        met: dict[int, list[int]] = defaultdict(list)
        for p in hits.tolist():
            for k, at in self.run_of[int(x[p])]:
                met[k].append(p - at)
        starts: dict[int, set[int]] = defaultdict(set)
        for k, lines in met.items():
            n, edits = len(self.items[k][1]), self.allowed[k]
            need = max(1, n - RUN + 1 - RUN * edits)  # runs that a match keeps at least
            if len(lines) >= need:
                lines.sort()
                for i in range(len(lines) - need + 1):  # need of them on lines that the allowed edits can join
                    if lines[i + need - 1] - lines[i] <= 2 * edits:
                        starts[n].update(max(0, v) for v in range(lines[i + need - 1] - edits, lines[i] + edits + 1))
        if self.shortest < RUN:  # items too short for a run are looked up at every place
            for k, (_, item) in enumerate(self.items):
                if len(item) < RUN:
                    starts[len(item)].update(np.flatnonzero(s == item[0]).tolist())
        sure: dict[int, set[int]] = defaultdict(set)
        for k in self.loose:
            item, edits = self.items[k][1], self.allowed[k]
            size = 2 if len(item) - 1 - 2 * edits >= 1 else 1
            for j in range(len(item) - size + 1):
                same = s[: max(0, len(s) - size + 1)] == item[j]
                if size == 2:
                    same = same & (s[1:] == item[j + 1])
                for p in np.flatnonzero(same).tolist():
                    sure[k].update(v for v in (max(0, v) for v in range(p - j - edits, p - j + edits + 1)) if v < len(s))
            if sure[k]:
                starts[len(item)].update(sure[k])
        best: dict[int, tuple[int, int, int]] = {}
        for n, where in starts.items():
            at = np.fromiter((w for w in sorted(where) if w < len(s)), np.int64)
            table, keys = self.keys[n], cgk_keys(s, at, n)
            found: dict[int, set[int]] = defaultdict(set)
            for r in range(REPEATS):
                for i, key in enumerate(keys[:, r].tolist()):
                    for k in table.get((r, key), ()):
                        found[k].add(int(at[i]))
            for k, places in sure.items():
                if places and len(self.items[k][1]) == n:
                    found[k].update(places)
            for k, places in found.items():
                item, edits = self.items[k][1], self.allowed[k]
                places = sorted(places)
                cut = [0, *(i for i in range(1, len(places)) if places[i] - places[i - 1] > n), len(places)]
                for lo, hi in zip(cut, cut[1:]):
                    begin = places[lo]
                    d, first, end = best_place(item, s[begin : places[hi - 1] + n + edits], edits)
                    if d <= edits and (k not in best or d < best[k][0]):
                        best[k] = (d, begin + first, end - first)
        return [(self.items[k][0], p, words, d) for k, (d, p, words) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = 80) -> DataFrame:
    """id, item_id, first_word, n_words and edits for every item that a document holds, at its best place."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col)
    blocks = max(1, -(-items.count() * 5 // (4 * BLOCK)))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("edits", T.LongType())])
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)) == block) if blocks > 1 else items
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about BLOCK items

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, percent)
            for b in batches:
                which, rows = [], []
                for i, text in enumerate(b.column(1)):
                    for m in index.matches(symbols(text.as_py())):
                        which.append(i)
                        rows.append(m)
                if rows:
                    item, first, n, d = zip(*rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(item, schema_item), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], schema.names)
            _words.clear()
            give_back()

        from pyspark.sql.pandas.types import to_arrow_type

        schema_item = to_arrow_type(schema[item_col].dataType)
        found = docs.select(id_col, text_col).mapInArrow(search, schema)
        if blocks > 1:
            found = materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", percent: int = 80) -> DataFrame:
    """docs without the documents that hold an item, by id and text: other texts under the same id, or under none, stay.
    The leaks are few; they are written before docs is read again."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("_row"), text_col)
    leaks = materialize(find_leaks(keyed, benchmark, "_row", text_col, item_col, percent).select(F.col("_row.id").alias("_id"), F.col("_row.text").alias("_text")).distinct(), "leaking")
    return join_small(docs, leaks, same_row(docs, id_col, text_col, leaks), "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
