"""Best-fit packing: pattern packing by non-negative least squares.

Patterns of one to three lengths that fill a sequence exactly are enumerated; block coordinate descent fits how
often each is repeated so that together they use up the length histogram (least squares, no negative counts); the
counts are rounded down and what remains is packed best-fit decreasing, by length and count. All of that works on
the histogram, which has at most `capacity` entries whatever the input; documents only meet the finished plan,
through their rank among the documents of equal length.

Defined results: a null text is an empty one, and an empty text is the single end token; a document longer than a
sequence is cut so that every piece but the first is full, whatever its length; repeated rows are packed as often as they
occur; of pieces of one length any may take any place (by bucket, id, piece and checksum); an empty table gives no
rows; columns beyond id and text play no part, whatever their names.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize

CAPACITY, END_ID = 2048, 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces that one ranking bucket holds on average.
BUCKET_ROWS = 100_000
#: Bytes of kept text segments in each of an encoder's two generations, and what one takes besides its characters and ids.
KEPT, EACH = 72 << 20, 200


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The ids of texts as little-endian bytes. Texts are cut before each space and the ids of the segments are kept.

    A segment is encoded the same alone as in its text unless white space meets white space at a cut or it holds part of
    a special token; a text with such an odd segment is encoded whole. Two generations of
    segments are kept, so that frequent ones outlive a full cache; `forget` gives both back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.forget()
        self.part = self._ranks(path.removesuffix(".json") + ".tiktoken")

    def forget(self) -> None:
        self.seen, self.old, self.held = {}, {}, 0

    @staticmethod
    def _ranks(path: str):
        """A quicker encoder of the same vocabulary, where its file of ranks lies beside the tokenizer's; else none."""
        import base64

        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _part_ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.part(t)).tobytes() for t in texts] if self.part else self._ids(texts)

    @staticmethod
    def _real(key: str) -> str:
        return key[1:] if key[:1] == " " else " " + key

    @staticmethod
    def _odd(part: str) -> bool:
        return part != "" and (part[-1].isspace() or (part[0] == " " and part[1].isspace()) or "<|" in part)

    def __call__(self, text: str) -> bytes:
        keys = text.split(" ")  # a key stands for itself after a space; the first one, with a space, for itself alone
        keys[0] = " " + keys[0]
        ids = list(map(self.seen.get, keys))
        if None in ids:
            missed = {k for k, v in zip(keys, ids) if v is None}
            if self.held > KEPT:
                self.old, self.seen, self.held = self.seen, {}, 0
                missed = set(keys)
            new = []
            for k in missed:
                if k in self.old:
                    self.seen[k] = self.old[k]
                    self.held += EACH + len(k) + len(self.old[k])
                elif self._odd(self._real(k)):
                    return self._ids([text])[0]
                else:
                    new.append(k)
            if new:
                found = self._part_ids([self._real(k) for k in new])
                self.seen.update(zip(new, found))
                self.held += EACH * len(new) + sum(map(len, new)) + sum(map(len, found))
            ids = map(self.seen.__getitem__, keys)
        return b"".join(ids)


_encoders: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """The Python worker's encoder of a vocabulary, for one task: workers are used again, so its segments go at the end."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    try:
        yield _encoders[path]
    finally:
        _encoders[path].forget()
        give_back()


def cut_into_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """id, piece, start, length and ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        with encoder(path) as encode:
            for b in batches:
                which, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(b.column(1)):
                    ids = encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                        which.append(i)
                        piece.append(k)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def few_document_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0 where a pattern has fewer) that sum to capacity, of the lengths at hand."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    found = []
    for a in np.unique(np.append(lengths, 0)):
        b = np.arange(a, capacity + 1)
        c = capacity - a - b
        ok = (c >= b) & have[b] & have[np.maximum(c, 0)]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return rows[have[rows[:, 2]]]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares: repeat counts x of patterns so that their lengths add up to the histogram.

    Each round takes patterns that share no length, steepest first, and sets each to its exact minimiser.
    Returns the indices of the patterns in use and their counts.
    """
    x = np.zeros(len(patterns))
    if not len(patterns):
        return np.zeros(0, np.int64), x
    rest = histogram.astype(float)
    rest[0] = 0.0
    real = patterns > 0
    squared = np.array([sum(v * v for k, v in zip(*np.unique(r, return_counts=True)) if k) for r in patterns]) if len(patterns) < 2000 else None
    if squared is None:
        twice = (patterns[:, 0] == patterns[:, 1]) & real[:, 0]
        again = (patterns[:, 1] == patterns[:, 2]) & real[:, 1]
        squared = real.sum(1) + 2.0 * twice + 2.0 * again + 2.0 * (twice & again)
    for _ in range(rounds):
        slope = rest[patterns[:, 0]] + rest[patterns[:, 1]] + rest[patterns[:, 2]]
        step = np.maximum(slope / squared, -x)
        gain = step * slope - 0.5 * squared * step * step
        order = np.argpartition(-gain, min(8000, len(gain) - 1))[:8000]
        order = order[np.argsort(-gain[order], kind="stable")]
        used = np.zeros(len(rest), bool)
        moved = 0.0
        for p in order.tolist():
            if gain[p] < 1e-3:
                break
            row = [v for v in patterns[p].tolist() if v]
            if used[row].any():
                continue
            used[row] = True
            x[p] += step[p]
            moved += gain[p]
            for v in row:
                rest[v] -= step[p]
        if moved < 1e-2:
            break
    on = np.flatnonzero(x > 0)
    return on, x[on]


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over a histogram: (lengths with multiplicity, number of such sequences)."""
    room: dict[int, list[list]] = {}  # free tokens -> [contents, count]
    free = np.zeros(capacity + 1, np.int64)

    def put(left: int, contents: list, count: int) -> None:
        if count:
            room.setdefault(left, []).append([contents, count])
            free[left] += count

    for length in range(capacity, 0, -1):
        todo = int(histogram[length])
        while todo:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                left = int(fits[0]) + length
                contents, count = room[left].pop()
                free[left] -= count
            else:
                left, contents, count = capacity, [], -(-todo // (capacity // length))
            each = left // length
            full = min(count, todo // each)
            put(left - each * length, [*contents, (length, each)], full)
            todo -= full * each
            count -= full
            if count and todo and todo < each:
                put(left - todo * length, [*contents, (length, todo)], 1)
                todo, count = 0, count - 1
            if contents or count == 0 or left < capacity:
                put(left, contents, count)
    return [(contents, count) for groups in room.values() for contents, count in groups]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """How to pack a histogram of lengths (index: length): contents and number of sequences of each kind."""
    left = histogram.astype(np.int64).copy()
    out = []
    patterns = few_document_patterns(np.flatnonzero(left), capacity)
    on, counts = fit_counts(patterns, left)
    for p, n in sorted(zip(on.tolist(), counts.tolist()), key=lambda t: -t[1]):
        kinds = [(int(v), int(m)) for v, m in zip(*np.unique(patterns[p], return_counts=True)) if v]
        times = min([int(n + 1e-9), *(int(left[v]) // m for v, m in kinds)])
        if times > 0:
            out.append((kinds, times))
            for v, m in kinds:
                left[v] -= times * m
    return out + best_fit(left, capacity)


def _slots(steps: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ranks at which its intervals begin, the first sequence of each, places and offset in one."""
    begun: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for contents, count in steps:
        offset = 0
        for length, m in contents:
            at = begun.get(length, 0)
            rows.setdefault(length, []).append((at, sequence, m, offset))
            begun[length] = at + m * count
            offset += m * length
        sequence += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a `length` of at most capacity) with sequence_id and offset. pieces is read more than once."""
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most capacity rows
        histogram[length] = n
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))  # bounded by capacity, not by the input
    buckets = int(max(16, histogram.sum() // BUCKET_ROWS))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    own = W.partitionBy("length", "_bucket").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_own")).alias("_rank"))
    at_length, at_rank, keep = pieces.columns.index("length"), len(pieces.columns), len(pieces.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for b in batches:
            length, rank = b.column(at_length).to_numpy(), b.column(at_rank).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    n = int(length[part[0]])
                    begin, first, m, off = table[n]
                    k = np.searchsorted(begin, rank[part], side="right") - 1
                    r = rank[part] - begin[k]
                    sequence[part] = first[k] + r // m[k]
                    offset[part] = off[k] + r % m[k] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(sequence), pa.array(offset)], [*b.schema.names[:keep], "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(materialize(cut_into_pieces(docs, path or tokenizer_path(), id_col, text_col, capacity), "pieces"), id_col, capacity)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
