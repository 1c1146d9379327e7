"""Exact top-k search: a KD-tree in each shard, best-first by box bounds, with a propagated kth score.

A shard is an input partition. Its tree splits at the median of the widest component down to leaves and keeps a
tight box for every node; the inner product of a query with any vector of a box is at most
sum(max(q * low, q * high)). Queries descend level by level, drop boxes whose bound can't reach their kth score,
and visit the leaves that remain in the order of their bounds. Every query first searches its own shard; the kth
score it finds there goes along to all the others and prunes them.

Queries, however many, are written to the folder that all tasks share; every shard builds its tree once and reads them
a block at a time. None passes through the driver.

Defined results: null ids, null vectors and vectors with null or non-finite components take no part; vectors of
unequal length count as padded with zeros; equal scores go to the smaller id; a query never meets rows of its own
id; an id that repeats is one query (its smallest vector) and several candidates; repeated rows are candidates of their own;
an empty table gives no rows; a vector of any length takes part whole; columns beyond id and vector play no part, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, new_path
from .warc import filesystem

#: Vectors of a leaf, and queries that are searched together.
LEAF, BLOCK = 512, 2048


def to_matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column of integers, padded with zeros to equal length."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy()
    width = max(width, int(lens.max()) if len(lens) else 0)
    out = np.zeros((len(lens), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


class Tree:
    """levels: (low, high) boxes by level; leaf i of the last level holds rows ids[edges[i]:edges[i+1]]."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = [np.argsort(ids, kind="stable")]
        self.levels = [self._boxes(vectors, order)]
        while max(map(len, order)) > LEAF:
            halves = []
            for rows in order:
                v = vectors[rows]
                axis = int(np.argmax(v.max(0) - v.min(0))) if v.shape[1] else 0
                mid = len(rows) // 2
                cut = np.argpartition(v[:, axis], mid) if v.shape[1] else np.arange(len(rows))
                halves += [np.sort(rows[cut[:mid]]), np.sort(rows[cut[mid:]])] if len(rows) > 1 else [rows, rows[:0]]
            order = halves
            self.levels.append(self._boxes(vectors, order))
        rows = np.concatenate(order)
        self.vectors, self.ids = vectors[rows], ids[rows]
        self.edges = np.append(0, np.cumsum([len(r) for r in order]))

    @staticmethod
    def _boxes(vectors: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.array([len(g) > 0 for g in groups])
        zero = np.zeros(vectors.shape[1], np.int64)
        return np.stack([vectors[g].min(0) if len(g) else zero for g in groups]), np.stack([vectors[g].max(0) if len(g) else zero for g in groups]), full

    def search(self, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score) of what can be among the k best: scores of at least the query's kth so far."""
        limit = max(1, queries.shape[1]) * max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(self.vectors).max(initial=0)))
        kind = np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else object
        q = queries.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        alive = np.ones((len(q), 1), bool)
        for level, (low, high, full) in enumerate(self.levels):
            if level:
                alive = np.repeat(alive, 2, axis=1)
            bound = np.where(alive & full, (up @ high.T.astype(kind) + down @ low.T.astype(kind)), -np.inf)
            alive = bound >= kth[:, None]
        visit = np.argsort(-bound.astype(float), axis=1, kind="stable")
        best = np.full((len(q), k), -np.inf, object if kind is object else np.float64)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        kth = kth.astype(best.dtype)
        leaves = {}
        for wave in range(bound.shape[1]):
            leaf = visit[:, wave]
            go = np.flatnonzero(bound[np.arange(len(q)), leaf] >= kth)
            if not len(go):
                break
            for x in np.unique(leaf[go]):
                rows = go[leaf[go] == x]
                if x not in leaves:
                    own = slice(self.edges[x], self.edges[x + 1])
                    leaves[x] = self.vectors[own].T.astype(kind), self.ids[own]
                v, ids = leaves[x]
                s = (q[rows] @ v).astype(best.dtype)
                s[(query_ids[rows][:, None] == ids) | (s < kth[rows][:, None])] = -np.inf
                if s.shape[1] > 4 * k and kind is not object:  # all that ties with the kth stays in play
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    at, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                else:
                    at, col = np.nonzero(s > -np.inf)
                every_at = np.concatenate([at, np.repeat(np.arange(len(rows)), k)])
                every_s = np.concatenate([s[at, col], best[rows].ravel()])
                every_id = np.concatenate([ids[col], who[rows].ravel()])
                order = np.lexsort((every_id, -every_s.astype(float), every_at)) if kind is not object else np.array(sorted(range(len(every_at)), key=lambda i: (every_at[i], -every_s[i], every_id[i])), np.int64)
                every_at = every_at[order]
                nth = np.arange(len(order)) - np.searchsorted(every_at, every_at)
                top = order[nth < k]
                best[rows] = every_s[top].reshape(len(rows), k)
                who[rows] = every_id[top].reshape(len(rows), k)
                kth[rows] = np.maximum(kth[rows], best[rows][:, k - 1])
        at, col = np.nonzero(best > -np.inf)
        return at, who[at, col], np.array([int(x) for x in best[at, col]], np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a whole shard, which spark.sql.files.maxPartitionBytes bounds."""
    got = [(b.column(0).to_numpy(), b.column(1)) for b in batches if b.num_rows]
    if not got:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    width = max(int(c.value_lengths().to_numpy(zero_copy_only=False).max()) for _, c in got)
    return np.concatenate([i for i, _ in got]), np.concatenate([to_matrix(c, width) for _, c in got])


def _fit(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _blocks(path: str, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The written queries a block at a time: ids, vectors, kth scores. Read by the task itself, from the folder all share."""
    store, root = filesystem(path)
    for f in sorted(x.path for x in store.get_file_info(FileSelector(root)) if x.base_name.startswith("part-")):
        with store.open_input_file(f) as file:
            for b in pq.ParquetFile(file).iter_batches(rows):
                if b.num_rows:
                    yield b.column(0).to_numpy(), to_matrix(b.column(1)), b.column(2).to_numpy()


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, id and score of the k best inner products of floor(scale * component) for every query row."""
    spark = rows.sparkSession
    whole = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    ints = whole.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"), is_query.alias("_q"))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches]
        ids, vectors = _vectors(iter(held))
        if not len(ids):
            return
        asks = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held if b.num_rows])
        tree, mine = Tree(vectors, ids), np.flatnonzero(asks)
        for lo in range(0, len(mine), BLOCK):
            part = mine[lo : lo + BLOCK]
            at, _, score = tree.search(vectors[part], ids[part], np.full(len(part), -np.inf), k)
            full = np.bincount(at, minlength=len(part)) >= k
            least = np.full(len(part), np.iinfo(np.int64).min)
            if len(at):
                first = np.searchsorted(at, np.arange(len(part)))
                least[full] = [score[f : f + k].min() for f in first[full]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(list(vectors[part]), pa.list_(pa.int64())), pa.array(least)], ["query_id", "q", "kth"])

    asked = ints.mapInArrow(at_home, "query_id long, q array<long>, kth long").groupBy("query_id").agg(F.min(F.struct("q", "kth")).alias("x")).select("query_id", "x.q", "x.kth")
    path = new_path(spark, "queries")
    materialize(asked, "queries", path)

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = _vectors(batches)
        if not len(ids):
            return
        tree = None
        for query_ids, queries, kth in _blocks(path, BLOCK):
            width = max(queries.shape[1], vectors.shape[1])
            if tree is None or tree.vectors.shape[1] < width:
                tree = Tree(_fit(vectors, width), ids)
            least = np.where(kth == np.iinfo(np.int64).min, -np.inf, kth.astype(float))
            at, who, score = tree.search(_fit(queries, tree.vectors.shape[1]), query_ids, least, k)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(who), pa.array(score)], ["query_id", "id", "score"])

    out = ints.select("id", "v").mapInArrow(elsewhere, "query_id long, id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
