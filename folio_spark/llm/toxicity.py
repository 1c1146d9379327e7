"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character 3- to 5-grams (with word ends marked), so a
misspelling that was never seen still shares most of its vectors with the word it comes from. The bag that
is averaged is a window of WINDOW words: a document's score is that of its most toxic window, which keeps
one insult in a long text from being diluted away. Training follows the same rule (the window that scores
highest stands for its document), on a bounded sample of labelled rows.

Since the classifier is linear, a word adds one number, its embedding times the softmax direction; scoring
looks up those numbers for whole texts.

Defined results: a null or empty text has no window and scores the prior of the softmax bias, kept under
0.5; rows with null doc_id are scored and count as held out; labels that are null or for unknown ids are
ignored; an id labelled twice with different values is left out of training; without any labelled row of
both classes every score is 0; an empty table gives no rows; repeated rows score alike; of equal words in a window
one counts; a text of any length is scored, and trained on, whole. Extra columns of the input pass through, but one named as the
output gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, give_back

WINDOW, DIM, BUCKETS, GRAMS = 16, 8, 1 << 17, (3, 4, 5)
#: Rows labelled 0 and 1 that training may take, by the order of a hash of their ids.
SAMPLE = (6000, 3000)
#: Visits of documents that training makes: it passes over its sample as often as that takes.
VISITS = 72_000
#: Sampled documents that must share an n-gram before it gets a vector.
RARE = 3
#: Words that are taken apart at a time.
PART = 20_000
#: Words whose scores a task keeps, and the range of the sample's hashes.
CACHE, SPAN = 300_000, 1 << 40

_STRIP = bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~"


def normal_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def grams_of(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens' n-grams, token after token, and how many each token has (at least 1)."""
    if len(tokens) > PART:  # the arrays below take some hundred bytes a character
        parts = [grams_of(tokens[i : i + PART]) for i in range(0, len(tokens), PART)]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])
    bare = [b"<" + (t.strip(_STRIP) or t) + b">" for t in tokens]
    lens = np.fromiter(map(len, bare), np.int64, len(bare))
    data = np.frombuffer(b"".join(bare) + b"\0" * max(GRAMS), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(bare)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(lens.sum())  # bytes from here to the token's end
    n = len(owner)
    h, found, whose = np.zeros(n, np.uint64), [], []
    for k in range(1, max(GRAMS) + 1):
        h = h * np.uint64(0x100000001B3) + data[k - 1 : k - 1 + n] + np.uint64(1)
        if k in GRAMS:
            ok = left >= k
            x = h[ok] ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((x >> np.uint64(40)) % np.uint64(BUCKETS))
            whose.append(owner[ok])
    ids, whose_ = np.concatenate(found).astype(np.int32), np.concatenate(whose)
    order = np.argsort(whose_, kind="stable")
    return ids[order], np.bincount(whose_, minlength=len(bare)).astype(np.int32)


@dataclass
class Model:
    table: np.ndarray  # what each bucket adds to log-odds, before averaging
    bias: float

    def word_scores(self, tokens: list[bytes]) -> np.ndarray:
        ids, counts = grams_of(tokens)
        ends = np.cumsum(counts)
        return (np.add.reduceat(self.table[ids], ends - counts) / counts).astype(np.float64)


def window_means(values: np.ndarray) -> np.ndarray:
    """Sums over the distinct words of each window, divided by its length: repeating a word adds nothing."""
    n = -(-len(values) // WINDOW)
    grid = np.zeros(n * WINDOW)
    grid[: len(values)] = values
    grid = np.sort(grid.reshape(n, WINDOW), axis=1)
    total = grid[:, 0] + (grid[:, 1:] * (grid[:, 1:] != grid[:, :-1])).sum(1)
    return total / np.minimum(WINDOW, len(values) - np.arange(n) * WINDOW)


def first_in_window(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 at the first place of a word in its window, else 0."""
    once = np.zeros(len(flat), np.float32)
    for lo in range(0, len(first), 1 << 15):
        begin, n = first[lo : lo + (1 << 15)], size[lo : lo + (1 << 15)]
        inside = np.arange(WINDOW) < n[:, None]
        place = np.minimum(begin[:, None] + np.arange(WINDOW), len(flat) - 1)
        grid = np.where(inside, flat[place], -1)
        for j in range(WINDOW):
            fresh = inside[:, j] & (grid[:, :j] != grid[:, j : j + 1]).all(1)
            once[place[fresh, j]] = 1
    return once


def train(texts: Iterable[list[bytes]], toxic: list[int] | np.ndarray, visits: int = VISITS, rate: float = 3.0, seed: int = 1) -> Model:
    """Jointly fit bucket vectors and softmax weights with Adagrad over mini-batches of windows.

    toxic: the labels, which may be filled in while texts is read.
    """
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    docs = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in t), np.int32, len(t)) for t in texts]
    toxic = np.array(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    ids, counts = grams_of(list(vocab))
    begins = np.cumsum(counts, dtype=np.int64) - counts
    # Buckets that fewer than RARE sampled documents touch keep a zero vector: they can only be noise.
    seen_in = np.zeros(len(vocab), np.int64)
    for d in docs:
        seen_in[np.unique(d)] += 1
    touched = np.zeros(BUCKETS)
    for i in range(0, len(counts), PART):
        n = counts[i : i + PART]
        touched += np.bincount(ids[begins[i] : begins[i] + n.sum()], weights=np.repeat(seen_in[i : i + PART], n), minlength=BUCKETS)
    live = touched >= RARE
    emb = (rng.normal(0, 0.05, (BUCKETS, DIM)) * live[:, None]).astype(np.float32)
    out = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sums, out_sum, bias_sum = np.full(BUCKETS, 1e-6, np.float32), np.full((2, 1), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    epochs = max(1, -(-visits // len(docs)))
    flat = np.concatenate(docs)
    docs.clear()
    windows = -(-lens // WINDOW)
    window_doc = np.repeat(np.arange(len(lens)), windows)
    within = np.arange(len(window_doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    first = np.repeat(np.cumsum(lens) - lens, windows) + WINDOW * within
    size = np.minimum(WINDOW, lens[window_doc] - WINDOW * within)
    once = first_in_window(flat, first, size)
    for epoch in range(epochs):
        direction = out[1] - out[0]
        worth = (np.add.reduceat((emb @ direction)[ids], begins) / counts).astype(np.float32)
        score = np.add.reduceat(worth[flat] * once, first) / size
        # The highest-scoring window of each document, and two at random; at first only random ones of it.
        order = np.lexsort((score, window_doc))
        last = order[np.append(np.flatnonzero(np.diff(window_doc[order])), len(order) - 1)]
        spread = rng.permutation(len(window_doc))
        _, one = np.unique(window_doc[spread], return_index=True)
        spread2 = rng.permutation(len(window_doc))
        _, two = np.unique(window_doc[spread2], return_index=True)
        if epoch < epochs // 4:
            chosen = np.concatenate([spread[one], spread2[two], rng.permutation(len(window_doc))[: 2 * len(lens)]])
        else:
            other = spread[one]
            chosen = np.concatenate([last, last[toxic[window_doc[last]] == 1], other[toxic[window_doc[other]] == 0]])
        chosen = rng.permutation(np.unique(chosen))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(chosen), 128):
            take = chosen[at : at + 128]
            n = size[take]
            row = np.repeat(np.arange(len(take)), n)
            place = np.repeat(first[take], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            token = flat[place]
            m = counts[token]
            gram = ids[np.repeat(begins[token], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            share = np.repeat(once[place] / (m * n[row]), m).astype(np.float32)
            ends = np.cumsum(np.add.reduceat(m, np.cumsum(n) - n))
            begin = np.append(0, ends[:-1])
            bag = np.add.reduceat(emb[gram] * share[:, None], begin)
            logit = bag @ out.T + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(take)), toxic[window_doc[take]]] -= 1
            g_out, g_bias, g_bag = p.T @ bag / 128, p.mean(0), p @ out
            per = np.repeat(g_bag, np.diff(np.append(begin, len(gram))), axis=0) * share[:, None] * WINDOW
            uniq, back = np.unique(gram, return_inverse=True)
            order2 = np.argsort(back, kind="stable")
            edges = np.searchsorted(back[order2], np.arange(len(uniq)))
            g = np.add.reduceat(per[order2], edges)
            sums[uniq] += (g * g).mean(1)
            emb[uniq] -= live[uniq, None] * (0.1 * step * g / np.sqrt(sums[uniq])[:, None])
            out_sum += (g_out * g_out).mean(1, keepdims=True)
            bias_sum += g_bias * g_bias
            out -= 0.05 * step * g_out / np.sqrt(out_sum)
            bias -= 0.05 * step * g_bias / np.sqrt(bias_sum)
    return Model((emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: tuple[int, int]) -> DataFrame:
    """At most per_class[y] ids of label y that lie outside the held-out fold, by hash order, and their words."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col), 5) != 0))
        .groupBy(id_col)
        .agg(F.min("toxic").alias("_lo"), F.max("toxic").alias("_hi"))
        .where("_lo = _hi")
        .select(F.col(id_col).alias("_id"), F.col("_lo").cast("int").alias("_toxic"), F.pmod(F.xxhash64(id_col), F.lit(SPAN)).alias("_h"))
    )
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    # Only so much of the hash's range as holds per_class[y] rows for certain is put in order.
    part = [min(SPAN, int(SPAN * (1.5 * per_class[y] + 200) / max(1, sizes.get(y, 0)))) for y in (0, 1)]
    both = [known.where((F.col("_toxic") == y) & (F.col("_h") < part[y])).orderBy("_h", "_id").limit(per_class[y]) for y in (0, 1)]
    picked = F.broadcast(both[0].unionByName(both[1]))  # at most sum(per_class) rows of three numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [b" ".join(normal_words(text.as_py())) for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.binary()), b.column(2)], ["_id", "_bag", "_toxic"])

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_bag", T.BinaryType()), T.StructField("_toxic", T.IntegerType())])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id").select("_id", "_text", "_toxic").mapInArrow(cut, schema).where(F.octet_length("_bag") > 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: tuple[int, int] = SAMPLE) -> Model:
    """Fit on at most per_class[y] rows labelled y outside the held-out fold (crc32 of the id mod 5 = 0).

    The sample is bounded, so one task trains on it; only the finished table comes to the driver.
    """

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: list[int] = []

        def bags() -> Iterator[list[bytes]]:
            for b in batches:
                for bag, y in zip(b.column(1), b.column(2).to_pylist()):
                    toxic.append(y)
                    yield bag.as_py().split()

        model = train(bags(), toxic)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias])], ["table", "bias"])

    rows = _sample(docs, labels, id_col, text_col, per_class).repartition(1).sortWithinPartitions("_id", "_bag")
    found = rows.mapInArrow(fitted, "table binary, bias double").first()
    if found is None:  # no row at all
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    table, bias = found
    return Model(np.frombuffer(table, np.float32), bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS float32, fixed
    keep = [c for c in docs.columns if c != out]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        cache: dict[bytes, float] = {}
        for b in batches:
            texts = b.column(keep.index(text_col)).to_pylist()
            result = np.empty(len(texts))
            for at in range(0, len(texts), 256):
                bags = [normal_words(t) for t in texts[at : at + 256]]
                new = [w for w in {w for bag in bags for w in bag} if w not in cache]
                if len(cache) + len(new) > CACHE:
                    cache.clear()
                    new = list({w for bag in bags for w in bag})
                for i in range(0, len(new), PART):
                    cache.update(zip(new[i : i + PART], m.word_scores(new[i : i + PART]).tolist()))
                for i, bag in enumerate(bags):
                    best = float(window_means(np.fromiter(map(cache.__getitem__, bag), np.float64, len(bag))).max()) if bag else 0.0
                    z = best + m.bias if bag else min(m.bias, -1e-9)
                    result[at + i] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(result)], [*keep, out])
        cache.clear()
        give_back()

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    return docs.select(*keep).mapInArrow(scored, schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
