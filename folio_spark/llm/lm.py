"""LM scoring: a log-bilinear model over words, trained in numpy with noise-contrastive estimation.

The WORDS most frequent words of the training texts, the end of a text and one for all other words are predicted from
the two before: h = c1 * r[w1] + c2 * r[w2], and in two steps, P(w) = P(class | h) P(w | class, h). The SINGLE most
frequent words, the end and the rest are classes of their own; other words stand in classes of CLASS by rank. Both steps
are softmaxes of h times target vectors plus biases, normalised by matrix products over a batch of places (for words over
those of one class). A word of the rest has the smoothed share of its count. Probabilities of all words and one unknown
add up to one.

Training goes over all training texts: in each of ROUNDS rounds every partition runs noise-contrastive updates over its
share of its texts (each text has its turn once), starting from the current parameters; noise is shared by a batch, drawn
by class frequency and within classes evenly. Partitions' parameters are averaged by how often each row of them was
updated. Only parameters, whose size is fixed, reach the driver.

Counts: those of all words of the training texts. The (about HEAD) most frequent ones travel to the scoring tasks; words
outside HEAD are joined to their counts by Spark.

Defined results: a null or empty text is the end token alone; repeated rows are counted and scored as often as they
occur; a null id counts as empty text in the fold, so its row is held out; without training texts the counts are zero
and all classes equally likely; words of equal count are taken by a hash where only some have room; an empty table gives no
rows; a text of any length is scored whole; columns beyond id and text play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, give_back, keep, materialize, slices

#: Words that the model knows by name, those of them that are classes of their own, words in a class, words whose counts
#: travel, components of a vector.
WORDS, SINGLE, CLASS, HEAD, DIM = 16_384, 32, 128, 1 << 16, 16
#: Rounds of training, noise samples for a batch's classes and for a class's words, places in a batch, step size.
ROUNDS, NOISE, INNER, BATCH, RATE = 4, 16, 6, 16_384, 0.1
FLUSH = 300_000
#: Contexts that are normalised at a time: their logits stay in a core's cache. Texts that are tokenised and scored together.
CACHED, TOGETHER = 1024, 1000


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (as common.words has them), in order, and where those of each text begin; then their number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, bounds = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()
    whole = pc.binary_length(found).to_numpy() > 0  # white space at an end of a text leaves empty ones
    return found.filter(pa.array(whole)), np.append(0, np.cumsum(whole))[bounds - bounds[0]]


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """token (null: the end of a text) and its count over all rows of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep()
        schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])
        held, rows, ends = [], 0, 0

        def summed() -> pa.Table:
            return pa.Table.from_batches(held, schema).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(schema.names)

        for b in slices(batches, 0, rows=TOGETHER):
            found = pc.value_counts(tokenised(b.column(0))[0])
            held.append(pa.RecordBatch.from_arrays(found.flatten(), schema.names))
            rows, ends = rows + len(found), ends + b.num_rows
            if rows > 2 * FLUSH:
                held = summed().to_batches()
                rows = sum(x.num_rows for x in held)
                if rows > FLUSH:
                    yield from held
                    held, rows = [], 0
        if held:
            yield from summed().to_batches()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["token", "n"])
        del held
        give_back()

    return docs.select(text_col).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """About HEAD most frequent words: whole bands of counts, and of the band that is too large as many words, by a hash,
    as there is room for."""
    band = F.floor(F.log2("n") * 32).cast("int")
    left, whole, some = HEAD, 1 << 30, F.lit(False)
    for b, n in sorted(counts.groupBy(band.alias("b")).count().collect(), reverse=True):  # 32 rows for each doubling of counts
        if n > left:
            some = (band == b) & (F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < (left << 30) // n)
            break
        left, whole = left - n, b
    rows = counts.where((band >= whole) | some).collect()  # HEAD rows, and what a hash's spread adds
    return sorted(((bytes(t), n) for t, n in rows), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Words by rank with their counts; numbers of what the model predicts: words, then the end, then the rest."""

    def __init__(self, head: list[tuple[bytes, int]], ends: int, total: int, distinct: int):
        self.ends, self.total, self.distinct, self.single, self.width = ends, total, distinct, SINGLE, CLASS
        self.words = pa.array([w for w, _ in head], pa.binary())
        self.unknown = len(head)
        known = min(WORDS, len(head))
        self.end, self.rest, self.size = known, known + 1, known + 2
        n = np.array([n for _, n in head], np.float64) + 0.1
        self.raw = np.append(np.log10(n), 0.0)  # what a word, or one outside head before it is looked up, adds to the base score
        self.end_log = math.log10(ends + 0.1)
        self.log_all = math.log10(total + 0.1 * (distinct + 1))
        mass = np.append(n[:known], [ends + 0.1, 0.0])
        mass[self.rest] = max(0.1, total + 0.1 * (distinct + 1) - mass.sum() + (0.1 if not ends else 0.0))
        self.rest_log = math.log10(mass[self.rest])
        self.number = np.append(np.minimum(np.arange(len(head)), self.rest), self.rest).astype(np.int32)
        self.number[known:] = self.rest
        ranks = np.arange(known)
        blocks = -(-max(0, known - SINGLE) // CLASS)
        classes = min(SINGLE, known) + blocks
        self.of = np.append(np.where(ranks < SINGLE, ranks, SINGLE + (ranks - SINGLE) // CLASS), [classes, classes + 1]).astype(np.int32)
        self.classes = classes + 2
        self.first_block, self.blocks = min(SINGLE, known), blocks
        per = np.bincount(self.of, mass, self.classes)
        self.inner, self.outer = np.log(mass / per[self.of]).astype(np.float32), np.log(per / per.sum()).astype(np.float32)

    def block(self, c: int) -> tuple[int, int]:
        """The words of class c, by number."""
        lo = self.single + (c - self.first_block) * self.width
        return lo, min(lo + self.width, self.end)

    @cached_property
    def at(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def places(self, tokens: pa.Array) -> np.ndarray:
        return pc.index_in(tokens, value_set=self.words).fill_null(self.unknown).to_numpy()

    def sequences(self, places: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Numbers of each text's words, and the end. bounds: as tokenised() has them."""
        numbers = np.insert(self.number[places], bounds[1:], np.int32(self.end))
        return np.split(numbers, bounds[1:-1] + np.arange(1, len(bounds) - 1))


def contexts(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word, the one before and the one before that, of all places of sequences; before a text stand ends."""
    w = np.concatenate(sequences)
    first = np.cumsum([0, *map(len, sequences)])[:-1]
    one, two = np.append(np.int32(end), w[:-1]), np.append(np.array([end, end], np.int32), w[:-2])[: len(w)]
    one[first] = end
    two[first] = end
    second = first + 1
    two[second[second < len(w)]] = end
    return w, one, two


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values summed by number (under size): the numbers that occur and their sums."""
    numbers = np.flatnonzero(np.bincount(at, minlength=size))
    place = np.empty(size, np.intp)
    place[numbers] = np.arange(len(numbers))
    at, out = place[at], np.empty((len(numbers), values.shape[1]), np.float32)
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(at, values[:, j])
    return numbers, out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """z is used up."""
    np.negative(z, out=z)
    np.minimum(z, 80, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _log_sums(z: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of each row's exponentials; z is used up. Rows far from zero are shifted first."""
    if z.size and (z.max() > 60 or z[:, 0].min() < -60):
        top = z.max(1)
        return top + np.log(np.exp(z - top[:, None]).sum(1))
    return np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _log_softmax(h: np.ndarray, targets: np.ndarray, at: np.ndarray, named: np.ndarray) -> np.ndarray:
    """For each place, component `named` of the logarithm of the softmax of h[at] @ targets. at ascends, so the places of
    a row of h stand together, and it is normalised once for them."""
    new = np.append(True, at[1:] != at[:-1])
    begin, own = np.flatnonzero(new), np.cumsum(new) - 1
    rows, begin, out = at[begin], np.append(begin, len(at)), np.empty(len(at))
    for lo in range(0, len(rows), CACHED):
        z = h[rows[lo : lo + CACHED]] @ targets
        s = slice(begin[lo], begin[min(lo + CACHED, len(rows))])
        i = own[s] - lo
        out[s] = z[i, named[s]]
        out[s] -= _log_sums(z)[i]
    return out


class Bilinear:
    """r: vectors of words before a place; q and b: target vectors and biases of words within their class; qc and bc: of
    classes; c1 and c2: weights of the two places before. Rows of r and of the targets count their updates."""

    NAMES = ("r", "q", "b", "qc", "bc", "c1", "c2")

    def __init__(self, vocabulary: Vocabulary, parts: dict[str, np.ndarray]):
        self.v, self.p = vocabulary, parts

    @classmethod
    def new(cls, v: Vocabulary) -> Bilinear:
        rng = np.random.default_rng(7)
        small = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        zero = lambda n: np.zeros((n, DIM), np.float32)
        return cls(v, {"r": small(v.size), "q": zero(v.size), "b": v.inner[:, None].copy(), "qc": zero(v.classes), "bc": v.outer[:, None].copy(), "c1": np.ones((1, DIM), np.float32), "c2": np.full((1, DIM), 0.5, np.float32)})

    def copy(self) -> Bilinear:
        return Bilinear(self.v, {k: a.copy() for k, a in self.p.items()})

    def log10_probabilities(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log-probability of each word after the two before it. Two words that stand before many places are
        normalised once over the classes and once over each class that follows them."""
        p, v = self.p, self.v
        key = one.astype(np.int64) * v.size + two
        order = np.argsort(key)
        new = np.append(True, np.diff(key[order]) != 0)
        at, first, w = np.cumsum(new) - 1, order[new], w[order]
        h = np.ones((len(first), DIM + 1), np.float32)  # the last component meets the biases
        h[:, :DIM] = p["r"][one[first]] * p["c1"] + p["r"][two[first]] * p["c2"]
        outer, inner = (np.concatenate([p[k], p[b]], 1).T for k, b in (("qc", "bc"), ("q", "b")))
        c = v.of[w]
        sums = _log_softmax(h, outer, at, c)
        rows = np.flatnonzero((c >= v.first_block) & (c < v.first_block + v.blocks))
        rows = rows[np.argsort(c[rows], kind="stable")]
        for part in np.split(rows, np.flatnonzero(np.diff(c[rows])) + 1) if len(rows) else ():  # words that share their class with others
            a, e = v.block(int(c[part[0]]))
            sums[part] += _log_softmax(h, inner[:, a:e], at[part], w[part] - a)
        out = np.empty(len(w))
        out[order] = sums / math.log(10)
        return out

    def start(self, seed: int, rate: float) -> None:
        """Before updates: noise, and what Adagrad and the average keep of each row."""
        self.rng, self.rate = np.random.default_rng(seed), rate
        self.squares = {k: np.full((len(a), 1), 1e-4, np.float32) for k, a in self.p.items()}
        self.times = {k: np.zeros((len(a), 1), np.float32) for k, a in self.p.items()}
        share = np.exp(self.v.outer.astype(float))
        self.noise = share / share.sum()

    def _step(self, name: str, at: np.ndarray, gradient: np.ndarray, times: np.ndarray | float = 1.0) -> None:
        self.squares[name][at] += (gradient * gradient).mean(1, keepdims=True)
        self.p[name][at] -= (self.rate if gradient.shape[1] > 1 else self.rate / 4) * gradient / np.sqrt(self.squares[name][at])
        self.times[name][at] += times

    def update(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One noise-contrastive step over a batch of places."""
        p, v = self.p, self.v
        before = (p["r"][one], p["r"][two])
        both = np.ones((len(w), DIM + 1), np.float32)  # the last component meets the biases
        h = both[:, :DIM]
        np.multiply(before[0], p["c1"], out=h)
        h += before[1] * p["c2"]
        c = v.of[w]
        drawn = self.rng.choice(v.classes, NOISE, p=self.noise)
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        qc = p["qc"][c]
        real = _sigmoid(np.einsum("ij,ij->i", h, qc) + p["bc"][c, 0] - log_noise[c]) - 1
        false = _sigmoid(both @ np.concatenate([p["qc"][drawn], p["bc"][drawn] - log_noise[drawn, None]], 1).T)
        dh = real[:, None] * qc + false @ p["qc"][drawn]
        at, g = _sums(np.append(c, drawn), np.concatenate([real[:, None] * both, false.T @ both]), v.classes)
        inner = np.flatnonzero((c >= v.first_block) & (c < v.first_block + v.blocks))
        if len(inner):
            inner = inner[np.argsort(c[inner], kind="stable")]
            k, bk, target = c[inner], both[inner], w[inner]
            hk = bk[:, :DIM]
            begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            edges = np.append(begin, len(k))
            lo = v.single + (k[begin] - v.first_block) * v.width
            width = np.minimum(v.width, v.end - lo)
            some = lo[:, None] + (self.rng.random(INNER) * width[:, None]).astype(np.int32)  # the same share of each class's words
            shift = np.log(INNER / width).astype(np.float32)
            qt, qs = p["q"][target], np.concatenate([p["q"][some], p["b"][some] - shift[:, None, None]], 2)
            hit = _sigmoid(np.einsum("ij,ij->i", hk, qt) + p["b"][target, 0] - np.repeat(shift, np.diff(edges))) - 1
            back, miss, wrong = hit[:, None] * qt, np.empty((len(inner), INNER), np.float32), np.empty((len(begin), INNER, DIM + 1), np.float32)
            spans = list(zip(edges.tolist(), edges[1:].tolist()))  # the places of a class share its noise
            for i, (x, y) in enumerate(spans):
                np.matmul(bk[x:y], qs[i].T, out=miss[x:y])
            _sigmoid(miss)
            for i, (x, y) in enumerate(spans):
                back[x:y] += miss[x:y] @ qs[i, :, :DIM]
                np.matmul(miss[x:y].T, bk[x:y], out=wrong[i])
            dh[inner] += back
            at_q, g_q = _sums(np.append(target, some.ravel()), np.concatenate([hit[:, None] * bk, wrong.reshape(-1, DIM + 1)]), v.size)
            self._step("q", at_q, g_q[:, :DIM])
            self._step("b", at_q, g_q[:, DIM:])
        self._step("qc", at, g[:, :DIM])
        self._step("bc", at, g[:, DIM:])
        every = np.zeros(1, np.int64)
        for name, x in (("c1", before[0]), ("c2", before[1])):
            self._step(name, every, np.einsum("ij,ij->j", dh, x)[None], len(w))
        at, g = _sums(np.concatenate([one, two]), np.concatenate([dh * p["c1"], dh * p["c2"]]), v.size)
        self._step("r", at, g)


def train(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> Bilinear:
    """Rounds of noise-contrastive training over the texts of docs, averaged over its partitions."""
    spark = docs.sparkSession
    model = Bilinear.new(vocabulary)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)  # fixed by WORDS and HEAD

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            keep()
            m: Bilinear = sent.value.copy()
            m.start(1000 * turn + TaskContext.get().partitionId(), RATE / (1 + turn))
            v, held, size, steps = m.v, [], 0, 0
            for b in slices(batches, 0, rows=TOGETHER):
                tokens, bounds = tokenised(b.column(0))
                for sequence in v.sequences(v.places(tokens), bounds):
                    held.append(sequence)
                    size += len(sequence)
                    if size >= BATCH:
                        w, one, two = contexts(held, v.end)
                        for lo in range(0, len(w), BATCH):
                            m.update(*(x[lo : lo + BATCH] for x in (w, one, two)))
                        held, size, steps = [], 0, steps + 1
            if held:
                m.update(*contexts(held, v.end))
                steps += 1
            if steps:
                weight = {k: t + 1e-3 for k, t in m.times.items()}
                rows = [(i, (m.p[k] * weight[k]).astype(np.float32).tobytes(), weight[k].astype(np.float32).tobytes()) for i, k in enumerate(Bilinear.NAMES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "sums", "weights"])
            del m, held
            give_back()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for part, sums, weights in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    both = [np.frombuffer(x.as_buffer(), np.float32) for x in (sums, weights)]
                    total[part] = [x + y for x, y in zip(total[part], both)] if part in total else [x.copy() for x in both]
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array([t[i].tobytes() for t in total.values()], pa.binary()) for i in (0, 1))], ["part", "sums", "weights"])

        schema = "part int, sums binary, weights binary"
        share = docs.select(text_col).where(F.pmod(F.coalesce(F.xxhash64(text_col), F.lit(0)), F.lit(ROUNDS)) == turn)  # every text has its turn once
        learnt = share.mapInArrow(learn, schema).repartitionById(len(Bilinear.NAMES), "part").mapInArrow(average, schema)
        parts = {}
        for part, sums, weights in learnt.collect():  # seven rows: the parameters
            name = Bilinear.NAMES[part]
            parts[name] = (np.frombuffer(sums, np.float32).reshape(model.p[name].shape) / np.frombuffer(weights, np.float32)[:, None]).astype(np.float32)
        if parts:
            model = Bilinear(vocabulary, parts)
    return model


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    rows = docs.select(F.col(id_col), F.col(text_col), held_out.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = materialize(count_tokens(training, text_col), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = most_frequent(counts.where("token is not null"))
    ends = (counts.where("token is null").select("n").first() or [0])[0]
    vocabulary = Vocabulary(head, ends, total, distinct)
    shared = docs.sparkSession.sparkContext.broadcast(train(training, vocabulary, text_col))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep()
        m: Bilinear = shared.value
        v = m.v
        part, row = TaskContext.get().partitionId(), 0
        for b in slices(batches, 1, rows=TOGETHER):
            tokens, bounds = tokenised(b.column(1))
            at, n, lens = v.places(tokens), b.num_rows, np.diff(bounds)
            doc = np.repeat(np.arange(n), lens)
            out = np.flatnonzero(at == v.unknown)
            far = np.flatnonzero((at >= v.end) & (at < v.unknown))  # words of the rest whose counts are here
            rest = tokens.take(pa.array(out)).dictionary_encode()
            pairs, times = np.unique(doc[out] * (len(rest.dictionary) + 1) + rest.indices.to_numpy(), return_counts=True)
            owner, word = np.divmod(pairs, len(rest.dictionary) + 1)
            edges = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
            tail = np.bincount(doc[out], minlength=n)
            known = lens - tail + (1 if v.ends else 0)
            base = np.bincount(doc, v.raw[at], n) + v.end_log
            share = np.bincount(doc[far], v.raw[at[far]] - v.rest_log, n)
            model = np.add.reduceat(m.log10_probabilities(*contexts(v.sequences(at, bounds), v.end)), bounds[:-1] + np.arange(n))
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.int64(part) << 36) + row + np.arange(n)), b.column(0), b.column(2), pa.array(lens + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(share, pa.float64()), pa.array(tail, pa.int64()), pa.array(model), pa.ListArray.from_arrays(edges, rest.dictionary.take(pa.array(word))), pa.ListArray.from_arrays(edges, pa.array(times, pa.int64()))],
                ["_row", id_col, "held_out", "n_tokens", "_known", "_base", "_share", "_tail", "_class", "_words", "_times"],
            )
            row += n
        give_back()

    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("_known", T.LongType()), T.StructField("_base", T.DoubleType()), T.StructField("_share", T.DoubleType()), T.StructField("_tail", T.LongType()), T.StructField("_class", T.DoubleType()), T.StructField("_words", T.ArrayType(T.BinaryType())), T.StructField("_times", T.ArrayType(T.LongType()))])
    begun = materialize(rows.select(id_col, text_col, "held_out").mapInArrow(begin, schema), "begun")
    # Words outside HEAD meet their counts; unknown ones have none.
    pairs = begun.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("x")).select("_row", F.col("x._words").alias("token"), F.col("x._times").alias("times"))
    met = pairs.join(counts.where("token is not null"), "token", "left").select("_row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    tails = met.groupBy("_row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_k"), F.sum(F.col("times") * F.log10(F.col("n") + 0.1)).alias("_s"))
    whole = begun.drop("_words", "_times").join(tails, "_row", "left")
    extra, known = F.coalesce("_s", F.lit(0.0)), F.coalesce("_k", F.lit(0))
    return whole.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("_known") + known).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("_base") + extra - F.col("n_tokens") * F.lit(vocabulary.log_all)).alias("base_score"),
        (F.col("_class") + F.col("_share") + extra - F.col("_tail") * F.lit(float(vocabulary.rest_log))).alias("score"),
    )


def op6_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fold(F.col("doc_id"), 10) == 0)
