"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, reported as connected components.

Sets are cut into bands of like size, so that a set can only link with sets of its own band and the two next to
it. A band is light or heavy, by cost:

* light (small sets): every subset of the fixed size that a linked pair must share at least is a key;
* heavy (large sets): inverted lists of shingles. In one order of all shingles, rarest first, linked sets share one among
  their first ones (as many as a link lets them differ in, and one), so a set stands in the lists of these only. A shingle
  that no other set has fills such a place without a list: what resembles nothing stands in none.

The boundary is the band at which enumerating subsets costs more than the lists and their scan, estimated from the
histogram of sizes. Both are exact: a linked pair shares a key. Only shingles that several sets have count for what
sets share, so nothing else of a set is kept.

Lists are never expanded into all their pairs. Equal sets are one node from the start. In each turn every node is compared
with one leader, the one that leads most of its lists, and components of what links are formed. Last, lists whose
members still stand in different components are scanned: each set runs through the inverted lists of its shingles and
is compared with all sets of other components. What is skipped joins nodes that are joined already.

A bucket of the exchange holds about BUCKET shingles, whatever the input, besides the entries of one frequent shingle.

Defined results: a text without words, or a null one, has an empty set, n_shingles 0, and is a component of its own;
a text with fewer words than a shingle has its whole word sequence as the one shingle; repeated rows are equal sets
and so one component; rows with null ids have a null component unless linked with others. A tie for a component's
row goes to the lowest hash; a text of any length is one set; an empty table gives no rows; columns beyond id and text
play no part, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, join_small, materialize, mix, same_row, words

#: Scanning one entry of an inverted list, in units of writing one key.
SCAN_COST = 1.5
#: Shingles that a task packs at a time, and that one bucket of the exchange holds on average.
PART, BUCKET = 1 << 20, 1 << 21
#: Shingles of the sets that are compared in one place: longer lists are laid out as a grid of chunks.
CHUNK = 1 << 20
#: Turns in which each node is compared with one leader, before what is left of the lists is scanned.
TURNS = 2


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    t = words(text)
    if not t:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, t), np.uint64, len(t))
    n = max(1, len(t) - k + 1)
    x = np.zeros(n, np.uint64)
    for i in range(min(k, len(t))):
        x = (x + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mix(x + np.uint64(len(t) if len(t) < k else 0)))


def node_of(x: np.ndarray) -> int:
    """One number for a set: equal for equal sets."""
    return int(np.bitwise_xor.reduce(mix(x ^ np.uint64(0xA5A5A5A55A5A5A5A))) ^ mix(np.array([len(x)], np.uint64))[0])


def least_overlap(a: int, b: int, percent: int) -> int:
    """Least overlap o with 100 * o >= percent * (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


@lru_cache(maxsize=None)
def band(i: int, percent: int) -> tuple[int, int]:
    """Sizes of band i: the largest is as far from the smallest as a link allows."""
    lo = 1 if i == 0 else band(i - 1, percent)[1] + 1
    return lo, lo * 100 // percent


def band_of(n: int, percent: int) -> int:
    i = 0
    while band(i, percent)[1] < n:
        i += 1
    return i


@lru_cache(maxsize=None)
def shared_least(i: int, percent: int) -> int:
    """The least that linked sets of band i, or of bands i - 1 and i, share."""
    lo = band(i, percent)[0]
    return least_overlap(max(band(i - 1, percent)[0] if i else lo, -(-percent * lo // 100)), lo, percent)


def prefix(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """How many of a set's n shingles, in any order that holds for all sets, include one that each linked set has among its own first ones."""
    return n + 1 - -(-percent * n // 100)


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The first heavy band, by the cost of the keys of all sets. histogram: sets by band, up to the largest."""
    top = max(histogram, default=0) + 2
    light, heavy = [], []
    for i in range(top):
        sizes = [(band(j, percent)[1], histogram.get(j, 0)) for j in (i - 1, i) if j >= 0]
        light.append(sum(n * math.comb(size, min(size, shared_least(i, percent))) for size, n in sizes) if band(i, percent)[1] <= 40 else math.inf)
        heavy.append(sum(n * prefix(size, percent) for size, n in sizes) * (1 + SCAN_COST))
    return min(range(top + 1), key=lambda x: sum(light[:x]) + sum(heavy[x:]))


def keys_of(x: np.ndarray, n: int, percent: int, first_heavy: int) -> np.ndarray:
    """The keys of a set of n shingles, for pairs within its band and with the next one. x: those of its shingles that
    other sets have too, in the common order (rarest first); what comes before them in the set is its own alone."""
    own, out = band_of(n, percent), []
    for i in (own, own + 1):
        c = shared_least(i, percent)
        if i < first_heavy and c <= len(x):
            salt = np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
            mixed = mix(x ^ salt)
            out.append(mix(np.array([int(np.bitwise_xor.reduce(mixed[list(s)])) for s in itertools.combinations(range(len(x)), c)], np.uint64) ^ salt))
    if own + 1 >= first_heavy:
        out.append(x[: max(0, prefix(n, percent) - (n - len(x)))])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets_of(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """id, node (equal for equal sets, null for empty ones), n_shingles, the set's band, and the text's hash."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [(node_of(x), len(x)) if len(x := shingles(t.as_py(), k)) else (None, 0) for t in b.column(1)]
            node = pa.array([v if v is None else int(np.uint64(v).astype(np.int64)) for v, _ in sets], pa.int64())
            bands = pa.array([band_of(n, percent) if n else -1 for _, n in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), node, pa.array([n for _, n in sets], pa.int64()), bands, b.column(2)], [id_col, "node", "n_shingles", "band", "text_hash"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("text_hash", T.LongType())])
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(measure, schema)


PACKED = "bucket int, node binary, n binary, many binary, x binary, rarity binary"


def _packed(bucket: np.ndarray, buckets: int, owner: np.ndarray, node: np.ndarray, n: np.ndarray, x: np.ndarray, rarity: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a bucket: the nodes (by owner) that have shingles in it, their sizes, how many each has, and these."""
    order = np.lexsort((owner, bucket))
    bucket, owner, x, rarity = bucket[order], owner[order], x[order], rarity[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        lo, hi = edges[k], edges[k + 1]
        o = owner[lo:hi]
        first = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        rows.append((k, node[o[first]].tobytes(), n[o[first]].tobytes(), np.diff(np.append(first, hi - lo)).astype(np.int32).tobytes(), x[lo:hi].tobytes(), rarity[lo:hi].tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], ["bucket", "node", "n", "many", "x", "rarity"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """owner, node, n, x and rarity of all rows; node and n have an entry an owner, the others one a shingle."""
    parts = [[], [], [], [], []]
    for b in batches:
        for part, column, kind in zip(parts, b.columns[1:], (np.uint64, np.int32, np.int32, np.uint64, np.uint8)):
            part.extend(np.frombuffer(v.as_buffer(), kind) for v in column)
    if not parts[0]:
        return None
    node, n, many, x, rarity = map(np.concatenate, parts)
    return np.repeat(np.arange(len(node)), many), node, n, x, rarity


def members_of(docs: DataFrame, text_col: str, k: int, percent: int, first_heavy: int, buckets: int) -> DataFrame:
    """node, n, band, x and keys of every set that has a key: x holds the shingles that other sets have too.

    Shingles go to a bucket by their hash and are counted there; those of two sets or more go to a bucket of their set.
    The common order is by that count (its logarithm in steps) and hash. Both exchanges carry packed arrays.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            n = np.fromiter(map(len, held.values()), np.int32, len(held))
            x = np.concatenate([*held.values()])
            yield from _packed(((x >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32), buckets, np.repeat(np.arange(len(n)), n), np.fromiter(held, np.uint64, len(n)), n, x, np.zeros(len(x), np.uint8))

        for b in batches:
            for t in b.column(0):
                x = shingles(t.as_py(), k)
                if len(x) and (node := node_of(x)) not in held:
                    held[node] = x
                    total += len(x)
                    if total >= PART:
                        yield from flush()
                        held, total = {}, 0
        if held:
            yield from flush()
        held = {}
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _unpacked(batches)
        if got is None:
            return
        owner, node, n, x, _ = got
        order = np.argsort(x, kind="stable")
        for distinct in (False, True):  # equal sets of different parts count once, which matters only for what stands twice
            xs = x[order]
            if distinct:
                order = order[np.lexsort((node[owner[order]], xs))]
                xs, who = x[order], node[owner[order]]
                fresh = np.append(True, (xs[1:] != xs[:-1]) | (who[1:] != who[:-1]))[: len(xs)]
                order, xs = order[fresh], xs[fresh]
            first = np.flatnonzero(np.append(True, xs[1:] != xs[:-1])[: len(xs)])
            times = np.diff(np.append(first, len(xs)))
            order, rarity = order[np.repeat(times > 1, times)], np.repeat(times, times)[np.repeat(times > 1, times)]
        if len(order):
            owner = owner[order]
            yield from _packed(((mix(node[owner]) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32), buckets, owner, node, n, x[order], np.minimum(255, 8 * np.log2(rarity)).astype(np.uint8))
        del got, owner, node, n, x, order, xs, rarity
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _unpacked(batches)
        if got is None:
            return
        owner, node, n, x, rarity = got
        n, node = n[owner], node[owner]
        order = np.lexsort((x, rarity, node))
        n, node, x = n[order], node[order], x[order]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        shared, size = np.diff(np.append(first, len(node))), n[first]
        some = (prefix(size, percent) - (size - shared) > 0) | (size < band(first_heavy, percent)[0])
        rows = []
        for at, s in zip(first[some].tolist(), shared[some].tolist()):
            keys = keys_of(x[at : at + s], int(n[at]), percent, first_heavy)
            if len(keys):
                rows.append((int(node[at].astype(np.int64)), int(n[at]), band_of(int(n[at]), percent), np.sort(x[at : at + s]).tobytes(), keys.view(np.int64)))
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
        del got, owner, node, n, x, rarity, order, rows
        give_back()

    kinds = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("band", pa.int32()), ("x", pa.binary()), ("keys", pa.list_(pa.int64()))])
    counted = docs.select(text_col).mapInArrow(spread, PACKED).repartitionById(buckets, "bucket").mapInArrow(count, PACKED)
    return counted.repartitionById(buckets, "bucket").mapInArrow(gather, "node long, n long, band int, x binary, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of every node that has an edge (a, b).

    Alternates large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    current = materialize(pairs, "edges")
    before = None
    while True:
        both = current.select("a", "b").union(current.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > u").select(F.col("m").alias("a"), "b")
        up = large.where("a < b").distinct()
        down = up.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = up.join(down, up["b"] == down["u"])
        small = small.select(F.col("m").alias("a"), "b").union(small.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        current = materialize(small.where("a < b").distinct(), "edges")
        state = tuple(current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).union(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def linked_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link."""
    sides = [members.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("x").alias(f"x_{c}")) for c in ("a", "b")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "x_a", "x_b").mapInArrow(compare, "a long, b long")


def link_within(node: np.ndarray, root: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all of these sets that links join, none between what stands in one component already.

    Each set scans the inverted lists of its shingles for what it shares with the sets of other components.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    by_token = np.argsort(token, kind="stable")
    posted, ends = owner[by_token], np.cumsum(np.bincount(token))
    begins = np.append(0, ends[:-1])
    own = np.append(0, np.cumsum(size))
    part, out = np.unique(root, return_inverse=True)[1], []
    for i in range(len(sets)):
        if (part == part[i]).all():
            break
        t = token[own[i] : own[i + 1]]
        length = ends[t] - begins[t]
        at = np.repeat(begins[t] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
        both = np.bincount(posted[at], minlength=len(sets))
        for j in np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (part != part[i])).tolist():
            if part[j] != part[i]:
                out.append((int(node[i]), int(node[j])))
                part[part == part[j]] = part[i]
    return out


def scan_lists(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what shares a list and links, but for what its root joins already. lists: key, node, n, root.

    A list whose sets have more than CHUNK shingles is laid out as a grid of chunks, so no place holds more than two. The
    places are found first; sets move to them once.
    """
    chunks = lists.groupBy("key").agg(F.sum("n").alias("_n")).where(F.col("_n") > CHUNK).select("key", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_c"))
    own = lists.join(chunks, "key", "left").withColumn("_c", F.coalesce("_c", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("node"), "_c").cast("int"))
    other = F.when(F.col("_c") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_c") - 1))
    places = own.select("key", "_own", F.explode(other).alias("_o"), "node", "root", "n").select("key", F.least("_own", "_o").alias("_lo"), F.greatest("_own", "_o").alias("_hi"), "node", "root", "n")
    laid = places.join(members.select("node", F.col("x").alias("_x")), "node").select("key", "_lo", "_hi", "node", "root", "n", "_x")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []

        def linked() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                node, root, n, sets = zip(*rows)
                if found := link_within(np.array(node), np.array(root), np.array(n), list(sets), percent):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        for b in batches:
            head = list(zip(*(b.column(i).to_pylist() for i in range(6))))
            for (key, lo, hi, node, root, n), x in zip(head, b.column(6)):
                if (key, lo, hi) != place:
                    yield from linked()
                    place, rows = (key, lo, hi), []
                rows.append((node, root, n, np.frombuffer(x.as_py(), np.uint64)))
        yield from linked()

    return laid.repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi", "node").mapInArrow(scan, "a long, b long").distinct()


def different_lists(lists: DataFrame) -> DataFrame:
    """Of lists with the same members one stays: the others give the same pairs."""
    members = lists.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n"))
    return lists.join(members.where("n > 1").groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def led_pairs(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each node with the leader that leads most of its lists, of those it is not joined with and can link with by size.

    A list's leader among the sets of one band is the one whose number hashes lowest in this turn.
    """
    leaders = lists.groupBy("key", "band").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root", "n")).alias("l"))
    met = lists.join(leaders, ["key", "band"]).where((F.col("l.root") != F.col("root")) & (100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n")))
    times = met.groupBy(F.col("node").alias("a"), F.col("l.node").alias("b")).agg(F.count("*").alias("times"))
    return times.groupBy("a").agg(F.max(F.struct("times", "b")).alias("p")).select("a", "p.b")


def linked_sets(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The measured rows of docs; and node and root (equal for linked nodes) of the nodes that have a link."""
    spark = docs.sparkSession
    measured = materialize(sets_of(docs, id_col, text_col, k, percent), "sets")
    bands = measured.where("node is not null").groupBy("band").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total")).collect()  # a row a band: the log of the largest size
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["total"] for r in bands) // BUCKET))
    members = materialize(members_of(docs, text_col, k, percent, boundary({r["band"]: r["sets"] for r in bands}, percent), buckets), "members")
    lists = materialize(members.select(F.explode("keys").alias("key"), "node", "n", "band"), "lists")
    links = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")

    def open_lists() -> DataFrame:
        """The lists whose nodes stand in several components."""
        placed = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = placed.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("key")
        return materialize(placed.join(several, "key", "left_semi"), "lists")

    for turn in range(TURNS + 1):
        lists = open_lists().select("key", "node", "n", "band", "root")
        if turn < TURNS:
            found = linked_pairs(materialize(led_pairs(lists, turn, percent), "pairs"), members, percent)
        else:
            found = scan_lists(different_lists(lists.select("key", "node", "n", "root")), members, percent)
        found = materialize(found, "links")
        if not found.isEmpty():
            links = links.union(found)
            roots = materialize(components(links), "roots")
        lists = lists.drop("root")
    return measured, roots


def _placed(measured: DataFrame, roots: DataFrame) -> DataFrame:
    """measured with the root of each row's component; rows without a set have none."""
    return join_small(measured, roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach) of every row of docs."""
    rows = _placed(*linked_sets(docs, id_col, text_col, k, percent))
    names = materialize(rows.where("root is not null").groupBy("root").agg(F.min(id_col).alias("component_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "components")
    return join_small(rows, names, "root", "left").select(id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the smallest id's, of its texts the one with the smallest hash. Texts without
    words are components of their own, so they all stay."""
    rows = _placed(*linked_sets(docs, id_col, text_col, k, percent)).where("root is not null")
    keys = materialize(rows.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_text")).agg(F.min("root").alias("root"), F.count("*").alias("n")), "components")
    first = materialize(keys.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text")).alias("k")).select("k._id", "k._text"), "first")
    on = keys["_id"].eqNullSafe(first["_id"]) & (keys["_text"] == first["_text"])
    gone = materialize(keys.join(first, on, "left_anti").select("_id", "_text"), "gone")
    twice = materialize(keys.where("n > 1").join(first, on, "left_semi").select("_id", "_text"), "twice")
    kept = join_small(docs, gone, same_row(docs, id_col, text_col, gone), "left_anti")
    if twice.isEmpty():
        return kept
    # Rows with the same id and text: the one whose other columns hash lowest.
    again = join_small(kept, twice, same_row(kept, id_col, text_col, twice), "left_semi")
    rank = F.xxhash64(*(f.name for f in docs.schema if isinstance(f.dataType, T.AtomicType)))
    again = again.groupBy(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text")).agg(F.min_by(F.struct(*docs.columns), rank).alias("_row")).select("_row.*")
    return join_small(kept, twice, same_row(kept, id_col, text_col, twice), "left_anti").unionByName(again)


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
  e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
  l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
