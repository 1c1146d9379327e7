"""Packing, top-k search, sharding, WARC and the pipeline against brute force and round trips."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio_spark.llm import packing, sharding, topk, warc


def ids_of(text, full):
    return np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check_layout(rows, capacity=2048):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_places_every_token(spark):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.tokenizer_path())
    r = random.Random(3)
    texts = [None, "", " ", "a", "two  spaces \n and <|endoftext|> text", "word " * 5000, "x" * 9000] + [" ".join(r.choice(["alpha", "beta", "gamma,", "é\n", "delta."]) for _ in range(r.randrange(900))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate([*texts, *texts[:4]])] + [(0, None, 1, 2)], "doc_id long, text string, piece int, offset long")
    rows = packing.pack_documents(docs).collect()
    assert check_layout(rows) >= math.ceil(sum(r["length"] for r in rows) / 2048)
    got = collections.defaultdict(list)
    for x in rows:
        got[x["doc_id"]].append((x["piece"], x["start"], x["length"], x["ids_crc32"]))
    for i, t in enumerate([*texts, *texts[:4]]):
        ids = ids_of(t, full)
        edges = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert sorted(got[i]) == sorted(want * (2 if i == 0 else 1))
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_whole_and_tight(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(6, 1, 4000).astype(int), 1, 2048)
    h = np.bincount(lengths, minlength=2049)
    used = np.zeros(2049, np.int64)
    sequences = 0
    for contents, n in packing.plan(h, 2048):
        assert sum(v * m for v, m in contents) <= 2048
        for v, m in contents:
            used[v] += m * n
        sequences += n
    assert (used == h).all()
    assert sequences <= 1.02 * math.ceil(lengths.sum() / 2048) + 1


def test_non_negative_least_squares_recovers_patterns():
    h = np.zeros(101, np.int64)
    for pattern, n in (((10, 90), 40), ((20, 30, 50), 70), ((100,), 5)):
        for v in pattern:
            h[v] += n
    steps = packing.plan(h, 100)
    assert sum(n for _, n in steps) == 115


def brute_top(vectors, k=5):
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors.items() if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in (i for i in ints if i % 50 == 0):
        score = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:k]
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(score, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = {i: [float(x) for x in r.normal(0, 0.2, 8)] for i in range(2300)}
    for i in range(100, 700):
        vectors[i] = [0.25] * 8  # many equal ones: ties go to the smaller id
    vectors |= {50: None, 100: [float("nan")] * 8, 150: [None] + [0.1] * 7, 200: [float("inf")] * 8, 250: [0.5] * 3, 300: [], 3: [1.0, 2.0]}
    rows = [(i, v, 1, 2) for i, v in vectors.items()] + [(None, [0.1] * 8, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int").repartition(5)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(vectors)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("block", [4, 1 << 11])
def test_top_k_in_several_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(2)
    vectors = {i: [float(x) for x in r.normal(0, 1, 4)] for i in range(1000)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == brute_top(vectors)


def test_shards_are_contiguous_and_near_equal(spark):
    r = random.Random(2)
    texts = ["copy of a text"] * 400 + ["x" * r.randrange(200) for _ in range(700)] + [None, "", "é" * 50] + ["rare twin"] * 2
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, "n", 9), (7, "copy of a text", 9)], "doc_id long, text string, shard int").repartition(3)
    rows = sharding.shard_by_bytes(docs).collect()
    assert len(rows) == docs.count()
    size, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    by_id = dict(enumerate(texts))
    for x in rows:
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        if x["doc_id"] is not None:
            text = (by_id[x["doc_id"]] or "").encode()
            assert x["size"] == len(text) + 1 and x["text_crc32"] == zlib.crc32(text)
            where[text].add(x["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) - min(size.values()) <= 0.05 * sum(size.values()) / 8
    assert len(where[b"rare twin"]) == 1
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    warc.prepare(spark)
    big, path = "é" * 700, f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(1, big, "u"), (2, big, "u"), (3, "small", "u"), (4, "small", "u"), (5, None, "u"), (6, "b" * 1000, "u"), (None, big, "u"), (2, big, "u")], "page_id long, html string, payload string")
    warc.archive_pages(pages, path)
    rows = spark.read.format("warc").load(path).collect()
    assert len(rows) == 8
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r["date"]) and r["target_uri"].startswith("urn:page:") for r in rows)
    got = collections.Counter((r["page_id"], r["warc_type"], r["refers_to"]) for r in rows)
    assert got == {("1", "revisit", "<urn:page:2>"): 1, ("2", "response", None): 2, ("3", "response", None): 1, ("4", "response", None): 1, ("5", "response", None): 1, ("6", "response", None): 1, (None, "revisit", "<urn:page:2>"): 1}
    for r in rows:
        if r["warc_type"] == "response":
            assert r["payload_digest"] == "sha1:" + hashlib.sha1(r["payload"]).hexdigest() and int(r["payload_length"]) == len(r["payload"])
    some = spark.read.format("warc").load(path).where("warc_type = 'revisit' and page_id in ('1', '9')")
    assert [r["page_id"] for r in some.collect()] == ["1"]
    (tmp_path / "w" / "part-left-behind.warc.gz").write_bytes(warc.member(warc.record({"warc_type": "response", "page_id": "77"})))
    assert spark.read.format("warc").load(path).where("page_id = '77'").count() == 0  # no manifest lists it


def test_warc_records_name_their_pages(spark, tmp_path):
    warc.prepare(spark)
    path = f"file://{tmp_path}/w"
    warc.archive_pages(spark.createDataFrame([(1, "a", "http://h/ \r\nX: y"), (2, "b", None)], "page_id long, html string, url string"), path)
    assert {r["page_id"]: r["target_uri"] for r in spark.read.format("warc").load(path).collect()} == {"1": "http://h/X:y", "2": "urn:page:2"}


def test_warc_reads_plain_and_foreign_gzip(spark, tmp_path):
    import gzip

    warc.prepare(spark)
    rows = [{"warc_type": "response", "page_id": str(i), "payload": b"<p>" + b"y" * (i * 4000) + b"\r\n\r\nWARC/1.1 inside"} for i in range(4)] + [{"warc_type": "warcinfo", "payload": b"software: x"}]
    (tmp_path / "a.warc").write_bytes(b"".join(warc.record(r) for r in rows))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(r)) for r in rows))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(warc.member(warc.record(r)) for r in rows))
    out = spark.read.format("warc").load(f"file://{tmp_path}")
    got = collections.Counter((r["warc_type"], r["page_id"], bytes(r["payload"])) for r in out.collect())
    assert got == {(r["warc_type"], r.get("page_id"), r["payload"]): 3 for r in rows}
    heads = spark.read.format("warc").schema("page_id string").load(f"file://{tmp_path}")
    assert heads.columns == ["page_id"] and heads.count() == 15
    assert out.where("warc_type = 'warcinfo'").count() == 3
    assert spark.read.format("warc").load(f"file://{tmp_path}/none").count() == 0


def test_packing_query_ids_by_tokenizers(spark, sf):
    """Every piece's checksum against the ids of the public tokenizer, on a whole table."""
    from tokenizers import Tokenizer

    folder = sf.replace("0.001", "0.01")
    full = Tokenizer.from_file(packing.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pieces = collections.defaultdict(list)
    rows = packing.op1_packing(spark, folder).collect()
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = ids_of(text, full)
        assert sorted(pieces[i]) == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _ in sorted(pieces[i])] and sum(n for _, n, _ in pieces[i]) == len(ids)
    check_layout(rows)


def test_sharding_query_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op5_sharding(spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    total = sum(r["size"] for r in rows)
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= total / 8 / 64 + max(r["size"] for r in rows)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty table, and columns that are named like the operators' own."""
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, "a plain text of some words", "en", "s", 26), (1, "a plain text of some words", "en", "s", 26), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, long, "en", "s", 1), (5, long + " x", "en", "s", 1), (None, "mail me at a@b.org", "en", "s", 18)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).withColumn("_spans", F.lit("s")).withColumn("_new", F.lit("n")).withColumn("_toxicity", F.lit(2.0)).withColumn("score", F.lit("x")).withColumn("node", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        got = out.collect()
        assert len(got) == (6 if name == "near copies" else 8), name
        if name == "personal data":
            assert {r["text"] for r in got if r["doc_id"] is None} == {None, "mail me at [EMAIL]"} and {r["_spans"] for r in got} == {"s"}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_near_copy_stage_equals_brute_force(spark, sf):
    from test_text_operators import brute_components

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    root, _ = brute_components([t for _, t in rows], 5, 80)
    want = {rows[i][0] for i, r in enumerate(root) if r == i}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == want


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    once = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert once.columns == docs.columns
    kept = {r["doc_id"] for r in once.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(" ".join(texts[i].encode().lower().decode().split()), i)
    assert kept <= set(first.values())
    clean = {r["doc_id"] for r in corpus_pipeline.drop_benchmark(spark, docs, sf).collect()}
    assert not [i for i in clean if any(b in texts[i] for b in bench)] and len(clean) > 0.8 * len(texts)
    red = corpus_pipeline.redact(spark, docs, sf)
    assert red.columns == docs.columns and red.count() == len(texts)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert check_layout(rows) >= 1
    assert {r["doc_id"] for r in rows} <= kept & clean
