"""License scan, conversation repair and whitening against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio_spark.llm import conversations, licenses, toxicity, whitening

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base_places(text):
    w = words_of(text)
    return sorted((i, p.label) for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.text.split())] == p.text.split())


def test_phrases_of_licenses_at_every_place(spark):
    r = random.Random(4)
    some = ["under", "the", "mit", "License", "APACHE", "version", "2", "cc", "by", "nc", "É", "K", "x"]
    texts = [None, "", "---", "CC BY-NC", "cc by nc cc by nc by nc", "under the MIT\x00License", "Éunder the mit license", "Kc by nc", "under the mit licenseé"]
    texts += [" ".join(r.choices(some, k=r.randrange(60))) for _ in range(200)]
    texts += ["under the mit license " * 5000, "word " * 30000 + "apache license, version 2"]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "cc-by-nc", "", 0), (3, texts[3], "", 0)], "doc_id long, text string, label string, row int").repartition(3)
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        text = "cc-by-nc" if x["doc_id"] is None else texts[x["doc_id"]]
        assert x["n_words"] == len(words_of(text))
        assert sorted((s["start"], s["label"]) for s in x["spans"] if s["phrase"]) == base_places(text)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_notices_with_small_changes(spark):
    notice = {t.label: t.text for t in licenses.NOTICES}
    changed = notice["bsd"].split()
    del changed[5]
    changed.insert(12, "also")
    cases = {
        "whole": ("some words " + notice["mit"].upper().replace(" ", ", ") + " more words", {"mit"}),
        "changed": (" ".join(changed), {"bsd"}),
        "lesser": ("x " + notice["lgpl-3"] + " y", {"lgpl-3"}),
        "affero, then plain": ("gnu affero general public license version 3. " * 2 + notice["gpl-3"], {"agpl-3", "gpl-3"}),
        "half": (" ".join(notice["isc"].split()[:10]), set()),
        "far apart": (" z z z z z z z z z z z z ".join(notice["unlicense"].split()), set()),
        "clean": ("the terms of the license are told by the software of this version", set()),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string")
    for x in licenses.scan(docs).collect():
        assert {s["label"] for s in x["spans"]} == cases[x["doc_id"]][1], x["doc_id"]
        assert all(0.85 <= s["score"] <= 1 for s in x["spans"])
    with pytest.raises(ValueError):
        licenses.scan(docs, (licenses.Template("a", "two words"),))


def brute_repair(rows):
    """rows: (role, text). Cost, audit and turns by trying every sequence of edits, insertions included."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(conversations.SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(i, cost, audit, turns, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            initials = "".join(r[:1] for r, _ in turns)
            if re.fullmatch("(s?(ua)+)?", initials) and all(r[:1] in tuple("sua") for r, _ in turns):
                best = min(best or (cost, audit, turns), (cost, audit, turns))
        else:
            role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", turns, inserted)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*turns, (role, text)], inserted)
                for new in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", [*turns, (new, text)], inserted)
        if inserted < 2:
            for new in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*turns, (new, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return faults, best


@pytest.mark.parametrize("size", [1, 2, 1024])
def test_cheapest_repairs(spark, monkeypatch, size):
    """With blocks of one row, of two and of more than a conversation has."""
    monkeypatch.setattr(conversations, "ROWS", size)
    r = random.Random(size)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["a.", "b!", "c", " ", "d?  \n", "e. f"]
    rows = [(c, t, r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"{c} {t}.", "clash") for c in range(60) for t in range(r.randrange(1, 6))]
    rows += [(None, None, "user", "q.", ""), (None, 3, "assistant", "a.", ""), (None, 3, None, None, ""), (60, 1, "user", "x.", ""), (60, 1, "user", "x.", ""), (60, None, "system", "s.", ""), (60, 9, "assistant", "y.", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, code string").repartition(4)
    plain = conversations.undamaged(df, "conv_id", "turn", "role", "text")
    got = {x["conv_id"]: x for x in conversations.repair_report(plain).collect()}
    left = {}
    for x in conversations.repair(df).collect():
        left.setdefault(x["conv_id"], {})[x["position"]] = (x["role"], x["text"])
    for conv, group in itertools.groupby(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or " ", x[3] or " ")), key=lambda x: x[0]):
        own = [(x[2] if x[2] is not None else " ", x[3] if x[3] is not None else " ", x[1]) for x in group]
        faults, (cost, audit, turns) = brute_repair([x[:2] for x in own])
        told = [x[2] for x in own if x[2] is not None]
        assert got[conv]["gaps"] == (max(told) - min(told) + 1 - len(set(told)) if told else 0)
        assert [got[conv][n] for n in ("blank", "duplicate", "truncated")] == [faults.count(n) for n in ("blank", "duplicate", "truncated")]
        assert got[conv]["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        assert (got[conv]["cost"], got[conv]["audit"]) == (cost, audit), own
        assert got[conv]["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
        assert [left.get(conv, {}).get(i) for i in range(len(left.get(conv, {})))] == turns
    assert len(got) == 62 and conversations.repair_report(plain.limit(0)).count() == 0


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", f"One. Two? {c}") for c in range(30) for t in range(5)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(x["conv"], x["turn"], x["text"], x["role"]): x["copies"] for x in conversations.damage(df, "conv_id", "turn", "role", "text").collect() if x["copies"]}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = text or " ", role or " "
        if kind:
            want = (c, t, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, "user" if kind == 4 else role)
            assert got.pop(want) == (2 if kind == 3 else 1)
    assert not got


def test_one_long_conversation_lies_in_many_blocks(spark):
    """40 thousand turns of one conversation, a third of them copies of one row."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("conv_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise(F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") % 3).cast("int"))).alias("role"), F.when(F.col("id") % 3 == 0, "same.").otherwise(F.concat(F.col("id").cast("string"), F.lit("."))).alias("text"))
    blocks = conversations.blocks_of(conversations.undamaged(rows.repartition(5), "conv_id", "turn", "role", "text"))
    assert blocks.count() >= 26 and blocks.agg(F.max(F.size("codes"))).first()[0] <= conversations.ROWS
    got = conversations.repair_report(conversations.undamaged(rows, "conv_id", "turn", "role", "text")).first()
    assert len(got["audit"]) == 40_000 and got["duplicate"] == 13_333 and got["audit"].count("D") >= 13_333
    left = conversations.repair(rows).orderBy("position").collect()
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in left).encode()).hexdigest()
    assert [x["role"] for x in left] == ["user", "assistant"] * (len(left) // 2)


def brute_components(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors])
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1], vectors[:, ::-1]


def test_whitened_rows_by_eigenvectors(spark):
    r = np.random.default_rng(2)
    good = (r.standard_normal((300, 12)) * np.linspace(0.1, 2, 12) + 3).astype(np.float32)
    rows = [(i, [float(c) for c in v], "clash") for i, v in enumerate(good)] + [(None, rows_ := [float(c) for c in good[5]], ""), (7, rows_, "")]
    kept = np.vstack([good, good[5], good[5]])
    odd = [(900, None, ""), (901, [], ""), (902, [1.0] * 11 + [None], ""), (903, [1.0] * 11 + [float("nan")], ""), (904, [float("inf")] * 12, ""), (905, [1.0, 2.0], ""), (906, [1e30] * 12, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n string").repartition(3)
    got = whitening.whiten(df).collect()
    x, centred, values, vectors = brute_components(kept)
    n = len(kept)
    assert len(got) == 8 * n and {g["n"] for g in got} == {n} and not {g["vec_id"] for g in got} & set(range(900, 907))
    deviation = {i: int(((n * v - x.sum(axis=0)) ** 2).sum()) for i, v in enumerate(x[:300])}
    sign = {}
    for g in got:
        c = g["component"] - 1
        assert abs(g["explained"] - values[c] / values.sum()) < 1e-10 and g["identity_error"] < 1e-9
        i = 5 if g["vec_id"] is None else g["vec_id"]
        if i == 7:
            continue
        assert g["deviation"] == deviation[i]
        want = centred[i] @ vectors[:, c] / np.sqrt(values[c])
        sign.setdefault(c, np.sign(want) * np.sign(g["whitened"]))
        assert abs(g["whitened"] - sign[c] * want) < 1e-8
    assert whitening.whiten(df.where("vec_id < 0")).count() == 0 and whitening.whiten(df.where("vec_id = 3")).count() == 0


def test_components_of_equal_and_of_no_deviation(spark):
    """Four directions of equal deviation, one larger, and three without any."""
    base = np.zeros((10, 8))
    for d in range(4):
        base[2 * d, d], base[2 * d + 1, d] = 1, -1
    base[8, 4], base[9, 4] = 3, -3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 * 5 and {g["component"] for g in got} == {1, 2, 3, 4, 5}
    z = np.zeros((10, 5))
    for g in got:
        z[g["vec_id"], g["component"] - 1] = g["whitened"]
        assert abs(g["explained"] - (18 / 26 if g["component"] == 1 else 2 / 26)) < 1e-9
    assert np.abs(z.T @ z / 10 - np.eye(5)).max() < 1e-9
    assert whitening.whiten(spark.createDataFrame([(i, [1.5, 2.5]) for i in range(4)], "vec_id long, embedding array<double>")).count() == 0


def test_bidiagonal_steps_give_all_singular_values():
    r = np.random.default_rng(5)
    for rows, d in ((50, 7), (4, 9), (40, 40)):
        a = r.standard_normal((rows, d)) @ np.diag(np.geomspace(1, 1e-6, d))
        lanczos = whitening.Bidiagonal(d, lambda p, earlier, a=a: (a.T @ (a @ p), (a @ earlier).T @ (a @ p), float((a @ p) @ (a @ p))))
        lanczos.run(d)
        v, s = lanczos.components()
        want = np.zeros(d)
        want[: min(rows, d)] = np.linalg.svd(a, compute_uv=False)
        assert np.abs(s - want).max() < 1e-12 * want[0] * d and np.abs(v.T @ v - np.eye(d)).max() < 1e-12


def brute_toxicity(model, text):
    """The highest window's mean over distinct words of the mean of their n-grams' shares, one n-gram at a time."""
    tokens = (text or "").lower().encode().split()
    best = None
    for lo in range(0, len(tokens), toxicity.WINDOW):
        window = tokens[lo : lo + toxicity.WINDOW]
        worth = {}
        for t in window:
            bare = b"<" + (t.strip(toxicity._STRIP) or t) + b">"
            shares = []
            for k in toxicity.GRAMS:
                for i in range(len(bare) - k + 1):
                    h = 0
                    for c in bare[i : i + k]:
                        h = (h * 0x100000001B3 + c + 1) & (1 << 64) - 1
                    x = h ^ (k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
                    shares.append(float(model.table[(x >> 40) % toxicity.BUCKETS]))
            worth[bare] = sum(shares) / len(shares)  # words that differ in signs around them alone are one
        mean = sum(worth.values()) / len(window)
        best = mean if best is None else max(best, mean)
    z = min(model.bias, -1e-9) if best is None else best + model.bias
    return 1 / (1 + math.exp(-z))


def test_toxicity_by_brute_force(spark):
    r = random.Random(9)
    model = toxicity.Model(np.random.default_rng(4).normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.4)
    some = ["you", "Fool!", "idiot", "id1ot", "the", "é", "x", "--", "word,", "word"]
    texts = [None, "", " ", "x", *(" ".join(r.choices(some, k=r.randrange(70))) for _ in range(120)), "you fool " * 4000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - brute_toxicity(model, t)) < 1e-6, t


def test_stages_that_drop_and_redact(spark, tmp_path):
    """The toxicity stage keeps what its model scores under one half; the redaction stage changes what the patterns find."""
    import corpus_pipeline

    r = random.Random(5)
    clean = ["the river runs along the old road", "a cup of tea and a loaf of bread", "they walked home in the rain"]
    rows = [(i, " ".join(r.sample(clean, 2)) + (" you filthy wretched scoundrel" if i % 3 == 0 else ""), "en", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, labels)
    kept = {x["doc_id"] for x in corpus_pipeline.drop_toxic(spark, docs, f"file://{tmp_path}").collect()}
    assert kept == {i for i, t, *_ in rows if brute_toxicity(model, t) < 0.5} and kept == {i for i in range(300) if i % 3}
    some = spark.createDataFrame([(1, "a@b.co and 10.0.0.1", "en", 9), (2, "none", "en", 4), (3, None, "en", None), (4, "c@d.eu" * 2, "en", 0)], "doc_id long, text string, lang string, n_chars long")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.redact(spark, some, "").collect()}
    assert got == {1: ("[EMAIL] and [IP]", 16), 2: ("none", 4), 3: (None, None), 4: ("[EMAIL]@d.eu", 12)}
