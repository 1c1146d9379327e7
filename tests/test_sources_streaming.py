"""Catalog import, text files, feeds, knowledge merges and the streaming forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folio_spark import streaming
from folio_spark.operators import knowledge as K
from folio_spark.sources import catalogs, stores


def test_catalog_import(spark, tmp_path):
    sources = [{"bookSourceUrl": "u1", "customOrder": "7", "ruleSearch": {"a": "x"}}, {"bookSourceUrl": "u2", "serialNumber": 3, "ruleSearch": '{"a":"y"}'}, {"bookSourceUrl": "u3", "ruleSearch": "null"}]
    for i, doc in enumerate((sources, {"data": sources}, {"bookSourceList": sources})):
        (tmp_path / f"c{i}.json").write_text(json.dumps(doc))
        rows = catalogs.read_catalog(spark, f"file://{tmp_path}/c{i}.json")
        got = rows.select("pos", catalogs.field("source", "bookSourceUrl").alias("url"), catalogs.int_or_text("source", "customOrder").alias("ord"), catalogs.with_legacy("source", "customOrder").alias("either"), F.get_json_object(catalogs.rule_object("source", "ruleSearch"), "$.a").alias("a")).orderBy("pos").collect()
        assert [tuple(r) for r in got] == [(0, "u1", 7, "7", "x"), (1, "u2", None, "3", "y"), (2, "u3", None, None, None)]


def test_text_files(spark, tmp_path):
    (tmp_path / "My book.txt").write_bytes(b"\xef\xbb\xbf" + "第一章\nx".encode())
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    rows = catalogs.read_texts(spark, f"file://{tmp_path}", most=50).collect()
    assert [(r["title"].replace("%20", " "), r["text"], r["n_chars"]) for r in rows] == [("My book", "第一章\nx", 5)]


def test_decode_body(spark):
    df = spark.createDataFrame([(1, bytearray("é".encode("latin1")), "latin1"), (2, bytearray('<meta charset="iso-8859-1">é'.encode("latin1")), None), (3, bytearray("é".encode()), None)], "i int, body binary, cs string")
    got = {r["i"]: r["t"] for r in df.select("i", catalogs.decode_body(F.col("body"), F.col("cs")).alias("t")).collect()}
    assert got == {1: "é", 2: '<meta charset="iso-8859-1">é', 3: "é"}


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link> http://a </link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><title>B</title><link>b</link></item></channel></rss>")
    rows = {r["title"]: (r["link"], r["ord"]) for r in catalogs.read_feed(spark, f"file://{tmp_path}/f.xml", "o").collect()}
    assert rows == {"A": ("http://a", 1704164645), "B": ("b", None)}


def test_append_toc(spark):
    old = spark.createDataFrame([("t", 0, "a"), ("t", 1, "b")], "toc_url string, idx int, title string")
    new = spark.createDataFrame([("t", 0, "c"), ("s", 5, "d")], "toc_url string, idx int, title string")
    assert {tuple(r) for r in stores.append_toc(old, new).collect()} == {("t", 0, "a"), ("t", 1, "b"), ("t", 2, "c"), ("s", 0, "d")}


def test_knowledge_merges(spark):
    places = spark.createDataFrame([(1, 1, "A", "city", "", "", "c1", "d"), (1, 2, "a", "", "B", "gone", "c2", "longer")], "book int, ord int, name string, kind string, parent_name string, status string, first_seen string, description string")
    r = K.merge_places(places).first()
    assert (r["name"], r["kind"], r["parent_name"], r["status"], r["first_seen"], r["description"]) == ("A", "city", "B", "gone", "c1", "longer")
    notes = spark.createDataFrame([(1, 1, "w", "T", "x"), (1, 2, "w", "t", "xyz")], "book int, ord int, category string, title string, content string")
    assert [(n["title"], n["content"]) for n in K.merge_notes(notes).collect()] == [("T", "xyz")]
    tree = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "x", "y"), (1, "y", "x"), (1, "z", "none")], "book int, name string, parent_name string")
    got = {r["name"]: (r["depth"], r["path"], r["has_children"]) for r in K.place_rows(tree).collect()}
    assert got == {"a": (0, "a", True), "b": (1, "a/b", True), "c": (2, "a/b/c", False), "x": (0, "x", True), "y": (0, "y", True), "z": (0, "z", False)}


def run(stream, sink, mode, **options):
    q = stream.writeStream.format("memory").queryName(sink).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"file://{tmp_path}/e")
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/e")

    run(streaming.first_seen_stream(source(), ["user_id", "event_type"], delay="60 days"), "first", "append")
    assert spark.table("first").count() == events.select("user_id", "event_type").distinct().count()

    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "cached").otherwise("success")
    run(streaming.caching_counters(source().withColumn("o", outcome), "user_id", "o"), "counts", "complete")
    want = {tuple(r) for r in streaming.caching_counters(events.withColumn("o", outcome), "user_id", "o").collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want

    store = stores.ContentStore(spark, f"file://{tmp_path}/s", keys=("user_id",))
    write = streaming.latest_into(store, ["user_id"], "ts")
    for _ in range(2):  # a second pass over the same batches changes nothing
        q = source().select("user_id", "ts", "event_id").writeStream.foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = {tuple(r) for r in events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id").collect()}
    assert {tuple(r) for r in store.read().select("user_id", "event_id").collect()} == last


def test_place_parents_and_signature(spark):
    rows = [
        (1, "Ava", "城市", None, "a city of Oria", None), (1, "Oria", "王国", None, "", None), (1, "Inn", "酒馆", "Ava", "", None), (1, "Mill", "建筑", "Inn", "", None), (1, "Hall", "大学", None, "stands in Oria", None), (1, "Room", "房间", None, "", None),
        (1, "Gone", "房间", None, "", "路人"), (2, "X", "住宅", None, "", None), (2, "Y", "城", None, "X lies here", None), (3, "P", "住宅", "nix", "", None), (3, "Q", "王国", None, "", None), (3, "R", "王国", None, "", None),
    ]
    places = spark.createDataFrame(rows, "book int, name string, kind string, parent_name string, description string, importance string")
    got = {(r["book"], r["name"]): r["parent"] for r in K.infer_parents(places).collect()}
    assert got == {(1, "Ava"): "Oria", (1, "Oria"): None, (1, "Inn"): "Ava", (1, "Mill"): "Ava", (1, "Hall"): "Oria", (1, "Room"): "Ava", (2, "X"): "Y", (2, "Y"): None, (3, "P"): "nix", (3, "Q"): None, (3, "R"): None}
    a, b = (K.place_signature(p).orderBy("book").collect() for p in (places, places.repartition(3)))
    assert a == b and a != K.place_signature(places.where("name <> 'Inn'")).orderBy("book").collect()


def test_deep_places_and_cycles(spark):
    chain = [(1, f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    rows = {r["name"]: r for r in K.place_rows(spark.createDataFrame([*chain, (2, "a", "b"), (2, "b", "c"), (2, "c", "a"), *((2, f"z{i}", f"z{i - 1}" if i else "a") for i in range(9))], "book int, name string, parent_name string")).collect()}
    assert all(rows[f"n{i}"]["depth"] == i for i in range(40)) and rows["n39"]["path"].count("/") == 39
    assert all(rows[n]["depth"] == 0 for n in ("a", "b", "c", *(f"z{i}" for i in range(9)))) and len(rows) == 52


def test_content_store(spark, tmp_path):
    store = stores.ContentStore(spark, f"file://{tmp_path}/c", keys=("k",), parts=4)
    assert store.read() is None and store.exists(spark.createDataFrame([(1,)], "k int")).count() == 0
    store.put(spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string"))
    before = dict(store._current())
    store.put(spark.createDataFrame([(3, "b"), (3, "b"), (50, "c")], "k int, v string"))
    assert len([p for p, v in store._current().items() if v != before.get(p)]) <= 2
    assert {r["k"]: r["v"] for r in store.read().collect()} == {**{i: "a" for i in range(20)}, 3: "b", 50: "c"}
    store.remove(spark.createDataFrame([(i,) for i in range(20)], "k int"))
    assert [tuple(r) for r in store.read().select("k", "v").collect()] == [(50, "c")]
    (tmp_path / "c" / "log" / f"{store.log.state()[0] + 1:020d}.entry").write_text("not an entry")
    with pytest.raises(ValueError):  # an unreadable entry isn't an empty store
        store.put(spark.createDataFrame([(1, "x")], "k int, v string"))


def test_toc_store(spark, tmp_path):
    store = stores.TocStore(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "toc_url string, idx int, title string")
    store.save(rows(("t", 0, "a"), ("t", 1, "b"), ("u", 0, "x")))
    store.append(rows(("t", 0, "c"), ("v", 0, "y")))
    store.save(rows(("u", 0, "z")))
    assert {(r["toc_url"], r["idx"], r["title"]) for r in store.load().collect()} == {("t", 0, "a"), ("t", 1, "b"), ("t", 2, "c"), ("u", 0, "z"), ("v", 0, "y")}
    store.delete(rows(("t", 0, "")))
    assert {r["toc_url"] for r in store.load().collect()} == {"u", "v"}


def test_summaries(spark):
    from folio_spark.functions import text as X

    rows = spark.createDataFrame([("old", "第3章 recap：x"), ("old", " "), ("old", "new"), ("old", "x" * 2000)], "p string, n string").select(X.next_summary(F.col("p"), F.col("n")).alias("s")).collect()
    assert [r["s"] for r in rows[:3]] == ["old", "old", "new"] and len(rows[3]["s"]) == 1200


def recovered_urls(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string").repartition(2)
    return sorted((r["bookUrl"], r["origin"]) for r in catalogs.recovered(rows, order=("n",)).collect())


def test_damaged_shelves(spark):
    deep = '{"bookUrl":"deep","origin":"w","x":' + '{"y":' * 10 + "1" + "}" * 11
    big = json.dumps({"bookUrl": "big", "origin": "w", "intro": "é \\ { \" } " * 90_000})
    assert recovered_urls(spark, '{"bookUrl":"a","origin":"w","intro":"say } ok"}') == [("a", "w")]
    assert recovered_urls(spark, f"[{deep},{big}]") == [("big", "w"), ("deep", "w")]
    cut = '[{"bookUrl":"a","origin":"w"},{"bookUrl":"b","origin":"w","intro":"never {ends'
    assert recovered_urls(spark, cut, None, "", '{"bookUrl":}', "}}}", "{" * 200_000, '"' * 100_001 + "{}") == [("a", "w")]
    assert recovered_urls(spark, '{"bookUrl":"/cut{"bookUrl":"b","origin":"v"}garbage"{"bookUrl":"c","origin":"v"}') == [("b", "v"), ("c", "v")]
    assert recovered_urls(spark, '{"x":"open\n{"bookUrl":"d","origin":"v","y":{"z":1}}') == [("d", "v")]
    rows = spark.createDataFrame([(2, '{"bookUrl":"a","origin":"w","v":2}'), (1, '{"bookUrl":"a","origin":"w","v":1}')], "n int, value string")
    assert json.loads(catalogs.recovered(rows, order=("n",)).first()["item"])["v"] == 1


def test_long_fields_take_no_stack(spark):
    """A megabyte in the place of a header, a category's URL and a list of empty lines."""
    from folio_spark.operators import extract

    long = "x/y\\" * 250_000
    header = "{" + '"a":{"b":{"c":{"d":"' + "v" * 1_000_000 + '"}}}}'
    texts = {"header": f"/s@Header: {header}|charset=gbk", "open": "/s@Header:{" + "x" * 1_000_000, "kinds": f'[<"title":"t","url":"{long.replace(chr(92), "")}">]', "lines": "a::b" + "\n" * 1_000_000 + "c"}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r["k"]: r for r in df.select("k", catalogs.legacy_url_rule(F.col("t")).alias("rule"), extract.explore_kinds(F.col("t")).alias("kinds")).collect()}
    assert got["header"]["rule"] == f'/s,{{"charset":"gbk","headers":{header}}}'
    assert got["open"]["rule"].startswith("/s@Header:{xxx")
    assert [(k["title"], len(k["url"])) for k in got["kinds"]["kinds"]] == [("t", 750_000)]
    assert [(k["title"], k["url"]) for k in got["lines"]["kinds"]] == [("a", "b"), ("c", None)]


def test_timers_go_on_from_a_checkpoint(spark, tmp_path):
    """Saves in three files that arrive out of order; the stream stops after each and starts again."""
    from folio_spark.streaming import timers

    timers.with_timers(spark)
    r = random.Random(3)
    rows = [(k, i, at) for k in ("a", None, "b") for i, at in enumerate(sorted(r.sample(range(3000), 40)))]
    schema = "k string, n int, s int"
    parts = [[x for x in rows if x[2] < 1200], [x for x in rows if 1200 <= x[2] < 2000], [x for x in rows if x[2] >= 2000] + [("end", 0, 100_000)]]
    for i, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("k string, n int, ts timestamp").parquet(f"file://{tmp_path}/in")
        out = timers.coalesced_by_timer(stream, ["k"], seconds=300, delay="0 seconds")
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want = []
    for k in ("a", None, "b"):
        mine = sorted((at, n) for kk, n, at in rows if kk == k)
        while mine:
            saved = [x for x in mine if x[0] < mine[0][0] + 300]
            want.append((k, saved[0][0], saved[-1][1]))
            mine = mine[len(saved) :]
    got = [(x["k"], x["since"], x["n"]) for x in spark.read.parquet(f"file://{tmp_path}/out").select("k", F.unix_seconds("since").alias("since"), "n").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_two_writers_lose_nothing(spark, tmp_path):
    """Two threads put rows of the same folders, each a store of its own; every row is there, and a read opens one snapshot."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/a b"

    def writer(name):
        store = stores.ContentStore(spark, path, keys=("k",), parts=2)
        store.log.compact = 4
        for i in range(5):
            store.put(spark.createDataFrame([(f"{name}{i}{j}", i) for j in range(3)], "k string, v int"))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(writer, "xy"))
    store = stores.ContentStore(spark, path, keys=("k",), parts=2)
    assert sorted((r["k"], r["v"]) for r in store.read().collect()) == sorted((f"{n}{i}{j}", i) for n in "xy" for i in range(5) for j in range(3))
    n, held = store.log.state()
    assert n == 10 and len(held) == 2 and store.log._read("_latest") == "8"
    assert not store.log.commit(n - 1, {"0": None}) and store.log.state() == (n, held)
    store.remove(spark.createDataFrame([("x00",)], "k string"))
    assert store.read().count() == 29


def test_a_commit_is_put_on_top_of_others(spark, tmp_path):
    log = stores.CommitLog(spark, f"file://{tmp_path}/log", compact=3)
    assert log.state() == (0, {})
    for i in range(7):
        assert log.commit(i, {"a": str(i), f"k{i}": None if i == 2 else "v"})
    assert not log.commit(3, {"a": "lost"})
    assert log.state() == (7, {"a": "6"} | {f"k{i}": None if i == 2 else "v" for i in range(7)})
    (tmp_path / "log" / "_latest").write_text("")  # as a reader may find it
    assert log.state()[0] == 7 and log.since(5)[-1][0] == 7 and log.since(7) == [(7, {})]
