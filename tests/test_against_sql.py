"""Queries against their SQL on small tables that hold what the driver's small ones lack."""

import os

import duckdb
from pyspark.sql import functions as F

from folio_spark.operators import merge, programs
from folio_spark.plans import catalog, graph, intake, listings
from folio_spark.sources import catalogs
from folio_spark.streaming import timers


def same_as_sql(spark, folder, name, order=None):
    db = duckdb.connect()
    for f in os.listdir(folder):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}/*.parquet')")
    df = catalog.queries()[name](spark, str(folder))
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


PAGES = "page_id long, url string, html string"


def test_hooks_map_case_letter_by_letter(spark, tmp_path):
    links = "".join(f'<li><a href="/{t}">{t}</a></li>' for t in ("draußen", "x", "ﬁnŉ", "y", "großeé"))
    written(spark, tmp_path, pages=([(1, "http://h/1", f"<html><body><h1>Straße ﬁn ᾳ</h1><nav><ul>{links}</ul></nav></body></html>")], PAGES))
    assert sorted(r[2] for r in same_as_sql(spark, tmp_path, "f01_listing_hooks")) == ["1. DRAUẞEN", "2. ﬁNŉ", "3. GROẞEÉ"]
    assert [r[1] for r in same_as_sql(spark, tmp_path, "f01_content_hooks")] == ["[X STRAẞE ﬁN ᾼ]"]


def test_pages_of_one_url_are_books_of_their_own(spark, tmp_path):
    written(spark, tmp_path, pages=([(i, f"http://h{i % 3}.example.com/a", "") for i in range(12)], PAGES))
    assert {r[0]: r[2] for r in same_as_sql(spark, tmp_path, "j01_all_steps")}[2] == "host"


def test_alternates_of_a_name_that_one_origin_fills(spark, tmp_path):
    """Names that many targets share, most listings of one origin; the join gets 2 * limit listings of a name at most."""
    part = ([(k, "same name", "Brand", f"T{k}", 1, 1.0) for k in range(0, 400, 2)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    lines = ([(i, 2 * (i % 200), 0 if i < 900 else i % 13, 1) for i in range(1000)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    written(spark, tmp_path, part=part, lineitem=lines)
    assert len(same_as_sql(spark, tmp_path, "j08_alternates")) == 20 * 20
    assert {(r[1], r[2]) for r in same_as_sql(spark, tmp_path, "t05_bounded_alternates")} == {(5, True)}
    rows, wanted = listings.listings(spark, str(tmp_path)), listings.targets(spark, str(tmp_path))
    assert merge.kept_listings(rows, wanted, 20).count() == 40


def test_a_batch_of_short_texts_stays_a_batch(spark):
    texts = spark.range(500, numPartitions=1).select(F.concat(F.lit('{"bookUrl":"'), F.col("id").cast("string"), F.lit('","origin":"o"}')).alias("value"))
    seen = spark.sparkContext.accumulator(0)
    rows = catalogs.found_objects(texts.select(F.col("value").alias("t"), F.lit("h").alias("hash")))

    def count(batches):
        for b in batches:
            seen.add(1)
            yield b

    assert rows.mapInArrow(count, rows.schema).count() == 500
    assert seen.value < 5
    assert catalogs.recovered(texts).count() == 500


def test_archives_and_requests_are_spread(spark, tmp_path):
    written(spark, tmp_path, supplier=([(i,) for i in range(100)], "s_suppkey long"), customer=([(i,) for i in range(40)], "c_custkey long"), benchmark=([(1, "a b"), (2, "ö c")], "item_id long, text string"))
    assert graph.j14(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    assert same_as_sql(spark, tmp_path, "j14_frontier")
    assert same_as_sql(spark, tmp_path, "j04_ncx_titles")
    assert same_as_sql(spark, tmp_path, "j04_covers")
    assert "MapInArrow" not in intake.second_edition(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_a_key_with_its_first_rows_reads_no_state():
    class State:
        def __init__(self):
            self.rows, self.timers, self.reads = [], [], 0

        exists = lambda self: bool(self.rows)
        appendList = lambda self, new: self.rows.extend(new)
        listTimers = lambda self: iter(self.timers)
        registerTimer = lambda self, at: self.timers.append(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

        def get(self):
            self.reads += 1
            return iter(self.rows)

    state, saves = State(), timers.Coalescer(1_000_000)
    saves.handle = saves.waiting = state
    for at, due in ((5_000, 1005), (9_000, 1005), (2_000, 1002)):
        list(saves.handleInputRows(("k",), iter([{"_at": at, "_row": "r"}]), None))
        assert state.timers == [due]
    assert state.reads == 0 and len(state.rows) == 3


def test_a_page_that_many_sources_read_is_tokenised_once(spark, tmp_path, monkeypatch):
    page = lambda i: f'<html lang="l{i}"><body><nav><ul>' + "".join(f'<li><a href="/{t}">{t}</a></li>' for t in "abcdef") + "</ul></nav></body></html>"
    parts = ([(k, "n", "b", "t", 1, 1.0) for k in range(90)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    written(spark, tmp_path, pages=([(i, f"http://h{i}/x", page(i)) for i in range(24)], PAGES), part=parts)
    seen, real = spark.sparkContext.accumulator(0), programs.trees

    def counted(pages, *args):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return real(pages.mapInArrow(count, pages.schema), *args)

    monkeypatch.setattr(programs, "trees", counted)
    for name, rows in (("e20_rules_as_data", 24 * 8), ("e17_rules_as_data", None)):
        df = catalog.queries()[name](spark, str(tmp_path))
        assert "SortMergeJoin [_source" in df._jdf.queryExecution().toString()  # programs aren't broadcast by an estimate
        before = seen.value
        got = df.collect()
        assert seen.value - before == 24
        assert rows is None or len(got) == rows
        same_as_sql(spark, tmp_path, name)


def test_json_paths_of_programs_are_walked_by_steps_parsed_with_the_rule(spark):
    assert programs.parse_rule("$.o.r[1]['a b']")["keys"] == [{"name": "o", "item": None}, {"name": "r", "item": None}, {"name": None, "item": 1}, {"name": "a b", "item": None}]
    assert programs.parse_rule("$.u[*]")["keys"] is None
    body = '{"o":{"p":true,"r":[1,{"a b":"x"}]},"u":["/1","/2"],"5":"five","q":null,"n":"A"}'
    want = {"o.p": "true", "$.o.r[1]['a b']": "x", "u": "/1\n/2", "u[1]": "/2", "u[2]": None, "$.u[*]": "/1\n/2", "$.5": "five", "q": None, "n.z": None, "o[0]": None, "o.r[1]": '{"a b":"x"}', "n##A##Z": "Z"}
    names = tuple(f"f{i}" for i in range(len(want)))
    catalog = spark.createDataFrame([("s", "$.d", dict(zip(names, want)))], "source_url string, list string, fields map<string,string>")
    pages = spark.createDataFrame([(1, ["s", "none", "s"], "http://h/", f'{{"d":[{body},5]}}'), (2, [], "http://h/", body), (3, None, "http://h/", body)], "page_id int, source_url array<string>, url string, html string")
    rows = programs.search(pages, programs.compiled(catalog, "list", "fields", names), names, keep=("reader",)).collect()
    assert sorted((r["reader"], r["item_ix"]) for r in rows) == [(0, 0), (0, 1), (2, 0), (2, 1)]
    for r in rows:
        assert [r[n] for n in names] == (list(want.values()) if r["item_ix"] == 0 else [None] * len(want))
