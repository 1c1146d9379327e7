"""Rows of the corpus operators that a cut by ids or repeated keys would lose."""

from folio_spark.llm import decontaminate, jaccard

DOCS = "doc_id long, text string, lang string"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"]) for r in df.collect()), key=repr)


def test_clean_rows_stay_under_a_leaking_id(spark):
    leak = " ".join(f"v{i}" for i in range(20))
    docs = [(None, leak, "a"), (None, "clean one", "b"), (None, None, "c"), (7, f"x {leak} y", "d"), (7, "clean two", "e"), (8, "clean two", "f")]
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert rows_of(decontaminate.clean(spark.createDataFrame(docs, DOCS), bench)) == sorted((docs[i] for i in (1, 2, 4, 5)), key=repr)


def test_near_copies_by_row_not_by_id(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(100)) for c in "abcd")
    docs = [
        (None, one, "1"), (None, one + " z", "2"), (None, two, "3"), (None, None, "4"), (None, "", "5"), (None, "", "5"),  # a component of null ids only, other null ids
        (3, two + " z", "6"), (3, three, "7"), (3, "alone", "8"),  # an id in three components
        (1, three + " z", "9"), (3, four, "same"), (3, four, "same"),
    ]
    kept = rows_of(jaccard.keep_one_each(spark.createDataFrame(docs, DOCS).repartition(3)))
    assert [r for r in kept if r[1] in (one, one + " z")] in ([docs[0]], [docs[1]])
    assert [r for r in kept if r[1] not in (one, one + " z")] == sorted((docs[i] for i in (3, 4, 5, 6, 8, 9, 10)), key=repr)


def test_sets_are_built_once_for_repeated_rows(spark, monkeypatch):
    written, write = [], jaccard.materialize

    def spy(df, tag):
        out = write(df, tag)
        if tag == "members":
            written.append([r["node"] for r in out.select("node").collect()])
        return out

    monkeypatch.setattr(jaccard, "materialize", spy)
    base = " ".join(f"a{i}" for i in range(100))
    docs = spark.createDataFrame([(None, base, "")] * 6 + [(None, base + " z", "")] * 4 + [(None, "other text", "")], DOCS).repartition(3)
    assert jaccard.join_components(docs).count() == 11
    assert [len(x) for x in written] == [len(set(x)) for x in written] and len(written[0]) == 2


def test_items_of_five_words_with_one_edit():
    index = decontaminate.Index([(1, "a b c d e")], 80)
    for text in ("x a b y d e z", "a b d e", "a b c y d e", "y b c d e", "a b c d"):
        assert [(m[0], m[3]) for m in index.matches(decontaminate.symbols(text))] == [(1, 1)], text
    assert not index.matches(decontaminate.symbols("a b x y e")) and not index.matches(decontaminate.symbols("a"))


def test_near_copies_of_one_text_and_a_passage_in_all(spark):
    """5000 near copies of one text, and 400 texts that share a passage: pairs stay few and every link is found."""
    base = [f"w{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(40))
    near = [" ".join([*base, f"x{i}"]) for i in range(5000)]
    others = [f"{passage} " + " ".join(f"o{i}_{j}" for j in range(20)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(near + others)], DOCS).repartition(4)
    found, led, scanned = {}, jaccard.led_pairs, jaccard.scan_lists

    def count(name, call):
        def run(*args):
            out = call(*args)
            found[name] = found.get(name, 0) + out.count()
            return out

        return run

    jaccard.led_pairs, jaccard.scan_lists = count("led", led), count("scanned", scanned)
    try:
        rows = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(docs).collect()}
    finally:
        jaccard.led_pairs, jaccard.scan_lists = led, scanned
    assert {rows[i] for i in range(5000)} == {0} and all(rows[i] == i for i in range(5000, 5400))
    assert found["led"] <= jaccard.TURNS * 5400 and found["scanned"] <= 5400


def test_lists_laid_out_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 300)
    monkeypatch.setattr(jaccard, "TURNS", 0)
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join([*base, f"x{i}"]) for i in range(60)] + ["other " + " ".join(base[::-1])]
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], DOCS)).collect()}
    assert {rows[i] for i in range(60)} == {0} and rows[60] == 60
