"""Knowledge tables of books: characters, relations, places and notes merged by key; graph and tree views.

Rows carry `ord`; later rows win where they say something, so an increment is previous rows, then new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio_spark.functions.text import importance_rank, knowledge_key, let
from folio_spark.sources.stores import checkpointed


def said(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def last_said(c: str) -> Column:
    """The latest non-empty value."""
    return F.max_by(F.when(said(c).isNotNull(), F.col(c)), F.when(said(c).isNotNull(), F.col("ord"))).alias(c)


def first_said(c: str) -> Column:
    return F.min_by(F.when(said(c).isNotNull(), F.col(c)), F.when(said(c).isNotNull(), F.col("ord"))).alias(c)


def all_of(c: str) -> Column:
    """The union of arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)


#: Words of low importance, categories and words of recaps, settings, and relations that say little.
LOW = "low|低|低重要性|不重要|路人|背景|minor|background|oneoff|一次性"
RECAP_TITLE = "(本章|章节|剧情|简介|概要|经过|第\\d+章|第[一二三四五六七八九十百千万]+章)"
RECAP_CATEGORIES = "当前事件|章节摘要|剧情进展|本章剧情"
RECAP_START = "^(本章|本节|这一章|此章|第.+章)"
PLOT_VERBS = ("搜查", "担心", "登上", "指出", "加入", "透露", "引出", "随后")
SETTINGS = "基础规则|基础设定|势力制度|历史传说|技术魔法|社会文化|地理环境|组织体系|未确认信息"
CHAPTER = "第\\s*(?:\\d+|[零〇一二两三四五六七八九十百千万]+)\\s*[章节回话卷篇]"
CHAPTER_WORDS = "本章|这一章|当前章节|章节内容"
NARRATIVE = ("随后", "然后", "接着", "回到", "看到", "告诉", "解释", "拒绝", "催促", "等待", "躺在", "坐在", "担心", "考虑", "讲述", "寻找", "清晨", "下午", "晚上", "第二天")
LITTLE = ("认识", "见过", "路过", "同村", "同校", "位于", "相关")
CATEGORIES = ("基础设定", "基础规则", "势力制度", "历史传说", "技术/魔法", "社会文化", "当前事件", "未确认信息")
NO_CATEGORY, LINKED, LIES_IN = "基础设定", "关联", "位于"


def is_low(importance: Column) -> Column:
    return knowledge_key(importance).rlike(LOW)


def hits(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def is_recap(title: Column, content: Column, category: Column) -> Column:
    """Whether a note retells a chapter: by its title, category or beginning, or by the words of its text."""
    body, key = F.trim(content), knowledge_key(content)
    both = F.concat(title, F.lit(" "), body)
    narrative = hits(knowledge_key(both), NARRATIVE)
    refers = both.rlike(CHAPTER) | knowledge_key(both).rlike(CHAPTER_WORDS)
    sentences = F.size(F.filter(F.split(body, "[。！？；]"), lambda x: F.trim(x) != ""))
    retells = (refers & (F.length(body) > 60) & (narrative >= 2)) | ((F.length(body) > 140) & (sentences >= 4) & (narrative >= 4))
    plot = (F.length(content) > 80) & (hits(key, PLOT_VERBS) >= 3) & ~knowledge_key(category).rlike(SETTINGS)
    return title.rlike(RECAP_TITLE) | knowledge_key(category).rlike(RECAP_CATEGORIES) | body.rlike(RECAP_START) | retells | plot


def says_little(relation: Column, detail: Column, importance: Column) -> Column:
    """A relation of a vague kind with a short detail, unless it is marked as important."""
    return ~knowledge_key(importance).rlike("high|medium|高|中") & knowledge_key(relation).isin(*LITTLE) & (F.length(knowledge_key(detail)) < 18)


def _given(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with the columns that a table of this kind may lack."""
    for c in columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.array().cast("array<string>") if c in ("aliases", "characters") else F.lit(None).cast("string"))
    return rows


def in_order(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows, then new ones: what an increment is merged from."""
    marked = previous.withColumn("ord", F.struct(F.lit(0).alias("turn"), F.col("ord").cast("long").alias("at")))
    return marked.unionByName(new.withColumn("ord", F.struct(F.lit(1).alias("turn"), F.col("ord").cast("long").alias("at"))), allowMissingColumns=True)


def _minus_ord() -> Column:
    """Puts the earliest row first where a maximum is sought."""
    return F.struct(*(-F.col(f"ord.{c}") for c in ("turn", "at")))


def _earliest(rows: DataFrame) -> Column:
    return _minus_ord() if isinstance(rows.schema["ord"].dataType, T.StructType) else -F.col("ord")


def _merges(rows: DataFrame, shown: bool):
    """The aggregates of one table. shown: as a reader sees them, where the first row's word stands and texts grow."""
    early = _earliest(rows)
    rich = lambda c: F.max_by(F.col(c), F.struct(F.length(F.coalesce(c, F.lit(""))), early)).alias(c)
    weight = lambda c: F.max_by(said(c), F.when(said(c).isNotNull(), F.struct(importance_rank(F.col(c)), early))).alias(c)
    return (first_said if shown else last_said), (rich if shown else last_said), rich, weight


def merge_characters(rows: DataFrame, shown: bool = False) -> DataFrame:
    """One row for each book and name key: all aliases; the latest (shown: first, for a status the longest) words."""
    rows = _given(rows, "aliases", "status", "description", "importance", "faction", "location", "last_seen")
    keyed = rows.withColumn("key", knowledge_key(F.col("name"))).where("key <> ''")
    keyed = keyed.where(~is_low(F.col("importance"))) if shown else keyed
    word, status, rich, weight = _merges(keyed, shown)
    return keyed.groupBy("book", "key").agg(F.min_by("name", "ord").alias("name"), all_of("aliases"), status("status"), rich("description"), weight("importance"), word("faction"), word("location"), word("last_seen"))


def merge_relations(rows: DataFrame, shown: bool = False) -> DataFrame:
    """Undirected: the two ends in order and the relation are the key; loops go, and of those shown what says little."""
    rows = _given(rows, "status", "description", "importance")
    a, b = knowledge_key(F.col("source")), knowledge_key(F.col("target"))
    keyed = rows.where((a != b) & (a != "") & (b != "")).withColumn("x", F.least(a, b)).withColumn("y", F.greatest(a, b))
    if shown:
        keyed = keyed.where((F.coalesce("relation", F.lit("")) != "") & ~is_low(F.col("importance")) & ~says_little(F.col("relation"), F.coalesce(F.nullif("description", F.lit("")), "status"), F.col("importance")))
    _, status, rich, weight = _merges(keyed, shown)
    return keyed.groupBy("book", "x", "y", "relation").agg(F.min_by("source", "ord").alias("source"), F.min_by("target", "ord").alias("target"), status("status"), rich("description"), weight("importance"))


def merge_places(rows: DataFrame, shown: bool = False) -> DataFrame:
    """One row for each book and name key: where first seen, all characters; the latest (shown: first) kind and parent."""
    rows = _given(rows, "kind", "parent_name", "status", "description", "importance", "first_seen", "characters")
    keyed = rows.withColumn("key", knowledge_key(F.col("name"))).where("key <> ''")
    keyed = keyed.withColumn("parent_name", F.when(knowledge_key(F.col("parent_name")) != F.col("key"), F.col("parent_name")))
    keyed = keyed.where(~is_low(F.col("importance"))) if shown else keyed
    word, status, rich, weight = _merges(keyed, shown)
    return keyed.groupBy("book", "key").agg(F.min_by("name", "ord").alias("name"), word("kind"), word("parent_name"), status("status"), first_said("first_seen"), rich("description"), all_of("characters"), weight("importance"))


def merge_notes(rows: DataFrame) -> DataFrame:
    """One row for each book, category and title key, with the longest content. Notes of low importance, without title or
    content, or that retell a chapter go."""
    rows = _given(rows, "confidence", "importance").withColumn("category", F.coalesce(said("category"), F.lit(NO_CATEGORY)))
    kept = rows.where(~is_low(F.col("importance")) & said("title").isNotNull() & said("content").isNotNull() & ~is_recap(F.col("title"), F.col("content"), F.col("category")))
    _, _, rich, weight = _merges(kept, False)
    key = F.concat_ws("::", knowledge_key(F.col("category")), knowledge_key(F.col("title")))
    return kept.groupBy("book", key.alias("key")).agg(F.min_by("category", "ord").alias("category"), F.min_by("title", "ord").alias("title"), rich("content"), first_said("confidence"), weight("importance"))


def group_notes(notes: DataFrame) -> DataFrame:
    """book, category, place and title of the notes shown: categories in their fixed order, then others by name; of equal
    titles in a category the first; notes of low importance go."""
    rows = _given(notes, "importance").where(~is_low(F.col("importance"))).withColumn("category", F.coalesce(said("category"), F.lit(NO_CATEGORY)))
    first = rows.groupBy("book", "category", knowledge_key(F.col("title")).alias("key")).agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))
    at = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    fixed = F.when(at > 0, at).otherwise(len(CATEGORIES) + 1)
    order = W.partitionBy("book").orderBy("fixed", "category", "ord", "key")
    return first.withColumn("fixed", fixed).withColumn("place", F.row_number().over(order)).select("book", "category", "place", "title")


def relationship_graph(characters: DataFrame, relations: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (book, id, kind, detail) and links (book, source, target, label) of books: what is named first makes a node;
    characters lie in their places; loops and repeated links go. All three tables carry ord."""
    none = F.lit(None).cast("string")
    people = F.explode(F.coalesce("characters", F.array().cast("array<string>"))).alias("who")
    lies = _given(places, "characters").select("book", "ord", "name", people)
    label = F.coalesce(said("relation"), said("status"), F.lit(LINKED))
    named = [
        (0, characters.select("book", "ord", F.col("name").alias("id"), F.lit("character").alias("kind"), F.coalesce(said("status"), said("description")).alias("detail"))),
        (1, relations.select("book", "ord", F.explode(F.array("source", "target")).alias("id"), F.lit("character").alias("kind"), none.alias("detail"))),
        (2, places.select("book", "ord", F.col("name").alias("id"), F.lit("location").alias("kind"), said("description").alias("detail"))),
        (3, lies.select("book", "ord", F.col("who").alias("id"), F.lit("character").alias("kind"), none.alias("detail"))),
    ]
    rows = None
    for turn, part in named:  # places and those who lie in them are named in one turn
        part = part.select("book", "id", F.struct(F.lit(min(turn, 2)).alias("turn"), F.col("ord").cast("long").alias("ord"), F.lit(turn).alias("part")).alias("o"), "kind", "detail")
        rows = part if rows is None else rows.unionByName(part)
    nodes = rows.where("id <> ''").groupBy("book", "id").agg(F.min(F.struct("o", "kind", "detail")).alias("n")).select("book", "id", "n.kind", "n.detail")
    links = relations.select("book", "source", "target", label.alias("label")).unionByName(lies.select("book", F.col("who").alias("source"), F.col("name").alias("target"), F.lit(LIES_IN).alias("label")))
    return nodes, links.where("source <> '' and target <> '' and source <> target").distinct()


def nodes_in_order(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with their degree and place: most links first, then by name."""
    ends = links.select("book", F.explode(F.array("source", "target")).alias("id")).groupBy("book", "id").agg(F.count("*").alias("degree"))
    out = nodes.join(ends, ["book", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.withColumn("place", F.row_number().over(W.partitionBy("book").orderBy(F.desc("degree"), "id")))


def matches_search(query: str, *columns: str) -> Column:
    """Whether the columns (texts or arrays of texts), read as one text without white space, hold the query; an empty one finds all."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.contains(flat(F.concat_ws(" ", *columns)), flat(F.lit(query)))


def graph_links(relations: DataFrame) -> DataFrame:
    """Distinct links of a book without loops."""
    return relations.select("book", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select("book", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("book", "node").agg(F.count("*").alias("degree"))


def neighbourhood(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen: book, node. The nodes that a link joins to it."""
    both = links.select("book", F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("book", F.col("b"), F.col("a")))
    return both.join(chosen, ["book", "node"]).select("book", "node", "other").distinct()


def place_rows(places: DataFrame) -> DataFrame:
    """book, name, depth, path and has_children in tree order: parents before children. A place whose parents form a
    cycle hangs below none.

    Each round doubles the part of the path that is known, and is written, so a tree of any depth takes the logarithm
    of its depth in rounds.
    """
    kin = places.select("book", "name", F.when(F.col("parent_name") != F.col("name"), F.col("parent_name")).alias("up"))
    known = kin.select("book", F.col("name").alias("up")).distinct().withColumn("_is", F.lit(True))
    # path: the ancestors known so far and the place itself; up: the one above those, null at the top; loop: below a cycle.
    no_path = F.array().cast("array<string>")
    start = kin.join(known, ["book", "up"], "left").select("book", "name", F.array("name").alias("path"), F.when(F.col("_is"), F.col("up")).alias("up"), F.lit(False).alias("loop"))
    now = checkpointed(start)
    while not now.where("up is not null").isEmpty():
        above = now.select("book", F.col("name").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"), F.col("loop").alias("_loop"))
        loop = F.col("loop") | F.coalesce(F.col("_loop") | F.arrays_overlap("path", "_path"), F.lit(False))
        longer = now.join(above, ["book", "up"], "left").select("book", "name", F.when(loop, F.array("name")).otherwise(F.concat(F.coalesce("_path", no_path), "path")).alias("path"), F.when(~loop, F.col("_up")).alias("up"), loop.alias("loop"))
        now = checkpointed(longer)
    parent_of = places.select("book", F.col("parent_name").alias("name")).where("name is not null").distinct().withColumn("has_children", F.lit(True))
    out = now.join(parent_of, ["book", "name"], "left")
    return out.select("book", "name", (F.size("path") - 1).alias("depth"), F.array_join("path", "/").alias("path"), F.coalesce("has_children", F.lit(False)).alias("has_children"))


def place_signature(places: DataFrame) -> DataFrame:
    """One text for each book that changes when its set of places does."""
    one = F.concat_ws(":", *(knowledge_key(F.col(c)) for c in ("name", "parent_name", "kind", "status", "description")))
    return _given(places, "status", "description").groupBy("book").agg(F.array_join(F.array_sort(F.collect_list(one)), "|").alias("signature"))


#: Kinds of places by level, tried in this order; what none of these words is in has level 35.
LEVELS = (("世界", 90), ("大陆|洲", 80), ("国家|王国|帝国", 70), ("区域|地区|省|州|郡|领", 60), ("城市|城镇|市|城", 50), ("村落|村|街区|社区|街道", 40), ("庄园|营地|教会|组织", 35), ("学校|学院|大学|建筑|机构|住宅|公寓|住处|酒馆|店铺|商店|避难所", 30), ("房间|教室|书房|机房|实验室|设施", 20))
STRONG = "大陆|世界|国家|王国|帝国|区域|地区|省|州|郡|城市|城镇|市|城|村落|村|街区|社区"
PARENTS = STRONG + "|教会|组织|庄园|营地"
CHILDREN = "住宅|公寓|住处|房间|建筑|机构|学校|学院|大学|教室|书房|酒馆|店铺|商店|机房|实验室|避难所|设施"


def place_level(kind: Column) -> Column:
    key, out = knowledge_key(kind), F.lit(35)
    for words, level in LEVELS[::-1]:
        out = F.when(key.rlike(words), level).otherwise(out)
    return out


def place_rank(kind: Column) -> Column:
    """The band of a place's level by which places are ordered."""
    level = place_level(kind)
    return F.when(level >= 70, 4).when(level >= 50, 3).when(level >= 40, 2).when(knowledge_key(kind).rlike(CHILDREN), 0).otherwise(1)


def places_in_order(places: DataFrame) -> DataFrame:
    """places with their place in the book: by band of level, importance, kind and name."""
    rows = _given(places, "importance")
    order = W.partitionBy("book").orderBy(place_rank(F.col("kind")).desc(), importance_rank(F.col("importance")).desc(), F.coalesce("kind", F.lit("")), "name")
    return rows.withColumn("place", F.row_number().over(order))


#: Characters by which a name meets the texts that may hold it.
GRAM = 4


def _grams(text: Column) -> Column:
    """The distinct runs of up to GRAM characters of a text."""

    def runs(chars: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.size(chars) - i + 1)), lambda n: F.array_join(F.slice(chars, i, n), ""))))

    return F.when(F.length(text) > 0, F.array_distinct(let(F.split(text, ""), runs))).otherwise(F.array().cast("array<string>"))


def infer_parents(places: DataFrame) -> DataFrame:
    """book, name and parent: the given one if it is of a higher level; else a place of a higher level that the own texts
    name; else one whose texts name this place; else, for buildings and rooms, the book's only place of a town's kind, or
    its only strong one. Of several the strongest and longest-named. Places of low importance go.

    Pairs are those of one book in which a text names a place, found through the names that texts hold; no other pair is formed.
    """
    p = _given(places, "status", "importance", "description")
    p = p.where(~is_low(F.col("importance")) & (knowledge_key(F.col("name")) != "")).withColumn("key", knowledge_key(F.col("name")))
    text = knowledge_key(F.concat_ws(" ", "description", "status", "parent_name"))
    up = F.when(knowledge_key(F.col("parent_name")) != F.col("key"), F.col("parent_name"))
    kind = knowledge_key(F.col("kind"))
    p = p.select("book", "name", "key", up.alias("given"), text.alias("text"), place_level(F.col("kind")).alias("level"), (kind.rlike(PARENTS) | ~kind.rlike(CHILDREN)).alias("can"), kind.rlike(STRONG).alias("strong"), kind.rlike(CHILDREN).alias("inner"), kind.rlike("城市|城镇|市|城|村落|村|街区|社区|街道").alias("town"))
    # Which names a text holds: names meet texts by the characters they begin with, and only those that do are looked for.
    grams = p.select("book", "key", "text", F.explode(_grams(F.col("text"))).alias("gram"))
    begin = p.select("book", F.col("key").alias("other"), F.substring("key", 1, GRAM).alias("gram")).distinct()
    named = grams.join(begin, ["book", "gram"]).where(F.contains("text", F.col("other")) & (F.col("other") != F.col("key"))).select("book", "key", "other").distinct()
    sides = p.select("book", F.col("key").alias("other"), F.col("name").alias("up"), F.col("level").alias("up_level"), F.col("can").alias("up_can"), F.col("strong").alias("up_strong"))
    own = p.select("book", "key", "level", "given")
    pairs = named.withColumn("how", F.lit(2)).unionByName(named.select("book", F.col("other").alias("key"), F.col("key").alias("other"), F.lit(3).alias("how")))
    met = pairs.join(own, ["book", "key"]).join(sides, ["book", "other"]).where("up_level > level")
    told = met.where("up_can")
    stated = own.where("given is not null").select("book", "key", "level", knowledge_key(F.col("given")).alias("other"), F.lit(1).alias("how")).join(sides, ["book", "other"]).where("up_level > level")
    best_of = F.struct("how", (-F.col("up_level")).alias("l"), (-F.length("up")).alias("n"), "up")
    best = stated.select("book", "key", best_of.alias("b")).unionByName(told.select("book", "key", best_of.alias("b"))).groupBy("book", "key").agg(F.min("b").alias("b"))

    def only(chosen: Column, name: str) -> DataFrame:
        """For each level of a book the only chosen place above it, if there is just one."""
        strong = p.where(chosen & F.col("strong")).select("book", F.col("name").alias(name), F.col("level").alias("_l"))
        return strong.join(p.where("inner").select("book", "level").distinct(), "book").where("_l > level").groupBy("book", "level").agg(F.count("*").alias("_n"), F.min(name).alias(name)).where("_n = 1").drop("_n")

    out = p.join(best, ["book", "key"], "left").join(only(F.col("town"), "by_town"), ["book", "level"], "left").join(only(F.lit(True), "by_strong"), ["book", "level"], "left")
    fallback = F.when(F.col("inner"), F.coalesce("by_town", "by_strong"))
    known = stated.select("book", "key").unionByName(own.where("given is not null").withColumn("other", knowledge_key(F.col("given"))).join(sides, ["book", "other"]).select("book", "key")).distinct().withColumn("_known", F.lit(True))
    out = out.join(known, ["book", "key"], "left")
    return out.select("book", "name", F.coalesce("b.up", fallback, F.when(F.col("_known").isNull(), F.col("given"))).alias("parent"))
