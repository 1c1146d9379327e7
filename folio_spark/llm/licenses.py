"""License scan by diagonal voting: k-gram hashes join template positions, and those that agree in offset vote together.

A text's words are hashed in rolling groups of k, and all of them join the positions of the templates by hash; the words
themselves decide what is equal. A hit at word p of the text and position t of a template votes for the diagonal p - t,
where the template would begin. Votes are summed by diagonal; neighbouring diagonals (words left out or put in) merge where
each has enough votes; a merged span counts if the template's words that its votes cover are enough of the longer of
template and span. Where spans of different templates share words, the best one holds them. Phrases are templates of
which every word must stand on one diagonal; they stay whatever else is found.

All of it is built-in functions. A text's end joins a template of its own, so one pass tells the number of words and keeps
texts without hits; hits alone are shuffled, by row. The templates are a parameter; up to LARGEST positions of them are
broadcast.

Defined results: a null text is an empty one, without words; texts are read whole; of equal scores the spans that share words
all stay; repeated rows and null ids are rows of their own; an empty table gives no rows; columns beyond id and text
play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a hash, and the share of a template that a span must cover.
K, THRESHOLD = 3, 0.85
#: Positions of templates up to which they are broadcast (some 100 bytes each).
LARGEST = 200_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


#: The phrases of the query's base definition, then sentences of public licenses and of their notices.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
NOTICES = (
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl-3", "gnu lesser general public license version 3"),
    Template("agpl-3", "gnu affero general public license version 3"),
    Template("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    Template("lgpl-3", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """A-Z lowered, then the runs of ASCII digits, ASCII letters and all other characters beyond ASCII."""
    whole = F.coalesce(text, F.lit(""))
    # lower() does more than A-Z only where other capitals stand
    low = F.when(whole.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole))
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def _hash(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(k)))


def template_table(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """A row for each position: t (the template), at, grams (its words there), and what holds for the template; t = -1 is a text's end."""
    one = lambda t, x: F.struct(F.lit(t).alias("t"), F.lit(x.label).alias("label"), F.lit(x.phrase).alias("phrase"), F.lit(x.text).alias("text"))
    known = spark.range(1).select(F.inline(F.array(*(one(t, x) for t, x in enumerate(templates))))).withColumn("w", words_of(F.col("text")))
    known = known.withColumn("length", F.size("w")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("length") - k)))
    positions = known.select(_hash(F.col("w"), F.col("at"), k).alias("h"), "t", "label", "phrase", "length", "at", F.slice("w", F.col("at") + 1, k).alias("gram"))
    end = spark.range(1).select(F.xxhash64(F.lit("end"), F.lit(k)).alias("h"), F.lit(-1).alias("t"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("phrase"), F.lit(0).alias("length"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("gram"))
    return positions.unionByName(end)


def hits(docs: DataFrame, templates: tuple[Template, ...], k: int, id_col: str, text_col: str) -> DataFrame:
    """Every equal k-gram: row, id, p (word of the text) and the template's position; one hit of t = -1 stands at each text's end."""
    if short := [x.text for x in templates if len(x.text.split()) < k]:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    table = template_table(docs.sparkSession, templates, k)
    if sum(len(x.text.split()) for x in templates) <= LARGEST:
        table = F.broadcast(table)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w"))
    # hashed in a step of its own, so that rows and join are one compiled loop, which copies no words before it has a hit
    rolled = rows.select("row", "id", "w", F.concat(F.transform("w", lambda x, i: _hash(F.col("w"), i, k)), F.array(F.xxhash64(F.lit("end"), F.lit(k)))).alias("hashes"))
    every = rolled.select("row", "id", "w", F.posexplode_outer("hashes").alias("p", "hash"))  # outer: else a filter hashes all words again
    same = (F.slice("w", F.col("p") + 1, k) == F.col("gram")) | ((F.col("t") == -1) & (F.col("p") == F.size("w")))
    return every.join(table, (F.col("hash") == F.col("h")) & same).select("row", "id", "t", "label", "phrase", "length", "at", "p")


def spans(found: DataFrame, k: int, threshold: float) -> DataFrame:
    """Verified spans of the hits: row, id, t, label, phrase, start, stop (exclusive) and score; the ends stay (stop: the number of words)."""
    diagonals = found.groupBy("row", "id", "t", "label", "phrase", "length", (F.col("p") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("votes"))
    grams = F.col("length") - k + 1
    enough = F.when(F.col("phrase"), F.size("votes") == grams).otherwise(F.size("votes") >= F.greatest(F.lit(1), F.floor(grams / 8)))
    order = W.partitionBy("row", "t").orderBy("diagonal")
    drift = F.when(F.col("phrase"), 0).otherwise(F.greatest(F.lit(2), F.floor(F.col("length") / 4)))
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order)) > drift, F.lit(True))
    islands = diagonals.where(enough).withColumn("island", F.sum(apart.cast("int")).over(order))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("votes")), lambda a: F.sequence(a, a + (k - 1))))))
    merged = islands.groupBy("row", "id", "t", "label", "phrase", "length", "island").agg(
        F.min(F.col("diagonal") + F.array_min("votes")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("votes") + k).alias("stop"),
        covered.alias("covered"),
    )
    end = F.col("t") == -1
    score = F.when(end, 0.0).otherwise(F.col("covered") / F.greatest("length", F.col("stop") - F.col("start")))
    scored = merged.select("row", "id", "t", "label", "phrase", "start", F.when(end, F.col("start")).otherwise(F.col("stop")).alias("stop"), score.alias("score")).where(end | F.col("phrase") | (F.col("score") >= threshold))
    # a word belongs to the best span of those over it; a span that loses any to another label's goes
    word = F.explode_outer(F.when(~end, F.sequence("start", F.col("stop") - 1))).alias("word")
    best = F.max("score").over(W.partitionBy("row", "word"))
    held = scored.select("*", word).withColumn("beaten", ~F.col("phrase") & (F.col("score") < best))
    return held.groupBy("row", "id", "t", "label", "phrase", "start", "stop", "score").agg(F.max("beaten").alias("beaten")).where(~F.col("beaten")).drop("beaten")


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, k: int = K, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, and spans (start, stop, label, phrase, score), by their start."""
    one = F.struct("start", "stop", "label", "phrase", "score")
    told = spans(hits(docs, templates, k, id_col, text_col).repartition("row"), k, threshold)
    return told.groupBy("row", "id").agg(F.max(F.when(F.col("t") == -1, F.col("stop"))).cast("long").alias("n_words"), F.array_sort(F.collect_list(F.when(F.col("t") >= 0, one))).alias("spans")).select(F.col("id").alias(id_col), "n_words", "spans")


def op11_licenses(spark, sf_dir: str) -> DataFrame:
    told = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return told.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), score.alias("score"))


_VALUES = ", ".join(f"({t}, '{x.label}', {str(x.phrase).lower()}, '{x.text}')" for t, x in enumerate(PHRASES + NOTICES))
OP11_SQL = f"""
WITH templates(t, label, phrase, text) AS (VALUES {_VALUES}),
     tw AS (SELECT *, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS length FROM templates),
     g AS (SELECT t, label, phrase, length, unnest(range(length - 2)) AS tp, w FROM tw),
     grams AS (SELECT t, label, phrase, length, tp, w[tp + 1] AS a, w[tp + 2] AS b, w[tp + 3] AS c FROM g),
     d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     e AS (SELECT r, w, unnest(range(len(w) - 2)) AS p FROM d),
     hit AS (SELECT e.r, e.p, g.* FROM e JOIN grams g ON w[p + 1] = a AND w[p + 2] = b AND w[p + 3] = c),
     dia AS (SELECT r, t, any_value(label) AS label, any_value(phrase) AS phrase, any_value(length) AS length, p - tp AS diagonal, list(DISTINCT tp) AS votes FROM hit GROUP BY r, t, p - tp),
     kept AS (SELECT * FROM dia WHERE CASE WHEN phrase THEN len(votes) = length - 2 ELSE len(votes) >= greatest(1, (length - 2) // 8) END),
     apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) <= CASE WHEN phrase THEN 0 ELSE greatest(2, length // 4) END THEN 0 ELSE 1 END AS new FROM kept),
     isl AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY diagonal) AS island FROM apart),
     m AS (SELECT r, t, any_value(label) AS label, any_value(phrase) AS phrase, any_value(length) AS length, min(diagonal + list_min(votes)) AS s, max(diagonal + list_max(votes) + 3) AS e,
                  len(list_distinct(flatten(list_transform(flatten(list(votes)), lambda a: [a, a + 1, a + 2])))) AS covered FROM isl GROUP BY r, t, island),
     sc AS (SELECT *, CAST(covered AS DOUBLE) / greatest(length, e - s) AS score FROM m),
     ok AS (SELECT * FROM sc WHERE phrase OR score >= {THRESHOLD}),
     left_ AS (SELECT * FROM ok x WHERE phrase OR NOT EXISTS (SELECT 1 FROM ok y WHERE y.r = x.r AND y.s < x.e AND x.s < y.e AND y.score > x.score)),
     told AS (SELECT r, count(*) FILTER (phrase) AS n_base, min(s) FILTER (phrase) AS first_word, max(s) FILTER (phrase) AS last_word,
                     array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score
              FROM left_ GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN told USING (r)
"""
