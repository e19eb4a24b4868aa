"""License scans: exact set-similarity join of text blocks with license templates.

Method. A text block is a line with the two lines behind it (``LINES``), so a notice may wrap; it is taken as its set of
words. All words of the templates are ordered by the number of documents that hold them, rarest first. A block contains
a template when it holds at least ``ceil(threshold * |template|)`` of its distinct words. The join meets only on words of
a template's prefix (its ``|template| - needed + 1`` rarest words: a block that has none of them cannot reach the
threshold), so texts without any prefix word are not even cut into blocks. The length filter drops blocks with fewer
template words than any template needs, the positional filter drops a meeting whose remaining words cannot reach the
threshold, and what is left is verified on the full sets, so no match is lost.

Only DataFrame functions are used. The one side that is broadcast is the prefix index: its size is that of the given
templates and does not depend on the corpus. The verified labels are grouped per (id, text hash), which no skew of the
corpus makes larger than a document; identical rows share the answer, which depends on the text alone.

Defined cases: null or empty text has no words and no labels; repeated rows and null ids each keep their own row;
a block may match several templates; the last lines make shorter blocks; phrases do not cross documents but may cross
lines; extra columns are ignored. A text of many lines takes time in proportion to its length.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import ascii_lower, words_of

#: Fixed phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "cc-by": ["cc", "by"],
    "gpl": ["general", "public", "license"],
    "reserved": ["all", "rights", "reserved"],
}

#: Notices the containment search looks for, and their labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc",
    "cc-by-sa": "licensed under cc by sa",
    "gpl-notice": "licensed under the gnu general public license",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl": "subject to the terms of the mozilla public license",
    "public-domain": "this work is released into the public domain",
}

THRESHOLD = 0.85
#: Consecutive lines of a block.
LINES = 3


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))) for k, t in templates.items()}


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def phrase_starts(words: Column, phrase: list[str]) -> Column:
    """Every index where the phrase's words stand consecutively, ascending."""
    def here(i: Column) -> Column:
        hit = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return hit

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    all_there = F.array_contains(words, phrase[0])
    for w in phrase[1:]:
        all_there = all_there & F.array_contains(words, w)
    return F.when(all_there, found).otherwise(F.expr("array()").cast("array<int>"))


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by the number of documents that hold a word, rarest first, ties by word.

    What is collected has as many rows as the templates have words.
    """
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(ascii_lower(F.col("text"))))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def blocks(docs: DataFrame, order: list[str], prefix: list[str], least: int, lines: int) -> DataFrame:
    """Key columns and ``words``, in the given order, of every block that holds ``least`` of them, a prefix word included."""
    known, rare = F.array(*map(F.lit, order)), F.array(*map(F.lit, prefix))
    low = docs.select("doc_id", ascii_lower(F.col("text")).alias("low")).where(F.col("low").rlike("|".join(sorted(prefix))))
    # hashes and lines are taken once per text, before the generator multiplies the rows
    cut = low.select(
        "doc_id", F.xxhash64("low").alias("h1"), F.hash("low").alias("h2"),
        F.transform(F.split("low", "\n"), lambda line: F.array_intersect(known, words_of(line))).alias("lines"),
    ).where(F.arrays_overlap(F.flatten("lines"), rare))
    from_line = F.transform(
        F.sequence(F.lit(1), F.size("lines")), lambda i: F.array_intersect(known, F.flatten(F.slice("lines", i, F.lit(lines))))
    )
    kept = F.filter(from_line, lambda words: (F.size(words) >= least) & F.arrays_overlap(words, rare))
    return cut.select("doc_id", "h1", "h2", F.array_distinct(kept).alias("sets")).select("doc_id", "h1", "h2", F.explode("sets").alias("words"))


def prefix_rows(order: list[str], sets: dict[str, list[str]], threshold: float) -> list[tuple]:
    """The prefix index: word, label, place in the template, words needed and the template by the order."""
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for label, words in sets.items():
        ranked = sorted(words, key=place.__getitem__)
        need = needed(len(ranked), threshold)
        rows += [(w, label, i, need, ranked) for i, w in enumerate(ranked[: len(ranked) - need + 1])]
    return rows


def similarity_join(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, lines: int = LINES) -> DataFrame:
    """(doc_id, h1, h2, label, containment): every block and template at or above the threshold.

    Blocks of one text with the same template words count once.
    """
    sets = template_words(templates)
    vocabulary = sorted({w for ws in sets.values() for w in ws})
    order = word_order(docs, vocabulary)
    rows = prefix_rows(order, sets, threshold)
    index = docs.sparkSession.createDataFrame(rows, "word string, label string, place int, need int, template array<string>")
    least = min(needed(len(ws), threshold) for ws in sets.values())
    meetings = (
        blocks(docs, order, sorted({r[0] for r in rows}), least, lines)
        .select("doc_id", "h1", "h2", "words", F.posexplode("words").alias("at", "word"))
        .join(F.broadcast(index), "word")
        .where(F.least(F.size("template") - F.col("place"), F.size("words") - F.col("at")) >= F.col("need"))
        .withColumn("common", F.array_intersect("template", "words"))
        .where((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("word")))
    )
    return meetings.select("doc_id", "h1", "h2", "label", (F.size("common") / F.size("template")).alias("containment"))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, lines: int = LINES) -> DataFrame:
    """One row per document: word count, base phrases, labels of both kinds and a score from 0 to 1.

    ``template_labels`` and ``containment`` are the similarity join's own output; the score is 1 where a base phrase
    stands, else the best containment found.
    """
    docs = docs.select("doc_id", "text")
    matched = (
        similarity_join(docs, templates, threshold, lines)
        .groupBy("doc_id", "h1", "h2")
        .agg(F.array_sort(F.collect_set("label")).alias("template_labels"), F.max("containment").alias("containment"))
        .withColumnsRenamed({"doc_id": "m_id", "h1": "m1", "h2": "m2"})
    )
    low = docs.select("doc_id", ascii_lower(F.col("text")).alias("low"))
    worded = low.select("doc_id", F.xxhash64("low").alias("h1"), F.hash("low").alias("h2"), words_of(F.col("low")).alias("words"))
    for k, (label, phrase) in enumerate(PHRASES.items()):
        worded = worded.withColumn(f"p{k}", phrase_starts(F.col("words"), phrase))
    starts = F.flatten(F.array(*[F.col(f"p{k}") for k in range(len(PHRASES))]))
    named = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES)]))
    base = worded.select(
        "doc_id", "h1", "h2",
        F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_sort(named).alias("base"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2"))
    both = F.array_sort(F.array_union("base", F.coalesce("template_labels", F.expr("array()").cast("array<string>"))))
    return base.join(matched, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, lines: int = LINES) -> str:
    """The same rows from DuckDB, by comparing every block with every template."""
    values = ", ".join(f"('{k}', {ws!r}, {needed(len(ws), threshold)})" for k, ws in template_words(templates).items())
    upper = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    tests = {
        label: " AND ".join(f"words[i + {k}] = '{w}'" if k else f"words[i] = '{w}'" for k, w in enumerate(phrase))
        for label, phrase in PHRASES.items()
    }
    parts = ", ".join(
        f"list_filter(range(1, len(words) + 1), lambda i: coalesce({t}, false)) AS p{k}" for k, t in enumerate(tests.values())
    )
    names = " || ".join(f"CASE WHEN len(p{k}) > 0 THEN ['{label}'] ELSE [] END" for k, label in enumerate(tests))
    starts = " || ".join(f"p{k}" for k in range(len(tests)))
    return f"""
        WITH t(label, tw, need) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS rid, doc_id, {upper} AS low FROM documents),
        w AS (SELECT rid, doc_id, regexp_extract_all(low, '{word}') AS words FROM d),
        p AS (SELECT rid, doc_id, len(words) AS n, {parts} FROM w),
        b AS (SELECT rid, doc_id, n, {starts} AS starts, list_sort({names}) AS base FROM p),
        c AS (SELECT rid, string_split(low, chr(10)) AS parts FROM d),
        s AS (SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS i FROM c),
        l AS (SELECT rid, list_distinct(regexp_extract_all(array_to_string(parts[i : i + {lines - 1}], chr(10)), '{word}')) AS words FROM s),
        m AS (SELECT rid, label, len(list_intersect(tw, words)) / len(tw) AS c FROM l, t
              WHERE len(list_intersect(tw, words)) >= need),
        g AS (SELECT rid, list(DISTINCT label) AS found, max(c) AS best FROM m GROUP BY rid)
        SELECT doc_id, n AS n_words, len(starts) AS n_base,
               list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word,
               array_to_string(base, ',') AS base_labels,
               array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') AS labels,
               CASE WHEN len(starts) > 0 THEN 1.0e0 ELSE coalesce(best, 0.0e0) END AS score
        FROM b LEFT JOIN g USING (rid)"""
