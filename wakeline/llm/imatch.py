"""Document fingerprints: I-Match over several randomised lexicon subsets.

Method. The lexicon holds the terms whose inverse document frequency over the whole corpus lies in a band: terms in
fewer than ``LEAST_SHARE`` or more than ``MOST_SHARE`` of the documents tell nothing about likeness. Each term belongs
to a random few of ``SUBSETS`` lexicon subsets, whose rates fall geometrically, so that short and long documents both
meet subsets that hold one or two of their terms. A document's distinct terms in a subset are hashed into one value;
terms are combined by sum and exclusive or, which gives the value of the sorted list without sorting it. Likeness is
the share of the subsets non-empty on either side whose values agree.

Only DataFrame functions are used. The lexicon is made once. A term in at least ``LEAST_SHARE`` of the documents takes
that share of them, so there are at most (distinct terms of a mean document) / ``LEAST_SHARE`` terms; it is broadcast up
to ``BROADCAST_ROWS`` rows and joined by a shuffle beyond. Texts are moved once: into ranges of the id order, four
ranges per shuffle partition, whose borders alone come to the driver. Inside a range the next document is the next row;
the last row of a range meets the first of the following one in a join of one row per range. A text's own and edited
words pass through the lexicon together and are gathered in the same stage, for the ranges already hold each document in
one place.

Defined cases: null text is empty; a text without lexicon terms gets one value over all its words, so equal texts have
equal fingerprints and two texts without words are alike (1.0); rows of equal id are ordered by text hash and length,
null ids come last; a single document is its own next one; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import ascii_lower, shuffle_partitions, words_of
from wakeline.session import cut_lineage

LEAST_SHARE = 0.0005
MOST_SHARE = 0.2
SUBSETS = 64
#: Bits of a subset's value; the subset's number stands above them.
VALUE_BITS = 25
#: A term joins a subset with probability 2^-level; levels repeat over the subsets.
LEVELS = (5, 6, 7, 8, 9, 10)
#: A lexicon of more rows than this is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 2_000_000


def terms_of(text: Column) -> Column:
    return F.array_distinct(words_of(ascii_lower(text)))


def subsets_of(term: Column) -> Column:
    """The lexicon subsets a term hash belongs to, from the hash alone."""
    member = [
        F.when(F.pmod(F.xxhash64(F.lit(j), term), F.lit(2 ** LEVELS[j % len(LEVELS)])) == 0, F.lit(j)) for j in range(SUBSETS)
    ]
    return F.array_compact(F.array(*member))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term, subset): hashes of the terms in the band of document frequencies, once for each subset they belong to."""
    total = docs.count()
    lowest, highest = max(2.0, least * total), most * total
    seen = docs.select(F.explode(terms_of(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("term")).groupBy("term").count()
    band = seen.where((F.col("count") >= lowest) & (F.col("count") <= highest))
    return band.select("term", F.explode(subsets_of(F.col("term"))).alias("subset"))


def hashed(text: Column) -> Column:
    """The hashes of a text's distinct terms."""
    return F.array_distinct(F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w)))


def tagged(kind: int, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("term")))


def gathered(rows: DataFrame, keys: list[str], texts: list[str], facts: list[Column], lexicon: DataFrame) -> DataFrame:
    """``keys`` with ``fp_0``, ``fp_1``.. of the columns ``texts``, and the longs ``facts`` as ``fact_0``, ``fact_1``..

    A fingerprint is sorted ints, the subset above ``VALUE_BITS`` bits. Words and facts of a row go through one
    explosion and one aggregation; a text without lexicon terms gets its ``whole_value``.
    """
    n = len(texts)
    # taken in a select of their own: inside the explosion every mention would be computed again
    names, known = [f"_fact_{i}" for i in range(len(facts))], [f"_terms_{i}" for i in range(n)]
    rows = rows.select(*keys, *[f.alias(a) for f, a in zip(facts, names)], *[hashed(F.col(t)).alias(a) for t, a in zip(texts, known)])
    facts = [*map(F.col, names), *[whole_value(F.col(a)) for a in known]]
    parts = [tagged(i, F.col(a)) for i, a in enumerate(known)]
    parts += [tagged(n + i, F.array(f)) for i, f in enumerate(facts)]
    each = rows.select(*keys, F.explode(F.concat(*parts)).alias("e")).select(*keys, "e.kind", "e.term")
    hits = each.join(lexicon.withColumnRenamed("term", "known"), (F.col("kind") < n) & (F.col("term") == F.col("known")), "left").where((F.col("kind") >= n) | F.col("subset").isNotNull())
    slot = F.when(F.col("kind") < n, F.col("kind") * SUBSETS + F.col("subset")).otherwise(n * SUBSETS + F.col("kind"))
    sums = hits.groupBy(*keys, slot.alias("slot")).agg(F.bit_xor("term").alias("x"), F.sum(F.hash("term").cast("long")).alias("s"))
    value = F.pmod(F.xxhash64("x", "s"), F.lit(2**VALUE_BITS)) + (F.col("slot") % SUBSETS) * 2**VALUE_BITS
    prints = [F.array_sort(F.collect_list(F.when(F.floor(F.col("slot") / SUBSETS) == i, value.cast("int")))).alias(f"fp_{i}") for i in range(n)]
    kept = [F.max(F.when(F.col("slot") == n * SUBSETS + n + i, F.col("x"))).alias(f"fact_{i}") for i in range(len(facts))]
    out = sums.groupBy(*keys).agg(*prints, *kept)
    own = [F.when(F.size(f"fp_{i}") > 0, F.col(f"fp_{i}")).otherwise(F.array(F.col(f"fact_{len(facts) - n + i}").cast("int"))).alias(f"fp_{i}") for i in range(n)]
    return out.select(*keys, *own, *[f"fact_{i}" for i in range(len(facts) - n)])


def whole_value(terms: Column) -> Column:
    """The one value of a text without lexicon terms, from its terms' hashes: a negative int, so in no subset."""
    return -1 - F.pmod(F.xxhash64(F.sort_array(terms)), F.lit(2**31 - 1))


def likeness(a: Column, b: Column) -> Column:
    subsets = F.array_union(*[F.transform(x, lambda v: F.shiftright(v, VALUE_BITS)) for x in (a, b)])
    return F.size(F.array_intersect(a, b)) / F.size(subsets)


def as_text(fp: Column) -> Column:
    unsigned = F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v.cast("long").bitwiseAND(F.lit(2**32 - 1)))), 8, "0"))
    return F.array_join(unsigned, "")


def place(doc_id: Column, text: Column) -> Column:
    """Ascending where ids descend; null ids come last, rows of one id follow the hash of their text."""
    return F.struct(
        doc_id.isNull().alias("none"), F.bitwise_not(F.coalesce(doc_id, F.lit(0)).cast("long")).alias("down"), F.xxhash64(text).alias("th")
    )


def borders(rows: DataFrame) -> list[tuple]:
    """The first place of each range of about equally many rows: at most four per shuffle partition."""
    # several ranges to a partition, so that their hashes fill the partitions evenly
    narrow = rows.select("at.*").repartitionByRange(4 * shuffle_partitions(rows.sparkSession), "none", "down", "th")
    placed = narrow.withColumn("part", F.spark_partition_id())
    firsts = placed.groupBy("part").agg(F.min(F.struct("none", "down", "th")).alias("f")).select("f.*").collect()
    return sorted(map(tuple, firsts))


def range_of(rows: DataFrame, firsts: list[tuple]) -> DataFrame:
    """Adds ``range``: how many borders stand at or before the row, less one.

    Found in two steps of about the square root of the borders each: every ``step``-th border, then those behind it.
    The borders enter the plan as two folded values, so that the plan does not grow with their number.
    """
    step = math.isqrt(len(firsts)) + 1

    def passed(known: Column) -> Column:
        return F.size(F.filter(known, lambda border: border <= F.col("at")))

    coarse = (passed(literal_borders(firsts[::step])) - 1) * step
    rows = rows.withColumn("coarse", coarse)
    return rows.withColumn("range", F.col("coarse") + passed(F.slice(literal_borders(firsts), F.col("coarse") + 1, step)) - 1).drop("coarse")


def literal_borders(firsts: list[tuple]) -> Column:
    named = [dict(zip(("none", "down", "th"), f)) for f in firsts]
    return F.from_json(F.lit(json.dumps(named)), "array<struct<none:boolean,down:bigint,th:bigint>>")


def imatch(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """One row per document: its own and its edited text's fingerprint and their likeness.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many of the next document.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("at", place(F.col("doc_id"), F.col("text")))
    lex = cut_lineage(lexicon(texts, least, most))
    if lex.count() <= BROADCAST_ROWS:
        lex = F.broadcast(lex)
    firsts = borders(texts) or [(True, 0, 0)]
    # the first document of every range, for the last row of the range before
    following = [(k - 1 if k else len(firsts) - 1, *f) for k, f in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(following, "range int, none boolean, down long, th long")
    heads = heads.select("range", F.struct("none", "down", "th").alias("at"))
    first_texts = texts.join(F.broadcast(heads), "at").dropDuplicates(["range"]).select("range", F.col("text").alias("first_text"))
    first_prints = gathered(first_texts, ["range"], ["first_text"], [], lex).select("range", F.col("fp_0").alias("first_fp"))

    inside = Window.partitionBy("range").orderBy("at")
    rows = range_of(texts, firsts).select(
        "range", "doc_id", "text", F.lead("text").over(inside).alias("next"), F.row_number().over(inside).alias("row")
    )
    rows = rows.join(first_texts.hint("merge"), "range", "left").withColumn("n", F.char_length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n") - half), F.substring(F.coalesce("next", "first_text"), F.lit(1), half)
    ))
    digest = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)]
    keys = ["range", "row", "doc_id", "n"]
    found = gathered(rows, keys, ["text", "edited"], quarters, lex)
    found = found.withColumn("next_fp", F.lead("fp_0").over(Window.partitionBy("range").orderBy("row")))
    found = found.join(first_prints.hint("merge"), "range", "left").withColumn("next_fp", F.coalesce("next_fp", "first_fp"))
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"fact_{i}")), 16, "0") for i in range(4)])
    return found.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        sha.alias("edited_sha256"),
        as_text(F.col("fp_0")).alias("fingerprint"),
        as_text(F.col("fp_1")).alias("edited_fingerprint"),
        likeness(F.col("fp_0"), F.col("fp_1")).alias("near_edited"),
        likeness(F.col("fp_0"), F.col("next_fp")).alias("near_next"),
    )
