"""MinHash near-dedup with tensored banding, verified on full shingle sets.

Method. Documents with the same shingle set are one class from the start. Each class has two small hash collections of
``ROWS`` entries, every entry made of ``WIDTH`` minhashes. Table (i, j) is keyed by the pair (entry i of the first
collection, entry j of the second), so ``2 * ROWS * WIDTH`` minhashes serve ``ROWS * ROWS`` tables whose keys would
otherwise take ``ROWS * ROWS * 2 * WIDTH``. Two sets of similarity s meet in some table with probability
``(1 - (1 - s^WIDTH)^ROWS)^2``: with the defaults 0.9998 at the threshold and rising steeply beyond it.
Candidates are first screened by the sets' sizes (exact) and by how many minhashes agree (six standard deviations
below the threshold), then confirmed on the full sets.

No group emits all its pairs. First every member is tried once, against the least id of all its buckets; the confirmed
links are a forest, whose roots name the components. Only buckets that still hold several components are looked at
again: their members are tried against the buckets' three pivots (the least members under three orders), one pivot of
each other component. What is still open then is compared in full, but only across components and with one side outside
the bucket's largest component. Pairs within a component can add nothing, so every link between candidates has its
effect. Bucket statistics are partial sums before the shuffle, so a bucket with a third of all rows costs its one row
per map task.

Components: the first labels come by pointer jumping along the forest. Later links are followed between components
only, by lowering labels and jumping; every round is checkpointed in the shared folder.

Defined cases: null or blank text has an empty set and is its own component; fewer words than a shingle make one
shingle of the whole sequence; rows of null id are never linked and have a null component; rows repeated under one id
with equal sets are one document; rows repeated under one id with other texts answer each for its own set, linked as
that id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm import rolling
from wakeline.session import cut_lineage

ROWS = 9
WIDTH = 2
NUMERATOR, DENOMINATOR = 80, 100
PIVOTS = 3
#: The share of agreeing minhashes below which a candidate cannot reach the threshold (6 standard deviations).
SCREEN = 0.42
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SMALL = 32
#: Partners compared with one copy of a text in one run.
MEMBERS = 256
#: Rows of ids read by one task at least.
PART_ROWS = 20_000
TILE = 256
#: Buckets of ids that mark which texts a confirmation may need: the bound of what it broadcasts.
ID_BUCKETS = 1 << 20
#: Bytes of text hashed at a time inside a task; hashing takes some hundred bytes of memory for each.
BATCH_BYTES = 1 << 18


def grouped(texts: list[bytes], most: int = BATCH_BYTES) -> Iterator[list[int]]:
    """Row numbers in runs of about ``most`` bytes; a longer text is a run of its own."""
    for at, stop in stretches(np.array([len(t) for t in texts], np.int64), most):
        yield list(range(at, stop))


def stretches(lengths: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield at, len(lengths)


def text_runs(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of an Arrow column as bytes, about ``BATCH_BYTES`` at a time, with the number of the first; null is empty."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for at, stop in stretches(lengths):
        some = column.slice(at, stop - at)
        some = some.cast(pa.large_binary() if pa.types.is_large_string(some.type) else pa.binary())
        yield at, [t or b"" for t in some.to_pylist()]


def sum_of(values: np.ndarray) -> int:
    """A set's first hash."""
    return int(values.sum(dtype=np.uint64).astype(np.int64)) if len(values) else 0


def shingle_sets(texts: list[bytes], shingle: int, powers: rolling.Powers) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words are runs of bytes other than ASCII white space."""
    glued = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    data = LOWER[glued]
    space = ASCII_SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = rolling.Text(data, powers).of(starts, ends)
    lengths = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(lengths + 1) + 1  # the byte behind each text's closing space
    cut = np.concatenate([[0], np.searchsorted(starts, stops)])
    runs = words.copy()
    for k in range(1, shingle):
        runs = rolling.pairs(runs[:-1], words[k:]) if len(runs) > 1 else runs[:0]
    out = []
    for i in range(len(texts)):
        a, b = cut[i], cut[i + 1]
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        elif b > a:
            whole = words[a]
            for k in range(a + 1, b):
                whole = rolling.pairs(np.array([whole]), words[k : k + 1])[0]
            out.append(np.array([rolling.mixed(np.array([whole], np.uint64) + np.uint64(b - a))[0]], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One 32-bit minhash per multiplier."""
    low = np.full(len(multipliers), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        np.minimum(low, ((part[None, :] * multipliers[:, None]) >> np.uint64(32)).min(axis=1), out=low)
    return low.astype(np.uint32)


def sketches(docs: DataFrame, shingle: int, rows: int, width: int) -> DataFrame:
    """doc_id, set size, 128-bit set hash, minhash bytes and the two hash collections of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = rolling.Powers()
        count = 2 * rows * width
        multipliers = rolling.mixed(np.arange(1, count + 1, dtype=np.uint64) * rolling.BASE) | np.uint64(1)
        for batch in batches:
            for at, raw in text_runs(batch.column("text")):
                sizes, h1, h2, sigs, keys = [], [], [], [], []
                for values in shingle_sets(raw, shingle, powers):
                    sizes.append(len(values))
                    h1.append(sum_of(values))
                    h2.append(sum_of(rolling.mixed(values)))
                    entry = np.zeros(2 * rows if len(values) else 0, np.uint64)
                    sig = signature(values, multipliers)
                    if len(values):
                        for k in range(width):
                            entry = rolling.pairs(entry, sig[k::width].astype(np.uint64))
                    sigs.append(sig.astype(np.uint8).tobytes() if len(values) else b"")
                    keys.append(entry.astype(np.int64))
                ids = batch.column("doc_id").slice(at, len(raw))
                columns = [ids, pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "sig", "entries"])

    kind = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, entries array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, kind)


def settled(rows: DataFrame) -> DataFrame:
    """A checkpoint read in partitions of at least ``PART_ROWS`` rows: a later shuffle of few rows writes few files."""
    kept = cut_lineage(rows)
    return kept.coalesce(max(1, math.ceil(kept.count() / PART_ROWS)))


def roots(links: DataFrame) -> DataFrame:
    """(id, component) from links in which each b has one a, the smaller one: the way up is halved each round."""
    up = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    while True:
        above = up.select(F.col("id").alias("component"), F.col("component").alias("further"))
        jumped = settled(up.join(above, "component", "left").select("id", F.coalesce("further", "component").alias("component"), F.col("further").isNotNull().alias("moved")))
        up = jumped.select("id", "component")
        if jumped.where("moved").isEmpty():
            return up


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after further links (a, b), which are followed between components only."""
    def of(name: str) -> DataFrame:
        return labels.toDF(name, f"c{name}")

    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = settled(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct())
    if between.isEmpty():
        return labels
    joined = components(between).toDF("component", "lower")
    known = labels.join(joined, "component", "left").select("id", F.coalesce("lower", "component").alias("component"))
    # a component's own name is an id that may have had no label yet
    alone = joined.toDF("id", "component").join(labels.select("id"), "id", "left_anti")
    return settled(known.union(alone))


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over ``links`` (a, b), for every id on a link."""
    edges = settled(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = settled(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        root = labels.select(F.col("id").alias("low"), F.col("component").alias("root"))
        jumped = settled(
            lower.join(root, "low", "left").select("id", F.col("component").alias("old"), F.least("low", "root").alias("component"))
        )
        labels = jumped.select("id", "component")
        if jumped.where("old <> component").isEmpty():
            return labels


def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of equal minhash bytes."""
    if not len(a):
        return pd.Series([], dtype="float64")
    left = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    right = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series((left == right).mean(axis=1))


def bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(ID_BUCKETS))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of at least the documents in ``ids``.

    Only texts whose id falls into a marked bucket are moved on: at most ``ID_BUCKETS`` marks are broadcast, and a full
    set of marks merely moves every text.
    """
    marks = ids.select(bucket("id").alias("mark")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("mark", bucket("id"))
    return texts.join(F.broadcast(marks), "mark", "left_semi").select("id", "text")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, screen: float) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets reach the threshold.

    Texts are not paired row by row: the text of a stands before the texts of up to ``MEMBERS`` of its partners, and
    one pass over the sorted rows keeps a's set and compares each partner's with it.
    """
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sketch = classes.select("id", "n_shingles", "h1", "sig")
    left = sketch.toDF("a", "size_a", "h_a", "sig_a")
    right = sketch.toDF("b", "size_b", "h_b", "sig_b")
    share = F.pandas_udf(agreeing, "double")
    near = F.least("size_a", "size_b") * DENOMINATOR >= F.greatest("size_a", "size_b") * NUMERATOR
    likely = settled(
        pairs.join(left, "a").join(right, "b").where(near).where(share("sig_a", "sig_b") >= screen)
        .select("a", "b", "size_a", "size_b", "h_a", "h_b")
    )
    partners = likely.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("salts"))
    salted = likely.join(partners, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    heads = salted.select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("id"), F.col("size_a").alias("n"), F.col("h_a").alias("h")).distinct()
    members = salted.select("a", "salt", F.lit(1).alias("side"), F.col("b").alias("id"), F.col("size_b").alias("n"), F.col("h_b").alias("h"))
    texts = texts_of(docs, likely.select(F.col("a").alias("id")).union(likely.select("b")))
    read = heads.union(members).join(texts, "id").repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, head, of = rolling.Powers(), None, None
        for batch in batches:
            facts = [batch.column(c).to_pylist() for c in ("a", "salt", "side", "id", "n", "h")]
            for at, raw in text_runs(batch.column("text")):
                kept = []
                for k, values in enumerate(shingle_sets(raw, shingle, powers)):
                    a, salt, side, b, n, h = (column[at + k] for column in facts)
                    if of != (a, salt):
                        of, head = (a, salt), None
                    # size and hash tell a class's own text from another one repeated under its id
                    if len(values) != n or sum_of(values) != h:
                        continue
                    if side == 0:
                        head = values
                    elif head is not None:
                        common = len(np.intersect1d(head, values, assume_unique=True))
                        if DENOMINATOR * common >= NUMERATOR * (len(head) + n - common):
                            kept.append((a, b))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*kept)], names=["a", "b"])

    return settled(read.select("a", "salt", "side", "id", "n", "h", "text").mapInArrow(verify, "a long, b long").distinct())


def buckets(classes: DataFrame, rows: int) -> DataFrame:
    """(key, id) of every table key that at least two classes share."""
    first, second = F.slice("entries", 1, rows), F.slice("entries", rows + 1, rows)
    tables = F.transform(first, lambda x, i: F.transform(second, lambda y, j: F.xxhash64(x, y, i * rows + j)))
    keyed = classes.select("id", F.explode(F.flatten(tables)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keyed.join(shared, "key")


def hub_pairs(meeting: DataFrame) -> DataFrame:
    """One pair (a, b) for every member b: with the least id of all its buckets."""
    least = meeting.groupBy("key").agg(F.min("id").alias("p"))
    hub = meeting.join(least, "key").groupBy("id").agg(F.min("p").alias("a"))
    return hub.where("a <> id").select("a", F.col("id").alias("b"))


def pivot_pairs(still: DataFrame) -> DataFrame:
    """Members of open buckets with their buckets' pivots (the least members under ``PIVOTS`` orders), one of each other component."""
    orders = [F.col("id")] + [F.xxhash64(F.lit(k), "id") for k in range(1, PIVOTS)]
    one = F.struct("id", "component")
    pivots = still.groupBy("key").agg(*[F.min_by(one, o).alias(f"p{k}") for k, o in enumerate(orders)])
    each = still.join(pivots, "key").select("id", "component", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p"))
    other = each.where("p.component <> component").groupBy("id", "p.component").agg(F.min("p.id").alias("a"))
    return ordered(other, "a", "id")


def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def open_buckets(meeting: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, component, size and main (the largest component) of buckets that hold several components."""
    placed = meeting.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    crowds = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = crowds.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("main")
    )
    return placed.join(several.where("parts > 1"), "key").select("key", "id", "component", "size", "main")


def pairs_across(small: DataFrame) -> DataFrame:
    few = small.where("component <> main").select("key", F.col("id").alias("x"), F.col("component").alias("cx"))
    rest = small.select("key", F.col("id").alias("y"), F.col("component").alias("cy"))
    return ordered(few.join(rest, "key").where("cx <> cy"), "x", "y")


def tile_links(large: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The links between each component of large buckets and the outsiders that met it, tile by tile."""
    met = settled(large.select("main", "id", "component").distinct().withColumn("outside", F.col("component") != F.col("main")))
    counts = met.groupBy("main").agg(
        F.ceil(F.count_if("outside") / TILE).cast("int").alias("across"), F.ceil(F.count("*") / TILE).cast("int").alias("down")
    )
    sized = met.join(counts, "main")

    def dealt(rows: DataFrame, mine: str, other: str, parts: str, others: str, side: int) -> DataFrame:
        home = F.pmod(F.xxhash64("id"), F.col(parts)).cast("int").alias(mine)
        return rows.select(
            "main", "id", "component", home, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other), F.lit(side).alias("side")
        )

    outsiders = dealt(sized.where("outside"), "at", "to", "across", "down", 0)
    members = dealt(sized, "to", "at", "down", "across", 1)
    texts = texts_of(docs, met.select("id")).join(classes.select("id", "n_shingles"), "id")
    rows = outsiders.unionByName(members).join(texts, "id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        raw = [t.encode() for t in group["text"].fillna("")]
        powers = rolling.Powers()
        sets: list[np.ndarray] = []
        for run in grouped(raw):
            sets += shingle_sets([raw[i] for i in run], shingle, powers)
        # the size tells a class's own text from another one repeated under its id
        own = [len(v) == n for v, n in zip(sets, group["n_shingles"])]
        ids, parts, side = group["id"].to_numpy(), group["component"].to_numpy(), group["side"].to_numpy()
        left = [i for i in range(len(group)) if own[i] and side[i] == 0]
        right = [i for i in range(len(group)) if own[i] and side[i] == 1]
        links, joined = [], set()
        if left and right:
            values = np.concatenate([sets[i] for i in left])
            order = np.argsort(values, kind="stable")
            owner = np.repeat(np.arange(len(left)), [len(sets[i]) for i in left])[order]
            values = values[order]
            sizes = np.array([len(sets[i]) for i in left])
            for j in right:
                a, b = np.searchsorted(values, sets[j], "left"), np.searchsorted(values, sets[j], "right")
                n = b - a
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common = np.bincount(owner[at], minlength=len(left))
                near = DENOMINATOR * common >= NUMERATOR * (sizes + len(sets[j]) - common)
                for i in np.flatnonzero(near):
                    # one link to a component is as good as all
                    if parts[left[i]] != parts[j] and (i, parts[j]) not in joined:
                        joined.add((i, parts[j]))
                        links.append((min(ids[left[i]], ids[j]), max(ids[left[i]], ids[j])))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return settled(rows.groupBy("main", "at", "to").applyInPandas(compare, "a long, b long").distinct())


def near_duplicates(
    docs: DataFrame, shingle: int = 2, rows: int = ROWS, width: int = WIDTH, screen: float = SCREEN
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    every = cut_lineage(sketches(docs, shingle, rows, width))
    known = every.where("doc_id is not null and n_shingles > 0")
    first = F.min_by(F.struct("doc_id", "sig", "entries"), "doc_id")
    classes = settled(
        known.groupBy("h1", "h2", "n_shingles").agg(first.alias("first"))
        .select(F.col("first.doc_id").alias("id"), "h1", "h2", "n_shingles", "first.sig", "first.entries")
    )
    meeting = settled(buckets(classes, rows))
    hubs = settled(hub_pairs(meeting))
    labels = roots(confirmed(hubs, classes, docs, shingle, screen))
    still = settled(open_buckets(meeting, labels))
    pivots = settled(pivot_pairs(still).join(hubs, ["a", "b"], "left_anti"))
    labels = merged(labels, confirmed(pivots, classes, docs, shingle, screen))
    still = settled(open_buckets(still.select("key", "id"), labels))
    across = settled(pairs_across(still.where(F.col("size") <= SMALL)).join(hubs.union(pivots), ["a", "b"], "left_anti"))
    links = confirmed(across, classes, docs, shingle, screen)
    large = still.where(F.col("size") > SMALL)
    if not large.isEmpty():
        links = links.union(tile_links(large, classes, docs, shingle))
    labels = merged(labels, links)
    named = classes.join(labels, "id", "left").select(
        "h1", "h2", F.col("n_shingles").alias("n"), F.coalesce("component", "id").alias("component_id")
    )
    same = (every["h1"] == named["h1"]) & (every["h2"] == named["h2"]) & (every["n_shingles"] == named["n"])
    found = every.join(named, same, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
