"""Suffix-array dedup: removes every byte of a long string that also starts earlier in the corpus.

Method: a logarithmic index family over a sparse suffix array. Every window of ``LENGTH`` bytes chooses one suffix, the
one that starts at its least ``GRAM``-byte gram by hash (the leftmost of equals), so equal windows choose suffixes
that agree. Neighbouring windows with one chosen suffix form an entry: the fingerprint of the suffix's first bytes,
the fingerprint of all bytes its windows span, and where it stands. Entries are dealt out by the suffix fingerprint. In
each shard they arrive in document order and in batches; a batch is sorted into a suffix array (by fingerprint),
merge-scanned against the levels held so far, and pushed as a level of its own; equal-sized levels merge, so a shard of
n entries holds at most log(n) levels. An entry found in an older level, or earlier in its batch, is covered whole.
Entries whose suffix has other surroundings elsewhere match only in part: these are dealt out once more with their
bytes, and their single windows pass through the same index family. A gram that is counted with very many different
surroundings is not dealt out as such: its windows leave one by one where the text is read, each dealt out by its own
fingerprint, so that they spread over all shards and equal ones still meet. All coverage is decided on the input, never
on what is left.

Scale. Every map task keeps the first of equal entries and settles the others on the spot, so a passage that a third
of all documents share sends one entry per task and batch, not one per document. Entries are a fiftieth of the bytes.
Texts are dealt out by document once and that exchange serves all three readings. There is no pair of documents
anywhere. 128 fingerprint bits decide equality.

Defined cases: null text is empty; texts shorter than ``LENGTH`` bytes lose nothing; rows repeated under one id with
one text are one document and both get its result, those with other texts follow one another by text hash; null ids
come last; a text may be longer than a batch; extra columns are carried only when named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm import rolling

LENGTH = 100
GRAM = 24
#: Bytes of text handled at a time inside a task; longer texts are read in pieces that overlap by a window.
PIECE = 1 << 20
#: Entries per batch of the index family.
BATCH = 1 << 16
#: From so many different surroundings on, the windows of a gram are dealt out one by one.
MANY = 1 << 16
LAST = 2**63 - 1

ENTRY = "k1 long, k2 long, key long, dup int, start long, count int, covered boolean"


def pieces(texts: list[bytes], length: int, most: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, offset, bytes) of about ``most`` bytes whose windows are those of the texts, each once."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), most):
            part = text[at : at + most + length - 1]
            if group and size + len(part) > most:
                yield group
                group, size = [], 0
            group.append((row, at, part))
            size += len(part)
    if group:
        yield group


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    low, span = values, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def chosen_suffixes(group: list[tuple[int, int, bytes]], length: int, gram: int, powers: rolling.Powers, common: np.ndarray | None = None):
    """Entries of a group: row, start in the text, number of windows, suffix and surroundings fingerprints.

    The windows of ``common`` suffixes are entries of their own, with the window's and the suffix's fingerprint.
    """
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    sizes = np.array([len(p) for _, _, p in group], np.int64)
    ends = np.cumsum(sizes)
    text = rolling.Text(data, powers)
    at = np.arange(len(data) - gram + 1)
    grams = text.of(at, at + gram)
    place = np.uint64((1 << 24) - 1)
    window = sliding_min((grams & ~place) | at.astype(np.uint64), length - gram + 1)
    suffix = (window & place).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int64)
    np.add.at(valid, ends - sizes, 1)
    np.add.at(valid, ends - length + 1, -1)
    valid = np.cumsum(valid)[: len(suffix)] > 0
    suffix[~valid] = -1
    edge = np.flatnonzero(np.diff(suffix)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(suffix)]])
    first, last = first[suffix[first] >= 0], last[suffix[first] >= 0]
    single = np.zeros(len(first), bool)
    if common is not None and len(common):
        split = np.isin(grams[suffix[first]], common)
        count = (last - first)[split]
        each = np.repeat(first[split] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        single = np.concatenate([single[~split], np.ones(len(each), bool)])
        first, last = np.concatenate([first[~split], each]), np.concatenate([last[~split], each + 1])
    owner = np.searchsorted(ends, first, side="right")
    # two texts may choose suffixes in a row only across an invalid stretch, so a run lies in one text
    k2 = rolling.pairs(text.of(first, last - 1 + length), (suffix[first] - first).astype(np.uint64))
    k1 = grams[suffix[first]]
    k1[single], k2[single] = text.of(first[single], first[single] + length), k1[single]
    rows = np.array([r for r, _, _ in group], np.int64)[owner]
    start = first - (ends - sizes)[owner] + np.array([o for _, o, _ in group], np.int64)[owner]
    return rows, start, last - first, k1, k2


def settled_here(frame: pd.DataFrame) -> pd.DataFrame:
    """Mark all but the first of equal entries as covered, and deal those out by place instead of by suffix."""
    order = np.lexsort((frame["start"], frame["dup"], frame["key"], frame["k2"], frame["k1"]))
    k1, k2 = frame["k1"].to_numpy()[order], frame["k2"].to_numpy()[order]
    again = np.zeros(len(frame), bool)
    again[order[1:]] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
    frame["covered"] = again
    spread = rolling.pairs(frame["key"].to_numpy().astype(np.uint64), frame["start"].to_numpy().astype(np.uint64))
    frame["k1"] = np.where(again, spread.astype(np.int64), frame["k1"])
    return frame


def common_grams(docs: DataFrame, length: int, gram: int, many: int) -> np.ndarray:
    """Chosen grams with at least ``many`` different surroundings, counted by the megabyte and where they vary there.

    The count only says how windows are dealt out; whatever it says, the result is the same.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = rolling.Powers()
        for batch in batches:
            for group in pieces([t.encode() for t in batch["text"]], length):
                _, _, _, k1, k2 = chosen_suffixes(group, length, gram, powers)
                order = np.lexsort((k2, k1))
                k1, k2 = k1[order], k2[order]
                new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
                found, n = np.unique(k1[new], return_counts=True)
                yield pd.DataFrame({"k1": found[n > 1].astype(np.int64), "n": n[n > 1]})

    counted = docs.select("text").mapInPandas(count, "k1 long, n long").groupBy("k1").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= many).select("k1").toPandas()["k1"].to_numpy(np.int64).astype(np.uint64)


def entries(docs: DataFrame, length: int, gram: int, common: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = rolling.Powers()
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            keys, dups = batch["key"].to_numpy(), batch["dup"].to_numpy()
            for group in pieces(texts, length):
                rows, start, count, k1, k2 = chosen_suffixes(group, length, gram, powers, shared.value)
                yield settled_here(pd.DataFrame({
                    "k1": k1.astype(np.int64), "k2": k2.astype(np.int64), "key": keys[rows], "dup": dups[rows],
                    "start": start, "count": count.astype(np.int32),
                }))

    return docs.mapInPandas(read, ENTRY)


class Level:
    """Entries sorted by their joint fingerprint."""

    def __init__(self, joint: np.ndarray, k1: np.ndarray, held: np.ndarray, rank: int = 0) -> None:
        self.joint, self.k1, self.held, self.rank = joint, k1, held, rank

    def has(self, joint: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """Scan a batch sorted by joint fingerprint against this level."""
        at = np.searchsorted(self.joint, joint)
        inside = at < len(self.joint)
        at = np.minimum(at, len(self.joint) - 1)
        return inside & (self.joint[at] == joint) & (self.k1[at] == k1)

    def merged(self, other: Level) -> Level:
        joint = np.concatenate([self.joint, other.joint])
        order = np.argsort(joint, kind="stable")
        k1, held = np.concatenate([self.k1, other.k1]), np.concatenate([self.held, other.held])
        return Level(joint[order], k1[order], held[order], self.rank + 1)


class IndexFamily:
    """Levels of geometrically growing size; ``push`` tells which entries of a batch stood there before."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def push(self, k1: np.ndarray, k2: np.ndarray, held: np.ndarray) -> np.ndarray:
        joint = rolling.pairs(k1, k2)
        order = np.argsort(joint, kind="stable")
        sorted_joint, sorted_k1 = joint[order], k1[order]
        old = np.zeros(len(k1), bool)
        old[1:] = (sorted_joint[1:] == sorted_joint[:-1]) & (sorted_k1[1:] == sorted_k1[:-1])
        for level in self.levels:
            old |= level.has(sorted_joint, sorted_k1)
        fresh = ~old
        if fresh.any():
            self.levels.append(Level(sorted_joint[fresh], sorted_k1[fresh], held[order][fresh]))
        while len(self.levels) > 1 and self.levels[-1].rank == self.levels[-2].rank:
            newer, older = self.levels.pop(), self.levels.pop()
            self.levels.append(older.merged(newer))
        out = np.zeros(len(k1), bool)
        out[order] = old
        return out

    def varied(self) -> np.ndarray:
        """What is held for suffixes that have several surroundings."""
        if not self.levels:
            return np.empty((0, 5), np.int64)
        k1 = np.concatenate([level.k1 for level in self.levels])
        held = np.concatenate([level.held for level in self.levels])
        order = np.argsort(k1, kind="stable")
        same = k1[order][1:] == k1[order][:-1]
        some = np.zeros(len(k1), bool)
        some[1:] |= same
        some[:-1] |= same
        return held[order][some]


def batched(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    waiting: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size >= rows:
            yield pd.concat(waiting, ignore_index=True)
            waiting, size = [], 0
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def scanned(found: DataFrame) -> DataFrame:
    """Run the index family over each shard: covered spans, and the first entries of suffixes that vary."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = IndexFamily()
        columns = ["key", "dup", "start", "count", "k1"]
        for batch in batched(batches, BATCH):
            covered = batch["covered"].to_numpy().copy()
            open_ = batch[~covered]
            k1, k2 = (open_[c].to_numpy().astype(np.uint64) for c in ("k1", "k2"))
            covered[~covered] = family.push(k1, k2, open_[columns].to_numpy(np.int64))
            yield batch.loc[covered, columns].assign(covered=True)
        yield pd.DataFrame(family.varied(), columns=columns).assign(covered=False)

    dealt = found.repartition("k1").sortWithinPartitions("key", "dup", "start")
    return dealt.mapInPandas(scan, "key long, dup int, start long, count int, k1 long, covered boolean")


def surroundings(docs: DataFrame, varied: DataFrame, length: int) -> DataFrame:
    """The entries that vary with the bytes their windows span."""
    wanted = varied.groupBy(F.col("key").alias("at")).agg(F.collect_list(F.struct("dup", "start", "count", "k1")).alias("marks"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, dup, text, marks in zip(batch["key"], batch["dup"], batch["text"], batch["marks"]):
                raw = text.encode()
                rows += [
                    (m["k1"], key, dup, m["start"], m["count"], raw[m["start"] : m["start"] + m["count"] - 1 + length])
                    for m in marks if m["dup"] == dup
                ]
            yield pd.DataFrame(rows, columns=["k1", "key", "dup", "start", "count", "bytes"])

    joined = docs.join(wanted, F.col("key") == F.col("at")).drop("at")
    return joined.mapInPandas(read, "k1 long, key long, dup int, start long, count int, bytes binary")


def scanned_windows(entries: DataFrame, length: int) -> DataFrame:
    """Run the index family over the single windows of each shard: covered spans."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, powers = IndexFamily(), rolling.Powers()
        for batch in batched(batches, BATCH // 32):
            count = batch["count"].to_numpy(np.int64)
            sizes = count - 1 + length
            seen = rolling.Text(np.frombuffer(b"".join(batch["bytes"]), np.uint8), powers)
            entry = np.repeat(np.arange(len(batch)), count)
            within = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(sizes) - sizes, count) + within
            k1 = batch["k1"].to_numpy().astype(np.uint64)[entry]
            old = family.push(k1, seen.of(at, at + length), np.empty((len(at), 0), np.int64))
            # neighbouring covered windows of an entry leave as one span
            head = old & ~np.concatenate([[False], old[:-1] & (entry[1:] == entry[:-1])])
            tail = old & ~np.concatenate([old[1:] & (entry[1:] == entry[:-1]), [False]])
            first, last = np.flatnonzero(head), np.flatnonzero(tail)
            owner = entry[first]
            yield pd.DataFrame({
                "key": batch["key"].to_numpy()[owner], "dup": batch["dup"].to_numpy()[owner],
                "start": batch["start"].to_numpy()[owner] + within[first], "count": (last - first + 1).astype(np.int32),
            })

    dealt = entries.repartition("k1").sortWithinPartitions("key", "dup", "start")
    return dealt.mapInPandas(scan, "key long, dup int, start long, count int")


def runs_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans; touching spans are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate([[True], start[1:] > end[:-1]])
    tail = np.concatenate([head[1:], [True]])
    return start[head], end[tail]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``carry``, n_bytes, n_removed, n_spans, kept_sha256, kept_text and the spans.

    ``kept_text`` leaves out a character of which only a part is left.
    """
    base = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text"))
    texts = base.select("text")
    base = base.withColumn("key", F.coalesce("doc_id", F.lit(LAST)))
    by_text = Window.partitionBy("key").orderBy("th")
    base = base.withColumn("th", F.xxhash64("text")).withColumns({
        "dup": F.dense_rank().over(by_text), "again": F.coalesce(F.lag("th").over(by_text) == F.col("th"), F.lit(False))
    })
    # all columns go into every reading of the texts: with equal columns the readings share one exchange
    once = base.where("not again")
    found = scanned(entries(once, length, gram, common_grams(texts, length, gram, MANY)))
    partial = scanned_windows(surroundings(once, found.where("not covered"), length), length)
    spans = found.where("covered").select("key", "dup", "start", "count").union(partial)
    per_text = spans.groupBy(F.col("key").alias("at")).agg(F.collect_list(F.struct("dup", "start", "count")).alias("marks"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select("doc_id", *carry).schema)
    kind += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, removed array<array<long>>"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, dup, marks in zip(batch["text"], batch["dup"], batch["marks"]):
                raw = text.encode()
                mine = np.empty((0, 2), np.int64)
                if marks is not None:
                    mine = np.array([(m["start"], m["count"]) for m in marks if m["dup"] == dup], np.int64).reshape(-1, 2)
                if len(mine):
                    a, b = runs_of(mine[:, 0], mine[:, 0] + mine[:, 1] - 1 + length)
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                    removed = np.stack([a, b], axis=1).tolist()
                else:
                    kept, removed = raw, []
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((len(raw), len(raw) - len(kept), len(removed), digest, kept.decode("utf-8", "ignore"), removed))
            out = batch[["doc_id", *carry]].reset_index(drop=True)
            extra = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "removed"])
            yield pd.concat([out, extra], axis=1)

    joined = base.join(per_text, F.col("key") == F.col("at"), "left")
    return joined.select("doc_id", *carry, "text", "dup", "marks").mapInPandas(cut, kind)
