"""Packing: shortest-pack-first over the length histogram, joined back to the documents by rank.

Method. A document's ids end with an end mark and are cut into pieces of at most ``CONTEXT``. Only the histogram of
piece lengths (at most ``CONTEXT`` rows, whatever the corpus) reaches the driver. Lengths are placed longest first:
all pieces of a length go to the packs that are shortest so far and still have room, as many at a time as such packs
exist, and open new packs where none has room. What results is a list of patterns with counts. Every slot of a pattern
owns a range of ranks of its length; a piece finds its sequence and offset by joining its rank among the pieces of its
length with those ranges. The slots are broadcast: their number depends on ``CONTEXT``, not on the corpus.

Ranks need no window over a whole length: pieces are counted per (length, hash bucket), the counts are summed up over
the buckets, and only the rows of one bucket are numbered together. Long texts are tokenised word by word, so memory
is that of one text; token ids never leave the task unless asked for.

Defined cases: null or empty text is the end mark alone; rows repeated under one id are packed each on their own; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import shuffle_partitions
from wakeline.llm.word_memory import WordMemory
from wakeline.session import cut_lineage

CONTEXT = 2048
END_MARK = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How the vocabulary splits a lower-cased word of these characters before it looks for pieces.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The opening of the vocabulary's marks, which stand above that splitting.
MARK = "<|"
#: Fixed value: pieces that end a part.
PART_END = "</w>"


class WordTokenizer:
    """Ids of whole texts from remembered ids of their words; exact, as the vocabulary splits at white space first.

    New words of plain characters are split into the vocabulary's own parts, and the parts of many words go through its
    pieces as one text; the ids of a word end where its last part does. Other new words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.of_parts = Tokenizer(self.tokenizer.model)
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_of])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for piece, k in vocabulary.items() if piece.endswith(PART_END)]] = True
        self.memory = WordMemory(self.learn)

    def learn(self, words: list[str]) -> Iterator[tuple[list[int]]]:
        for i in range(0, len(words), 4096):
            yield from self._learn(words[i : i + 4096])

    def _learn(self, words: list[str]) -> list[tuple[list[int]]]:
        out: list = [None] * len(words)
        parts, upto, plain, other = [], [], [], []
        for k, word in enumerate(words):
            if word.isascii() and word.isalpha():
                parts.append(word.lower())
            elif PLAIN.fullmatch(word) and MARK not in word:
                parts += PARTS.findall(word.lower())
            else:
                other.append(k)
                continue
            plain.append(k)
            upto.append(len(parts))
        if parts:
            ids = self.of_parts.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids
            end = np.flatnonzero(self.ends[ids])[np.array(upto) - 1] + 1
            start = 0
            for k, stop in zip(plain, end.tolist()):
                out[k] = (ids[start:stop],)
                start = stop
        if other:
            found = self.tokenizer.encode_batch_fast([words[k] for k in other], add_special_tokens=False)
            for k, one in zip(other, found):
                out[k] = (one.ids,)
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, end mark included."""
        for text in texts:
            ids, _ = self.memory.ids(self.memory.numbers(text.replace("\n", " ").split(" ")))
            yield np.append(ids, np.uint32(END_MARK))


_loaded: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, vocabulary: str | None, context: int, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and its ids if asked for."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = worker_tokenizer(vocabulary or default_vocabulary())
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], tokenizer.encode(batch["text"].fillna("").tolist())):
                for start in range(0, len(ids), context):
                    part = ids[start : start + context]
                    row = (doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids))
                    rows.append((*row, part.tolist()) if with_ids else row)
            yield pd.DataFrame(rows, columns=names)
        tokenizer.memory.rest()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, kind)


def patterns(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[list[int], int]]:
    """(lengths of a pack in order, number of such packs): shortest pack first, lengths longest first."""
    open_: list[tuple[int, int, list[int], int]] = []  # filled, number of the entry, lengths, count
    closed: list[tuple[list[int], int]] = []
    entry = 0

    def push(filled: int, lengths: list[int], count: int) -> None:
        nonlocal entry
        entry += 1
        if filled == context:
            closed.append((lengths, count))
        else:
            heapq.heappush(open_, (filled, entry, lengths, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_ and open_[0][0] + length <= context:
                filled, _, lengths, count = heapq.heappop(open_)
                taken = min(left, count)
                if taken < count:
                    push(filled, lengths, count - taken)
                push(filled + length, [*lengths, length], taken)
            else:
                taken = left
                push(length, [length], taken)
            left -= taken
    return closed + [(lengths, count) for _, _, lengths, count in sorted(open_, key=lambda x: x[:2])]


def slots(histogram: dict[int, int], context: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) of every slot of every pattern."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, count in patterns(histogram, context):
        offset = 0
        for length in lengths:
            first = rank.get(length, 0)
            out.append((length, first, count, sequence, offset))
            rank[length] = first + count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place there, and its sequence and offset in the packed corpus."""
    cut = cut_lineage(pieces(docs, vocabulary, context, with_ids))
    spark = docs.sparkSession
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(4 * shuffle_partitions(spark))))
    counts = cut_lineage(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    kind = "length long, first long, count long, sequence long, offset long"
    placed = spark.createDataFrame(slots(histogram, context), kind)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = bucketed.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at")).drop("before", "at", "bucket")
    here = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    joined = ranked.join(F.broadcast(placed.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & here)
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", *["ids"] * with_ids,
    )
