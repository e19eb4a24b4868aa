"""SentencePiece encoding and decoding with N-best segmentation.

Method. A text's pieces form a lattice. A forward Viterbi pass gives every position the best score of reaching it; this
is the exact cost still to go for a search from the end, so a backward A-star search finds the best segmentations one
after the other without a detour. As every entry's estimate is exact and entries stand for different segmentations,
only the N best entries need be kept. The lattice falls into units that no piece crosses, as the vocabulary tells: a run of blanks
with letters or with other signs behind it (``Pieces.separable``). Each unit is searched once and remembered, and the N
best segmentations of a text are the N best sums over its units, found by the same kind of search. ``Encoder`` without
``runs`` leaves pieces with inner blanks out and takes words between single blanks as units.

The vocabulary file holds merge ranks, not probabilities; a piece of rank r gets the score of Zipf's law,
``-log(r + 2) - log(H)``. Characters without a piece are spelt in byte pieces, so decoding gives back every text.

The work is one pass over whole texts without a shuffle; a worker's memory is its remembered words (bounded by number
and by length) and one text. A word without blanks takes time in proportion to its length, whatever it repeats.
Defined cases: null or empty text has one segmentation without pieces, score 0; a literal U+2581 is spelt in bytes;
among equal scores within a unit the one with the smaller ids at the last difference seen from its end tends to come
first (``Pieces.best``), among those that differ in different units the one that differs earlier in the text; either
way the order depends on the text alone; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.word_memory import WordMemory

BLANK = "▁"
N_BEST = 3
#: Scores are multiples of this: sums are exact for words whose score is above -131,072 (over 10,000 pieces).
GRAIN = 2.0**-36
PIECE_IDS = itemgetter(2)
#: A run of blanks and the word behind it.
UNIT = " +[^ ]*"

Segmentation = tuple[float, tuple[int, ...]]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary: scores, ids and bytes of its pieces; without ``runs`` none with a blank behind its first character.

    A word begins with ``BLANK``; behind that its blanks are spaces, and ``BLANK`` is a character without a piece.
    Scores are multiples of ``GRAIN``, so sums of scores are exact in any order and ties are true ties.
    """

    def __init__(self, path: str, runs: bool = False) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        spread = math.log(sum(1.0 / (r + 2) for r in range(size)))

        def score(rank: float) -> float:
            return round((-math.log(rank + 2) - spread) / GRAIN) * GRAIN

        self.lowest = score(size)
        self.byte_id, self.bytes_of, self.found = [0] * 256, [b""] * size, {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or (BLANK in piece[1:] and not runs)):
                self.found[piece.replace(BLANK, " ")] = (i, score(-model.get_score(i) if piece != BLANK else 0))
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        self.longest = max(map(len, self.found))
        self.unit = self.separable()
        # the score of every piece, 0 for what only begins one: a search for longer pieces ends where there is neither
        self.scores = {p[:n]: 0.0 for p in self.found for n in range(1, len(p) + 1)}
        self.scores.update((p, s) for p, (_, s) in self.found.items())

    def separable(self) -> str:
        """Pattern of the parts of a text that no piece crosses.

        A part is a run of blanks with letters or with other signs behind it. Characters of pieces that mix the two
        count as other signs; if that is not enough to part them, a part is a run of blanks with the word behind it,
        and if pieces hold blanks behind other characters, the whole text.
        """
        behind = [p.lstrip(" ") for p in self.found]
        if any(" " in p for p in behind):
            return "(?s:.+)"
        mixed = re.compile(r"[^\W\d_][\W\d_]|[\W\d_][^\W\d_]")
        moved = "".join(sorted({re.escape(c) for p in behind if mixed.search(p) for c in p}))
        letter = re.compile(rf"[^\W\d_{moved}]")
        if any(0 < len(letter.findall(p)) < len(p) for p in behind):
            return UNIT
        return rf" *{letter.pattern}+| *(?:(?! )[\W\d_{moved}])+| +"

    def spelt(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in character.encode("utf-8", "replace"))

    def ending(self, word: str, at: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """The pieces of a word (with a space in front) that end at a position: start, score, ids."""
        out = []
        for i in range(max(0, at - self.longest), at):
            hit = self.found.get(word[i:at])
            if hit is not None:
                out.append((i, hit[1], (hit[0],)))
        if not out or out[-1][0] != at - 1:
            ids = self.spelt(word[at - 1])
            out.append((at - 1, self.lowest * len(ids), ids))
        return out

    def edges(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every end position the pieces that end there: start, score, ids. The word begins with its blank."""
        word = " " + word[1:]
        return [[], *(self.ending(word, at) for at in range(1, len(word) + 1))]

    def forward(self, word: str) -> tuple[list[float], list[float], list[int]]:
        """For every position of a word (with a space in front) the best and the second best score of reaching it, and
        where the best one's last piece starts."""
        n, get, longest = len(word), self.scores.get, self.longest
        first, second, start = [-math.inf] * (n + 1), [-math.inf] * (n + 1), [0] * (n + 1)
        first[0] = 0.0
        for i in range(n):
            one, two, j, single = first[i], second[i], i, False
            end = i + longest if i + longest < n else n
            while j < end:
                j += 1
                s = get(word[i:j])
                if s is None:
                    break
                if s:
                    total = one + s
                    if total > first[j]:
                        second[j] = first[j] if first[j] > two + s else two + s
                        first[j], start[j] = total, i
                    elif total > second[j]:
                        second[j] = total
                    if j == i + 1:
                        single = True
            if not single:
                s, j = self.lowest * len(self.spelt(word[i])), i + 1
                total = one + s
                if total > first[j]:
                    second[j] = first[j] if first[j] > two + s else two + s
                    first[j], start[j] = total, i
                elif total > second[j]:
                    second[j] = total
        return first, second, start

    def viterbi(self, word: str) -> tuple[float, float, tuple[int, ...]]:
        """Best score, second best score (minus infinity if there is none) and best ids of a word with its blank."""
        return self.unit_viterbi(" " + word[1:])

    def unit_viterbi(self, word: str) -> tuple[float, float, tuple[int, ...]]:
        """``viterbi`` for a part of a text as it stands."""
        first, second, start = self.forward(word)
        at = len(word)
        if second[at] == first[at]:
            return first[at], second[at], self.unit_best(word, 1)[0][1]  # the search settles ties
        parts = []
        while at:
            hit = self.found.get(word[start[at] : at])
            parts.append(self.spelt(word[at - 1]) if hit is None else (hit[0],))
            at = start[at]
        return first[-1], second[-1], tuple(i for part in reversed(parts) for i in part)

    def best(self, word: str, n: int) -> list[Segmentation]:
        """The ``n`` best segmentations of a word with its blank, best first."""
        return self.unit_best(" " + word[1:], n)

    def unit_best(self, word: str, n: int) -> list[Segmentation]:
        """``best`` for a part of a text as it stands.

        Equal totals are taken depth first from the word's end, smaller ids first, so a word of many ties is walked
        once per segmentation.
        """
        ahead = self.forward(word)[0]  # best score from the start to each position
        # entries: minus the exact total, when it was added (later first), position, score and ids of the suffix
        frontier: list[tuple[float, int, int, float, tuple]] = [(-ahead[-1], 0, len(word), 0.0, ())]
        out: list[Segmentation] = []
        added = 0
        while frontier and len(out) < n:
            _, _, at, behind, ids = heapq.heappop(frontier)
            if at == 0:
                out.append((behind, flat(ids)))
                continue
            for i, s, piece in sorted(self.ending(word, at), key=PIECE_IDS, reverse=True):
                added -= 1
                heapq.heappush(frontier, (-(ahead[i] + s + behind), added, i, s + behind, (piece, ids)))
            if len(frontier) > 4 * n:
                frontier = heapq.nsmallest(n - len(out), frontier)
        return out

    def decode(self, ids) -> str:
        """The text of a segmentation; its leading blank is not part of it."""
        return self.spelling(ids)[1:]

    def spelling(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def flat(ids: tuple) -> tuple[int, ...]:
    """The ids of linked pieces, front to back."""
    out: list[int] = []
    while ids:
        out.extend(ids[0])
        ids = ids[1]
    return tuple(out)


class Encoder:
    """Whole texts by remembered words: best ids, best score, cost of the second choice, does decoding give it back."""

    def __init__(self, path: str, n: int, runs: bool = False) -> None:
        self.pieces, self.n = Pieces(path, runs), n
        self.unit = re.compile(self.pieces.unit if runs else " [^ ]*")
        self.memory = WordMemory(self.learn, 3)

    def units(self, text: str) -> list[str]:
        """The parts of a text, with a blank in front, that no piece crosses."""
        return self.unit.findall(" " + text)

    def learn(self, words: list[str]) -> Iterator[tuple]:
        for word in words:
            score, second, ids = self.pieces.unit_viterbi(word)
            yield ids, score, score - second, self.pieces.spelling(ids) == word

    def ranked(self, words: list[str], number: np.ndarray) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """The N best totals, each with the places whose word takes another than its best choice, and its ids."""
        score, step, _ = self.memory.facts
        step = step[number]
        near = np.argpartition(step, self.n - 2)[: self.n - 1] if 1 < self.n <= len(step) else np.arange(len(step))
        # only the words whose second choice costs least can differ in the N best
        second = sorted((step[k], int(k)) for k in near if np.isfinite(step[k]))
        choices = {k: self.pieces.unit_best(words[k], self.n) for _, k in second}
        best = float(score[number].sum())
        open_: list[tuple[float, tuple, int]] = [(0.0, (), 0)]  # cost, (place, choice) pairs, first word still to change
        out: list[tuple[float, dict[int, tuple[int, ...]]]] = []
        while open_ and len(out) < self.n:
            cost, changed, at = heapq.heappop(open_)
            out.append((best - cost, {k: choices[k][c][1] for k, c in changed}))
            if changed:
                k, c = changed[-1]
                if c + 1 < len(choices[k]):
                    more = choices[k][c][0] - choices[k][c + 1][0]
                    heapq.heappush(open_, (cost + more, (*changed[:-1], (k, c + 1)), at))
            for m in range(at, len(second)):
                heapq.heappush(open_, (cost + second[m][0], (*changed, (second[m][1], 1)), m + 1))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, list[tuple[float, dict[int, tuple[int, ...]]]], bool]:
        """Best ids, their number in each word, the N best totals with the words that differ, and whether decoding
        gives the text back."""
        if not text:
            return np.empty(0, np.uint32), np.empty(0, np.int64), [(0.0, {})], True
        words = self.units(text)
        number = self.memory.numbers(words)
        ranked = self.ranked(words, number)
        right = bool(self.memory.facts[2, number].all()) and all(
            self.pieces.spelling(ids) == words[k] for _, changed in ranked for k, ids in changed.items()
        )
        ids, length = self.memory.ids(number)
        return ids, length, ranked, right


_loaded: dict[tuple[str, int], Encoder] = {}


def worker_encoder(path: str, n: int) -> Encoder:
    if (path, n) not in _loaded:
        _loaded[path, n] = Encoder(path, n, runs=True)
    return _loaded[path, n]


def segment(docs: DataFrame, vocabulary: str | None = None, n: int = N_BEST, with_ids: bool = False) -> DataFrame:
    """doc_id, piece count and checksum of the best ids, the N best scores, and whether decoding gave the text back.

    With ``with_ids`` the N best id lists follow.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(vocabulary or default_vocabulary(), n)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"].fillna("")):
                ids, length, ranked, right = encoder.encode(text)
                row = [doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [s for s, _ in ranked], right]
                if with_ids:
                    words = np.split(ids, np.cumsum(length)[:-1]) if len(length) else []
                    row.append([[int(i) for k, word in enumerate(words) for i in changed.get(k, word)] for _, changed in ranked])
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)
        encoder.memory.rest()

    names = ["doc_id", "n_pieces", "ids_crc32", "scores", "round_trip"] + ["ids"] * with_ids
    kind = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, round_trip boolean"
    kind += ", ids array<array<long>>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(encode, kind)
