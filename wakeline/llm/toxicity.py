"""Toxicity: a weighted finite-state pattern grammar over clauses.

Method. Words are mapped to symbols: insult, threat, target, negation, reported speech, other; punctuation ends a
clause. One small transducer follows each of these: has the clause an insult, a threat, a target, did a negation stand
close before the offence, is it reported speech. Their composition is one automaton (all reachable joint states, made
once); it reads a clause symbol by symbol and gives, at the clause's end, the kind of clause that matched. A document's
score is a logistic function of how many clauses of each kind it has, so a negated or reported offence weighs what the
labels say it weighs, and single words count only through the clauses they stand in.

Insults are a fixed seed list and the words and word beginnings that mark labelled toxic rows off from clean ones. Both
these and the clause weights are learnt from a bounded sample: up to ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled
training rows of least id hash. What is broadcast is the sample's ids and the grammar, both of bounded size. Scoring
reads whole texts of all rows and needs no shuffle.

Defined cases: null or empty text has no clause and gets the score of a text without offence; labels that are null or
whose document is missing are left out; of contradicting labels of one id the toxic one holds; without labels the seed
list and fixed weights decide; repeated rows are scored each; null ids are never trained on and count as not held out.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import id_remainder, least_hashed

SAMPLE_TOXIC = 2000
SAMPLE_CLEAN = 4000
#: A learnt pattern is in at least so many toxic rows, and so many times likelier there than in clean ones.
LEAST_ROWS = 5
LEAST_ODDS = 20.0
#: A word beginning is learnt only where so many different words share it; else the word itself is the pattern.
LEAST_WORDS = 4
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words whose symbol a worker remembers before it starts anew.
REMEMBERED = 100_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Fixed word lists of the grammar.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum pathetic worthless trash clown disgusting imbecile"
    " dumm trottel abschaum wertlos dreckskerl crétin abruti ordure minable imbécil estúpido basura inútil",
    THREAT: "kill murder destroy hurt beat burn hang töten umbringen vernichten tuer détruire frapper matar destruir golpear",
    TARGET: "you your yours they them he him she her people du dich ihr euch sie vous tu toi ils elles tú usted ustedes ellos",
    NEGATION: "not never no none without nicht nie kein keine ohne pas jamais sans aucun nunca sin ningún",
    REPORT: "said says called wrote reported claimed quoted sagte schrieb nannte behauptete dit écrit appelé dijo escribió llamó",
}


class Transducer:
    """States are any hashable values; ``step`` gives the next one, ``final`` what a clause ending here says."""

    def __init__(self, start, step, final) -> None:
        self.start, self.step, self.final = start, step, final

    def __mul__(self, other: Transducer) -> Transducer:
        """Composition: both read the same clause, the result says what both say."""
        return Transducer(
            (self.start, other.start),
            lambda s, x: (self.step(s[0], x), other.step(s[1], x)),
            lambda s: (*self.final(s[0]), *other.final(s[1])),
        )


def seen(symbol: int) -> Transducer:
    """Has the clause this symbol?"""
    return Transducer(False, lambda s, x: s or x == symbol, lambda s: (s,))


def negated(reach: int = 3) -> Transducer:
    """Does every offence stand at most ``reach`` words behind a negation? State: reach left, any so, any not so."""

    def step(s, x):
        left, inside, outside = s
        if x == NEGATION:
            return (reach, inside, outside)
        if x in (INSULT, THREAT):
            return (max(left - 1, 0), inside or left > 0, outside or left == 0)
        return (max(left - 1, 0), inside, outside)

    return Transducer((0, False, False), step, lambda s: (s[1] and not s[2],))


def reported() -> Transducer:
    """Does a word of reported speech stand before the first offence? State: 0 neither, 1 report first, 2 offence first."""

    def step(s, x):
        if s == 0:
            return 1 if x == REPORT else 2 if x in (INSULT, THREAT) else 0
        return s

    return Transducer(0, step, lambda s: (s == 1,))


def compiled(machine: Transducer, symbols: int = 6) -> tuple[list[list[int]], list[tuple]]:
    """Transition table and clause kinds of all states reachable from the start, which is state 0."""
    number, order, table = {machine.start: 0}, [machine.start], []
    for state in order:  # grows while it is walked through
        row = []
        for symbol in range(symbols):
            after = machine.step(state, symbol)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        table.append(row)
    return table, [machine.final(s) for s in order]


GRAMMAR = seen(INSULT) * seen(THREAT) * seen(TARGET) * negated() * reported()

#: Clause kinds that are counted: flags are insult, threat, target, negated, reported, nested by composition.
KINDS = ["insult", "threat", "targeted insult", "targeted threat", "negated", "reported"]


def kind_of(flags: tuple) -> int | None:
    insult, threat, target, no, said = flags
    if not (insult or threat):
        return None
    if no:
        return 4
    if said:
        return 5
    return (1 if threat and not insult else 0) + (2 if target else 0)


@dataclass
class Grammar:
    """Words and word beginnings of insults, and the weights of the clause kinds (the last one is the bias)."""

    words: set[str]
    beginnings: set[str]
    weights: list[float] = field(default_factory=lambda: [4.0, 4.0, 5.0, 6.0, 2.0, 2.0, -2.5])

    def __post_init__(self) -> None:
        self.fixed = {w: s for s, words in SEEDS.items() for w in words.split()}
        self.fixed |= dict.fromkeys(self.words, INSULT)
        self.lengths = sorted({len(b) for b in self.beginnings})
        self.table, finals = compiled(GRAMMAR)
        self.kinds = [kind_of(f) for f in finals]
        self.memory: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "beginnings": self.beginnings, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def symbol(self, word: str) -> int:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            low = word.lower()
            found = self.fixed.get(low, OTHER)
            if found == OTHER and any(low[:n] in self.beginnings for n in self.lengths):
                found = INSULT
            self.memory[word] = found
        return found

    def clauses(self, text: str) -> list[int]:
        """How many clauses of each kind the text has."""
        counts, state = [0] * len(KINDS), 0
        offence = (INSULT, THREAT)
        for clause in re.split(r"[.!?;:\n]+", text):
            symbols = [self.symbol(w) for w in WORDS.findall(clause)]
            if offence[0] in symbols or offence[1] in symbols:
                state = 0
                for s in symbols:
                    state = self.table[state][s]
                kind = self.kinds[state]
                if kind is not None:
                    counts[kind] += 1
        return counts

    def score(self, text: str) -> float:
        x = np.log1p(self.clauses(text))
        return float(1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30))))


WORDS = re.compile(r"[^\W\d_]+")


def patterns_of(text: str) -> set[str]:
    """What may be learnt from a text: its words (closed by a blank) and their beginnings."""
    words = {w.lower() for w in WORDS.findall(text)}
    return {w + " " for w in words} | {w[:n] for w in words for n in BEGINNINGS if len(w) > n}


def learnt_patterns(toxic: list[str], clean: list[str]) -> list[str]:
    """Patterns that cover the toxic texts, greedily: the most rows not yet covered, less what clean rows weigh against
    them, then the longest."""
    # numbers first: most patterns stand in too few rows to be worth a string
    numbers = np.concatenate([np.fromiter(map(hash, patterns_of(t)), np.int64) for t in toxic])
    number, times = np.unique(numbers, return_counts=True)
    often = set(number[times >= LEAST_ROWS].tolist())
    del numbers, number, times
    rows: dict[str, list[int]] = {}
    words: dict[str, set[int]] = {}
    for i, text in enumerate(toxic):
        for p in patterns_of(text):
            if hash(p) in often:
                rows.setdefault(p, []).append(i)
            if p.endswith(" "):
                for n in BEGINNINGS:
                    if len(p) - 1 > n and hash(p[:n]) in often and len(words.setdefault(p[:n], set())) < LEAST_WORDS:
                        words[p[:n]].add(hash(p))
    rows = {p: r for p, r in rows.items() if len(r) >= LEAST_ROWS and (p.endswith(" ") or len(words.get(p, ())) >= LEAST_WORDS)}
    del words
    against: Counter[str] = Counter()
    for text in clean:
        against.update(p for p in patterns_of(text) if p in rows)
    ratio = len(clean) / max(len(toxic), 1)
    good = {p: r for p, r in rows.items() if len(r) * ratio >= LEAST_ODDS * (against[p] + 0.5)}
    chosen, covered = [], Counter()
    # every toxic row should be met by two patterns, so that one lost word does not lose the row
    while good:
        gain = {p: sum(covered[i] < 2 for i in r) for p, r in good.items()}
        best = max(good, key=lambda p: (gain[p] - LEAST_ODDS * against[p], len(p), p))
        if gain[best] < LEAST_ROWS:
            break
        covered.update(good.pop(best))
        chosen.append(best)
        good = {p: r for p, r in good.items() if gain[p] >= LEAST_ROWS}
    return chosen


def clause_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> list[float]:
    """Logistic regression by Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge * len(x) / 100] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty @ w)
    return w.tolist()


def learn_grammar(rows: list[tuple[str, int]]) -> Grammar:
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    chosen = learnt_patterns(toxic, clean) if toxic and clean else []
    grammar = Grammar({p[:-1] for p in chosen if p.endswith(" ")}, {p for p in chosen if not p.endswith(" ")})
    if toxic and clean:
        counts = np.log1p(np.array([grammar.clauses(t) for t in itertools.chain(toxic, clean)], float))
        grammar.weights = clause_weights(counts, np.array([1] * len(toxic) + [0] * len(clean)))
    return grammar


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Grammar:
    """The grammar learnt from the labelled training rows; the learning runs in one task over a bounded sample."""
    known = labels.where((id_remainder(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).withColumn("h", F.xxhash64("doc_id"))
    ids = least_hashed(known, "y", F.when(F.col("y") == 1, toxic).otherwise(clean))
    texts = docs.select("doc_id", "text").where("text is not null")
    # a shuffle, not coalesce: all tasks read the texts, one takes the sample
    chosen = texts.join(F.broadcast(ids.select("doc_id", "y", "h")), "doc_id").repartition(1)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in zip(b["h"], b["doc_id"], b["text"], b["y"])]
        grammar = learn_grammar([(text, y) for _, _, text, y in sorted(rows)])
        yield pd.DataFrame({
            "part": ["word"] * len(grammar.words) + ["beginning"] * len(grammar.beginnings) + ["weight"] * len(grammar.weights),
            "value": [*sorted(grammar.words), *sorted(grammar.beginnings), *map(repr, grammar.weights)],
            "n": [*range(len(grammar.words) + len(grammar.beginnings)), *range(len(grammar.weights))],
        })

    found = chosen.mapInPandas(learn, "part string, value string, n int").toPandas().sort_values("n")
    part = {name: found.loc[found["part"] == name, "value"].tolist() for name in ("word", "beginning", "weight")}
    grammar = Grammar(set(part["word"]), set(part["beginning"]))
    if part["weight"]:
        grammar.weights = [float(w) for w in part["weight"]]
    return grammar


def scored(docs: DataFrame, grammar: Grammar, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with score, predicted and the counts of matched clauses by kind."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    # a text that is carried is not sent to the worker a second time
    text = "text" if "text" in carry else "_text"

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        weights = np.array(g.weights)
        for batch in batches:
            counts = np.array([g.clauses(t) if t else [0] * len(KINDS) for t in batch[text]], float).reshape(-1, len(KINDS))
            score = 1.0 / (1.0 + np.exp(-np.clip(np.log1p(counts) @ weights[:-1] + weights[-1], -30, 30)))
            yield batch[list(carry)].assign(score=score, predicted=(score >= 0.5).astype(np.int32), clauses=counts.astype(np.int64).tolist())

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    kind = f"{fields}, score double, predicted int, clauses array<long>"
    sent = docs.select(*carry) if text == "text" else docs.select(*carry, F.col("text").alias("_text"))
    return sent.mapInPandas(rate, kind)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 5) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
