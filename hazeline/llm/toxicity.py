"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns the words of a clause into symbols. Four transducers are composed into one machine:
`negation` marks insults and threats shortly behind a negation, `reporting` those behind a verb of
saying, `target` those next to an addressed person, `threat` recognises an intention followed by a
harming verb. Each path ends in counted events; a clause counts its events, a document the clauses,
and learned weights turn the counts into a probability. Words outside of a matched clause count
nothing. The lexicon's insults are a few fixed words and what the labels teach: words and word
stems that stand almost only in toxic documents, in varied surroundings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.quality import labelled
from hazeline.session import durable

# The symbols' closed word classes, with some common insults and verbs of harm.
INSULTS = frozenset("idiot idiots moron morons stupid imbecile imbeciles loser losers scum trash pathetic worthless disgusting clown bastard bitch crap dumb".split())
HARM = frozenset("kill hurt destroy beat stab shoot punish burn crush strangle murder".split())
INTENT = frozenset("will shall gonna going must should want ll".split())
TARGET = frozenset("you your u yourself he she they him her them his their these those this that vous tu te toi ihr du dich dir sie ustedes usted ellos".split())
NEGATION = frozenset("not no never isn't aren't wasn't don't doesn't didn't won't cannot can't neither nor ne pas jamais nicht kein keine nie ni nunca".split())
REPORT = frozenset("said says say wrote writes write called calls claimed claims reported quoted quote alleged dit écrit sagte schrieb dijo escribió".split())

#: Symbols: other, insult, harm, intent, target, negation, report.
OTHER, INSULT, HARMING, INTENDS, TARGETS, NEGATES, REPORTS = range(7)
#: Events: insults meant as such, those of them at a target, negated and reported insults, threats,
#: negated or reported threats.
EVENTS = ("insult", "targeted", "negated", "reported", "threat", "mild_threat")
#: What the grammar thinks of its events before it sees labels, and after how many documents labels weigh alike.
PRIOR = np.array([6.0, 1.0, 2.0, 2.0, 6.0, 1.0])
PRIOR_WEIGHT = 1.0

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NEAR = 3


@dataclass(frozen=True)
class Transducer:
    """Deterministic: table[state][symbol] = (next state, output symbol)."""

    table: tuple[tuple[tuple[int, int], ...], ...]

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: the other machine reads what this one writes; only reachable pairs of states."""
        number, queue, rows = {(0, 0): 0}, [(0, 0)], []
        while len(rows) < len(queue):
            a, b = queue[len(rows)]
            row = []
            for after, symbol in self.table[a]:
                last, out = other.table[b][symbol]
                if (after, last) not in number:
                    number[after, last] = len(queue)
                    queue.append((after, last))
                row.append((number[after, last], out))
            rows.append(tuple(row))
        return Transducer(tuple(rows))


#: Written symbols are read symbols plus marks: 8 negated, 16 reported, 32 targeted, 64 intended.
MARKS = 128


def _within(reach: int, opens: int, mark: int, what: tuple[int, ...]) -> Transducer:
    """Marks symbols of the kinds `what` at most `reach` words behind a symbol `opens` (0: to the clause's end)."""
    states = max(reach, 1) + 1
    rows = []
    for state in range(states):
        row = []
        for symbol in range(MARKS):
            kind = symbol & 7
            left = max(reach, 1) if kind == opens else (state if reach == 0 else max(0, state - 1))
            row.append((left, symbol | mark if state and kind in what else symbol))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def grammar() -> Transducer:
    acts = (INSULT, HARMING)
    return (_within(NEAR, NEGATES, 8, acts).then(_within(0, REPORTS, 16, acts))
            .then(_within(NEAR, TARGETS, 32, acts)).then(_within(4, INTENDS, 64, (HARMING,))))


@dataclass
class Lexicon:
    """Words and stems (at least three letters) that count as insults, beside the fixed ones."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()

    def symbol(self, word: str) -> int:
        if word in INSULTS or word in self.words or any(word.startswith(word[:n]) and word[:n] in self.stems for n in self._sizes()):
            return INSULT
        for words, symbol in ((HARM, HARMING), (NEGATION, NEGATES), (INTENT, INTENDS), (TARGET, TARGETS), (REPORT, REPORTS)):
            if word in words:
                return symbol
        return OTHER

    def _sizes(self) -> tuple[int, ...]:
        if not hasattr(self, "_lengths"):
            self._lengths = tuple(sorted({len(s) for s in self.stems}))
        return self._lengths


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -3.0


class Matcher:
    """The composed machine run over the clauses of a text."""

    def __init__(self, lexicon: Lexicon, known: int = 200_000) -> None:
        self.lexicon, self.machine, self.limit = lexicon, grammar().table, known
        self.symbols: dict[str, int] = {}

    def _symbol(self, word: str) -> int:
        found = self.symbols.get(word)
        if found is None:
            if len(self.symbols) >= self.limit:
                self.symbols.clear()
            found = self.symbols[word] = self.lexicon.symbol(word)
        return found

    def events(self, text: str) -> np.ndarray:
        """Number of each event; a clause without an insult or a harming verb has none."""
        counts, lower = np.zeros(len(EVENTS)), text.lower()
        words = set(_WORD.findall(lower))
        hot = [w for w in words if self._symbol(w) in (INSULT, HARMING)]
        if not hot:
            return counts
        for clause in _CLAUSE.split(lower):
            line = [self._symbol(w) for w in _WORD.findall(clause)]
            if INSULT in line or HARMING in line:
                self._clause(line, counts)
        return counts

    def _clause(self, line: list[int], counts: np.ndarray) -> None:
        state, addressed = 0, [i for i, s in enumerate(line) if s == TARGETS]
        for i, symbol in enumerate(line):
            state, out = self.machine[state][symbol]
            kind = out & 7
            if kind not in (INSULT, HARMING):
                continue
            behind = any(0 < j - i <= NEAR for j in addressed)
            if kind == INSULT:
                meant = not out & 24
                counts[0 if meant else 2 if out & 8 else 3] += 1
                counts[1] += bool(meant and (out & 32 or behind))
            elif out & 64 and behind:
                counts[5 if out & 24 else 4] += 1


def features(counts: np.ndarray) -> np.ndarray:
    """Events saturate: the first one says most."""
    return np.minimum(1.0, counts) + 0.3 * np.log1p(np.maximum(0, counts - 1))


def probability(model: Model, counts: np.ndarray) -> float:
    z = float(features(counts) @ model.weights + model.bias)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# --- learning ---------------------------------------------------------------------------------

LONGEST_STEM = 7


def terms(text: str) -> set[str]:
    """The words of a text, and as `stem*` the beginnings of its longer words."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in range(3, LONGEST_STEM + 1) if len(w) > n}


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def rows() -> pd.DataFrame:
        seen = list(both[0].keys() | both[1].keys())
        out = pd.DataFrame({"term": seen, "toxic": [both[1][t] for t in seen], "clean": [both[0][t] for t in seen]})
        both[0].clear(), both[1].clear()
        return out

    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"]):
            both[int(label)].update(terms(text))
        if len(both[0]) + len(both[1]) > 200_000:
            yield rows()
    if both[0] or both[1]:
        yield rows()


def _surroundings(wanted: frozenset[str]):
    """(term, hash of the words before and behind) of the wanted terms."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for text in pdf["text"]:
                words = _WORD.findall(text.lower())
                for i, w in enumerate(words):
                    own = [t for t in (w, *(w[:n] + "*" for n in range(3, min(LONGEST_STEM, len(w) - 1) + 1))) if t in wanted]
                    if own:
                        around = (words[i - 1] if i else "") + " " + (words[i + 1] if i + 1 < len(words) else "")
                        out.update((t, around, w) for t in own)
            if out:
                yield pd.DataFrame(list(out), columns=["term", "around", "word"])

    return run


def select_terms(table: list[tuple[str, int, int, int, int]]) -> Lexicon:
    """From (term, toxic, clean, surroundings, words): the longest stem that keeps a stem's documents, else the word.

    A term is dropped where a longer one covers at least nine tenths of its documents, and where a
    shorter kept stem covers it. Terms seen in few surroundings (copies of one text) were left out before.
    """
    stats = {t: (toxic, words) for t, toxic, _, _, words in table}

    def longer(term: str) -> list[str]:
        stem = term[:-1]
        return [t for t in stats if t != term and t.rstrip("*").startswith(stem) and len(t.rstrip("*")) >= len(stem) and (len(t.rstrip("*")) > len(stem) or not t.endswith("*"))]

    keep = []
    for term, (toxic, words) in stats.items():
        if term.endswith("*"):
            if words < 3 or any(stats[t][0] >= 0.9 * toxic for t in longer(term)):
                continue
        keep.append(term)
    stems = frozenset(t[:-1] for t in keep if t.endswith("*"))
    stems = frozenset(s for s in stems if not any(s[:n] in stems for n in range(3, len(s))))
    words = frozenset(t for t in keep if not t.endswith("*") and not any(t[:n] in stems for n in range(3, len(t))))
    return Lexicon(words, stems)


def learn_lexicon(sample: DataFrame, evidence: float = 11.0, most: int = 5000) -> Lexicon:
    """Insults of a labelled sample (text, label).

    A term needs a log-likelihood gain of `evidence` over the base rate, nine toxic documents in ten,
    and as many different surroundings as half its toxic documents (four at least), so that words of
    copied texts do not pass. `most` bounds the candidates, the strongest first.
    """
    size = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in size}
    if not n.get(0) or not n.get(1):
        return Lexicon()
    base = n[1] / (n[0] + n[1])
    counted = sample.mapInPandas(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 4 AND toxic >= 9 * clean")
    share = (F.col("toxic") + 0.01) / (F.col("toxic") + F.col("clean") + 0.02)
    gain = F.col("toxic") * F.log(share / base) + F.col("clean") * F.log((1 - share) / (1 - base))
    best = counted.withColumn("gain", gain).where(F.col("gain") >= evidence).orderBy(F.desc("gain"), "term").limit(most).collect()
    if not best:
        return Lexicon()
    varied = sample.where("label = 1").mapInPandas(_surroundings(frozenset(r["term"] for r in best)), "term string, around string, word string")
    around = {r["term"]: (r["places"], r["words"]) for r in varied.groupBy("term").agg(
        F.countDistinct("around").alias("places"), F.countDistinct("word").alias("words")).collect()}
    table = [(r["term"], r["toxic"], r["clean"], *around.get(r["term"], (0, 0))) for r in best]
    return select_terms([t for t in table if t[3] >= max(4, 0.5 * t[1])])


def learn_weights(counts: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression on event features, drawn to the grammar's prior (Newton steps); weights stay positive."""
    x = np.hstack([features(counts), np.ones((len(counts), 1))])
    centre = np.append(PRIOR, -3.0)
    pull, w = np.append(np.full(len(PRIOR), PRIOR_WEIGHT), 0.01), centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + pull * (w - centre)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        w[:-1] = np.maximum(0.0, w[:-1])
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def _count_events(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "counts": [matcher.events(t) for t in pdf["text"]]})

    return run


def fit(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, rows: int = 20_000) -> Model:
    """Learn lexicon and weights from at most `rows` labelled rows outside the held-out part; equal texts count once.

    Without labels of both kinds the fixed words and the grammar's own weights remain.
    """
    sample = labelled(labels, "toxic", parts, part, rows, False)
    text = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = durable(text.join(F.broadcast(sample), "id").groupBy(F.sha2("text", 256).alias("digest")).agg(
        F.any_value("text").alias("text"), F.max("label").alias("label")).drop("digest"))
    lexicon = learn_lexicon(sample)
    seen = sample.mapInPandas(_count_events(lexicon), "label int, counts array<double>").groupBy("label", "counts").count().collect()
    if len({r["label"] for r in seen}) < 2:
        return Model(lexicon)
    counts = np.repeat(np.array([r["counts"] for r in seen]), [r["count"] for r in seen], axis=0)
    weights, bias = learn_weights(counts, np.repeat([r["label"] for r in seen], [r["count"] for r in seen]))
    return Model(lexicon, weights, bias)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """Adds the score of each whole text to `docs`. A null or empty text has no event; repeated rows stay."""
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.lexicon)
        for texts in batches:
            yield pd.Series([probability(model, matcher.events(t) if t else np.zeros(len(EVENTS))) for t in texts])

    return docs.withColumn(score, of(F.col(text_col)))
