"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words and writes classes: insult, harm, modal, target, negation, report, naming, clause
end, other. Small transducers over classes are composed into one: ``negated`` marks hits shortly after a
negation, ``reported`` those after a speech verb in the clause or right after a word that names words, ``targeted`` insults near
a word for a person, ``threat`` harm after a modal and shortly before a person. A harm word that is no threat is no hit. The
composed machine walks only the clauses that may hold a hit. What is matched and scored are clauses: one has the marks of all
its hits and the sum of their weights, and belongs to one kind: negated, reported, threat, targeted, or plain, the first that fits.

A logistic model over the kinds' sums, fitted on labelled rows, says how much each counts. Its weights keep an order,
whatever the labels show: threats and targeted insults count at least as much as plain ones, negated and reported ones at most half as
much. Kinds that the labels never show keep their prior.

Insult stems are learned: words and word beginnings that tell toxic from other labelled texts, by the
likelihood-ratio statistic, taken over all of them. Learning uses at most ``SAMPLE`` rows of each class, first in the order of a hash of
doc_id, and never rows whose crc32(doc_id) mod 4 is 2. Scores depend on the text alone.

Defined cases: null or empty text has no hit and gets the model's base score; without rows of both classes every
score is 0; rows labelled twice count as toxic if one label is; null labels are passed by; texts of any length are
walked whole; an empty table gives an empty result; repeated rows get equal scores; further columns are passed by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, freed, written

#: Rows of each class that the grammar is fitted on at most.
SAMPLE = 6000
#: Lengths of word beginnings tried as stems; bounds on what counts as a stem.
BEGINNINGS = (4, 5, 6, 7)
LEAST_DOCS, LEAST_RATIO = 3, 100.0
PREDICTED_FROM = 0.3

# Closed-class words of the grammar.
TARGETS = "you your you're he him she her they them these those people du dich dir dein ihr euch sie ihn tu toi te vous votre il elle ils elles eux tú ti tu usted ustedes él ella ellos ellas".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemand ne pas jamais aucun personne no nunca jamás nadie ningún".split()
REPORTS = "said says say called calls wrote writes quoted claimed sagte sagt nannte schrieb behauptete dit disait appelé écrit prétend dijo dice llamó escribió afirmó".split()
NAMINGS = "word words term slur wort begriff mot terme palabra término".split()
MODALS = "will shall gonna going must should i'll we'll werde werden sollte muss vais va allons dois voy vamos debo deberías".split()
HARMS = "kill hurt destroy beat stab shoot murder punch töten umbringen verletzen schlagen erschießen tuer frapper blesser détruire matar golpear herir destruir".split()

OTHER, INSULT, HARM, MODAL, TARGET, NEGATION, REPORT, NAMING, STOP = range(9)
CLASSES = 9
#: Kinds of clauses, the first one that a clause has the mark of.
KINDS = ("negated", "reported", "threat", "targeted", "plain")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLASS = {w: c for words, c in ((TARGETS, TARGET), (MODALS, MODAL), (NAMINGS, NAMING), (REPORTS, REPORT), (NEGATIONS, NEGATION), (HARMS, HARM)) for w in words}


def _countdown(trigger: int, steps: int, mark: str, on: tuple[int, ...]):
    """A transducer that marks classes ``on`` within ``steps`` words after ``trigger``."""

    def step(state: int, symbol: int) -> tuple[int, set[str]]:
        marks = {mark} if state and symbol in on else set()
        if symbol == STOP:
            return 0, marks
        return (steps if symbol == trigger else max(0, state - 1)), marks

    return steps + 1, step


def _until_stop(trigger: int, mark: str, on: tuple[int, ...]):
    def step(state: int, symbol: int) -> tuple[int, set[str]]:
        marks = {mark} if state and symbol in on else set()
        return (0 if symbol == STOP else 1 if symbol == trigger else state), marks

    return 2, step


def _after(steps: int):
    """Marks a person's word as pointing back at an insult within ``steps`` words."""

    def step(state: int, symbol: int) -> tuple[int, set[str]]:
        marks = {"targeted"} if state and symbol == TARGET else set()
        return (0 if symbol == STOP else steps if symbol == INSULT else max(0, state - 1)), marks

    return steps + 1, step


def _threat(before: int, after: int):
    """Marks a person's word within ``after`` words after harm that stands within ``before`` words after a modal."""

    def step(state: int, symbol: int) -> tuple[int, set[str]]:
        modal, harm = divmod(state, after + 1)
        marks = {"threat"} if harm and symbol == TARGET else set()
        if symbol == STOP:
            return 0, marks
        harm = after if symbol == HARM and modal else max(0, harm - 1)
        modal = before if symbol == MODAL else max(0, modal - 1)
        return modal * (after + 1) + harm, marks

    return (before + 1) * (after + 1), step


def compose(*machines) -> dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], frozenset[str]]]:
    """The product transducer: (states, class) -> (states, marks)."""
    table = {}
    for states in product(*[range(n) for n, _ in machines]):
        for symbol in range(CLASSES):
            steps = [step(s, symbol) for s, (_, step) in zip(states, machines)]
            table[states, symbol] = tuple(s for s, _ in steps), frozenset().union(*[m for _, m in steps])
    return table


HITS = (INSULT, HARM)
GRAMMAR = compose(
    _countdown(NEGATION, 3, "negated", HITS),
    _until_stop(REPORT, "reported", HITS),
    _countdown(TARGET, 4, "targeted", (INSULT,)),
    _after(2),
    _countdown(NAMING, 1, "reported", HITS),
    _threat(4, 3),
)
START = (0,) * 6


class Lexicon:
    """Insult stems with weights; finds the clauses that hold a hit and walks them through the grammar."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems = stems
        self.finder = ahocorasick.Automaton()
        for stem in [*stems, *[h + "$" for h in HARMS]]:
            self.finder.add_word(stem.rstrip("$"), len(stem.rstrip("$")))
        self.finder.make_automaton()
        self.lengths = sorted({len(s) for s in stems if not s.endswith("$")})

    def __reduce__(self):
        return Lexicon, (self.stems,)

    def weight(self, word: str) -> float:
        """The greatest weight of a stem that the word is or begins with."""
        found = self.stems.get(word + "$", 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def matches(self, text: str) -> list[tuple[int, int, float, frozenset[str]]]:
        """(start, end, weight, marks) of each clause that holds a hit, in the lower-cased text."""
        low, out, done = text.lower(), [], 0
        for last, length in self.finder.iter(low):
            at = last - length + 1
            if at < done or (at and low[at - 1].isalpha()):
                continue
            start = max(low.rfind(c, done, at) for c in ".!?;\n") + 1 or done
            states, total, marked, of_harm = START, 0.0, set(), set()
            for word in _WORD.finditer(low, start):
                w, weight = word.group(), 0.0
                if w in ".!?;\n":
                    symbol = STOP
                elif (weight := self.weight(w)) > 0:
                    symbol = INSULT
                else:
                    symbol = _CLASS.get(w, OTHER)
                states, marks = GRAMMAR[states, symbol]
                if symbol == HARM:
                    of_harm |= marks  # counts if the harm turns out to be a threat
                else:
                    marked |= marks
                total += weight + ("threat" in marks)
                done = word.end()
                if symbol == STOP:
                    break
            if total:
                out.append((start, done, total, frozenset(marked | of_harm if "threat" in marked else marked)))
        return out

    def features(self, text: str | None) -> tuple[np.ndarray, list]:
        """log(1 + sum of weights) of each kind of clause, and the clauses."""
        sums, found = dict.fromkeys(KINDS, 0.0), self.matches(text or "")
        for _, _, weight, marks in found:
            sums[next(k for k in KINDS if k in marks or k == "plain")] += weight
        return np.log1p([sums[k] for k in KINDS]), found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic) of the distinct texts of at most ``sample`` rows of each class outside the held-out fold."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    order = [F.xxhash64("id"), "id"]
    chosen = [own.where(F.col("toxic") == y).orderBy(*order).limit(sample) for y in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows of two numbers
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, toxic, other): documents with each word (marked by $) and word beginning."""
    counts = Counter(), Counter()
    seen = [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(_LETTERS.findall((text or "").lower()))
            counts[bool(toxic)].update({w + "$" for w in words} | {w[:n] for w in words for n in BEGINNINGS if len(w) >= n})
            seen[bool(toxic)] += 1
    stems = ["", *(counts[0].keys() | counts[1].keys())]
    columns = [[seen[y], *[counts[y][s] for s in stems[1:]]] for y in (1, 0)]
    for a in range(0, len(stems), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(stems[a : a + 50_000]), *[pa.array(c[a : a + 50_000], pa.int64()) for c in columns]], ["stem", "toxic", "other"])


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """Stems of significant likelihood ratio, weighted 0 to 1 by their log ratio.

    The bound on the statistic rises with the logarithm of the stems tried, as chance finds more among more.
    """
    counts = rows.mapInArrow(freed(_stem_counts), "stem string, toxic long, other long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = written(counts.where((F.col("stem") == "") | (F.col("toxic") + F.col("other") >= LEAST_DOCS)))
    total = counts.where(F.col("stem") == "").agg(F.sum("toxic"), F.sum("other")).first()
    if not total[0] or not total[1]:
        discard(counts)
        return {}
    n, m = float(total[0]), float(total[1])
    least = 2 * np.log(max(2, counts.count())) - 2
    a, b, share = F.col("toxic"), F.col("other"), (F.col("toxic") + F.col("other")) / (n + m)
    part = lambda k, size: F.when(k > 0, k * F.log(k / (share * size))).otherwise(0.0)
    scored = counts.where((F.col("stem") != "") & (a >= LEAST_DOCS) & (a >= b)).select(
        "stem",
        ((a + 0.25) / (n + 0.5) / ((b + 0.25) / (m + 0.5))).alias("ratio"),
        (2 * (part(a, n) + part(b, m))).alias("statistic"),
    )
    good = scored.where((F.col("statistic") >= least) & (F.col("ratio") >= LEAST_RATIO))
    best = good.collect()  # bounded by the labelled sample
    discard(counts)
    return {r["stem"]: float(min(1.0, np.log(r["ratio"]) / np.log(10 * LEAST_RATIO))) for r in best}


#: What weights are before any label is seen: plain insults, what a target or a threat adds, what stays under negation or report, and the intercept.
PRIOR = np.array([6.0, 1.0, 1.0, 0.5, 0.5, -4.0])


def ordered(w: np.ndarray) -> np.ndarray:
    """Weights of KINDS, and the intercept, from (plain, added by targets, by threats, left of negated, of reported, intercept)."""
    plain, targeted, threat, negated, reported, base = w
    return np.array([negated, reported, plain + threat, plain + targeted, plain, base])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 300) -> np.ndarray:
    """Weights of KINDS and the intercept: coordinate by coordinate, near the prior, within the order of kinds."""
    negated, reported, threat, targeted, plain = x.T
    parts = np.stack([plain + threat + targeted, targeted, threat, negated, reported, np.ones(len(x))])
    w, sums = PRIOR.copy(), PRIOR @ parts
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            slope = parts[j] @ (y - p) - ridge * (w[j] - PRIOR[j])
            step = slope / (parts[j] ** 2 @ (p * (1 - p)) + ridge + 1e-3)
            new = w[j] + np.clip(step, -2, 2)
            if j < 5:
                new = max(new, 0.0)
            if j == 0:
                new = max(new, 2 * w[3], 2 * w[4])
            if j in (3, 4):
                new = min(new, w[0] / 2)
            sums, moved, w[j] = sums + (new - w[j]) * parts[j], max(moved, abs(new - w[j])), new
        if moved < 1e-7:
            break
    return ordered(w)


class Grader:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def grade(self, text: str | None) -> tuple[float, list]:
        if self.weights is None:
            return 0.0, []
        x, found = self.lexicon.features(text)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))), found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Grader:
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample)
    lexicon = Lexicon(learn_stems(rows))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([shared.value.features(t)[0] for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], batch.column("toxic").cast(pa.float64())], [*KINDS, "toxic"])

    made = rows.mapInArrow(freed(features), ", ".join(f"{m} double" for m in (*KINDS, "toxic"))).toPandas()
    if made["toxic"].nunique() < 2:
        return Grader(lexicon, None)
    made = made.sort_values(list(made.columns))
    return Grader(lexicon, logistic(made[list(KINDS)].to_numpy(), made["toxic"].to_numpy()))


def score(docs: DataFrame, grader: Grader, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, clauses): clauses are (start, end, weight, marks) in the lower-cased text."""
    shared = docs.sparkSession.sparkContext.broadcast(grader)
    clause = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64()), ("marks", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, clauses = [], []
            for text in batch.column("text"):
                s, found = shared.value.grade(text.as_py())
                scores.append(s)
                clauses.append([{"start": a, "end": b, "weight": w, "marks": sorted(m)} for a, b, w, m in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(clauses, clause)], ["id", "score", "clauses"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    graded = rows.mapInArrow(freed(run), f"id {kind}, score double, clauses array<struct<start:int,end:int,weight:double,marks:array<string>>>")
    return graded.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"),
        "clauses",
    )


def clean(docs: DataFrame, grader: Grader, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.grade(t.as_py())[0] < PREDICTED_FROM for t in batch.column(text_col)], pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)
