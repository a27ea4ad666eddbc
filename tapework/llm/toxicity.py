"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as symbols: insult (patterns of whole words and word beginnings, with weights, learned from labelled texts), words of
threats, targets, negations and reported speech (given words), and other words. Four transducers rewrite symbols, one after
the other: threat (a threatening verb and its target make a threat), negation (what stands under it is denied), reported
speech (what follows it is reported) and target (an insult in a clause that addresses somebody is aimed). An emitting
transducer turns what is left into outputs. All are composed into one machine, which reads each clause once; it adds an
insult's or a threat's weight to the output that it gives the symbol. A text's score is the logistic of the outputs' sums
over its clauses, with weights learned from the same sample and drawn towards the grammar's own where the sample says little.

Only clauses that hold an insult or a threatening word can emit, so an Aho-Corasick automaton finds those in whole texts
and the machine runs over them alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, over_texts, some_at_a_time, text_or_empty, without
from .labelled import held_out, sample_labels, sample_texts

#: Labelled rows of each class that patterns and weights are learned from.
SAMPLE_TOXIC = 3_000
SAMPLE_CLEAN = 6_000
#: A pattern is learned if texts labelled toxic hold it this many times as often, and chance is as unlikely as this.
RATIO = 8.0
SIGNIFICANCE = 20.0
BEGINNINGS = (4, 5, 6, 7)
#: The weight of a threat.
THREAT_WEIGHT = 3.0
#: After a negation, so many words stand under it.
REACH = 3

# The given words. A verb threatens with its target behind it or before it, or has it as its ending.
VERBS_BEFORE_TARGET = {"kill", "hurt", "beat", "destroy", "find", "hunt", "burn", "shoot", "stab", "töte", "bringe", "erschlage"}
VERBS_AFTER_TARGET = {"tuer", "frapper", "mataré", "mataremos", "umbringen", "töten"}
VERBS_WITH_TARGET = {"matarte", "matarlos", "pegarte"}
TARGETS = {"you", "your", "youre", "they", "them", "he", "she", "him", "her", "people", "du", "dich", "dir", "ihr", "sie", "euch", "tú", "te", "ti", "usted", "ustedes", "ellos", "tu", "toi", "vous", "eux", "ils"}
NEGATIONS = {"not", "no", "never", "nobody", "isnt", "arent", "dont", "nicht", "kein", "keine", "keiner", "nie", "nunca", "jamás", "ni", "ne", "pas", "jamais", "aucun"}
REPORTS = {"said", "says", "say", "called", "calls", "quoted", "reported", "according", "claimed", "sagte", "sagt", "nannte", "laut", "dijo", "dice", "llamó", "según", "dit", "appelé", "selon"}

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE_ENDS = ".!?;:\n"
_CLAUSE_END = re.compile(f"[{_CLAUSE_ENDS}]")

#: Outputs of the machine and of a text, and what the grammar itself gives them.
OUTPUTS = ("insult", "insult aimed", "insult denied", "insult reported", "threat", "threat denied or reported", "heaviest", "clauses")
PRIOR = np.array([0.6, 0.8, 0.1, 0.3, 1.0, 0.2, 0.5, 0.2])

OTHER, INSULT, BEFORE, AFTER, THREAT, TARGET, NEGATION, REPORT = range(8)
INSULT_DENIED, INSULT_REPORTED, INSULT_AIMED, THREAT_VOID = range(8, 12)
SYMBOLS = range(12)
_CLASSES = {w: c for c, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, VERBS_WITH_TARGET), (AFTER, VERBS_AFTER_TARGET), (BEFORE, VERBS_BEFORE_TARGET)) for w in words}


class Transducer:
    """starts and finals: states; arcs: for a state and a symbol the arcs that read it, as (symbol written, next state)."""

    def __init__(self, starts: list[Hashable], finals: set[Hashable], arcs: dict[tuple[Hashable, int], list[tuple[int, Hashable]]]):
        self.starts, self.finals, self.arcs = starts, finals, arcs

    @classmethod
    def of(cls, starts: list[Hashable], states: list[Hashable], finals: set[Hashable], step) -> Transducer:
        """step(state, symbol): (symbol written, next state), or None where there is no arc."""
        return cls(starts, finals, {(q, x): [arc] for q in states for x in SYMBOLS if (arc := step(q, x)) is not None})

    def compose(self, other: Transducer) -> Transducer:
        """Reads what this one reads and writes what the other one writes of what this one writes."""
        starts = [(p, q) for p in self.starts for q in other.starts]
        arcs, finals, open_, seen = {}, set(), list(starts), set(starts)
        while open_:
            p, q = state = open_.pop()
            if p in self.finals and q in other.finals:
                finals.add(state)
            for x in SYMBOLS:
                out = [(z, (p2, q2)) for y, p2 in self.arcs.get((p, x), ()) for z, q2 in other.arcs.get((q, y), ())]
                if out:
                    arcs[state, x] = out
                    new = {to for _, to in out} - seen
                    seen |= new
                    open_ += new
        return Transducer(starts, finals, arcs)

    def transduce(self, symbols: list[int]) -> list[list[int]]:
        """What each accepting path writes."""
        paths = [(q, []) for q in self.starts]
        for x in symbols:
            paths = [(to, [*out, y]) for q, out in paths for y, to in self.arcs.get((q, x), ())]
        return [out for q, out in paths if q in self.finals]


def _threat_step(state: int, x: int) -> tuple[int, int]:
    """State 1: a verb that wants its target stands just before; 2: a target does."""
    if x == TARGET:
        return (THREAT if state == 1 else TARGET), 2
    if x == AFTER:
        return (THREAT if state == 2 else OTHER), 0
    return (OTHER, 1) if x == BEFORE else (x, 0)


def _negation_step(left: int, x: int) -> tuple[int, int]:
    """left: how many more words stand under the negation."""
    if x == NEGATION:
        return OTHER, REACH
    return {INSULT: INSULT_DENIED, THREAT: THREAT_VOID}.get(x, x) if left else x, max(0, left - 1)


def _report_step(reported: bool, x: int) -> tuple[int, bool]:
    if x == REPORT:
        return OTHER, True
    return {INSULT: INSULT_REPORTED, THREAT: THREAT_VOID}.get(x, x) if reported else x, reported


def _target_step(state: str, x: int) -> tuple[int, str] | None:
    """The clause addresses nobody ("none"; a target ends the path), or it does ("wait", then "met"); a clause has one path to its end."""
    if x in (TARGET, THREAT, THREAT_VOID):
        return None if state == "none" else (x, "met")
    return (INSULT_AIMED if x == INSULT and state != "none" else x), state


def grammar_parts() -> list[Transducer]:
    """The transducers, in the order in which they read."""
    return [
        Transducer.of([0], [0, 1, 2], {0, 1, 2}, _threat_step),
        Transducer.of([0], list(range(REACH + 1)), set(range(REACH + 1)), _negation_step),
        Transducer.of([False], [False, True], {False, True}, _report_step),
        Transducer.of(["none", "wait"], ["none", "wait", "met"], {"none", "met"}, _target_step),
    ]


_EMITTED = {INSULT: 0, INSULT_AIMED: 1, INSULT_DENIED: 2, INSULT_REPORTED: 3, THREAT: 4, THREAT_VOID: 5}


class Machine:
    """The composed grammar with numbered states: arcs[start][state][symbol] is (output or -1, next state) or None."""

    def __init__(self):
        whole = grammar_parts()[0]
        for part in grammar_parts()[1:]:
            whole = whole.compose(part)
        states = list(dict.fromkeys([*whole.starts, *(q for q, _ in whole.arcs), *(to for out in whole.arcs.values() for _, to in out)]))
        number = {q: k for k, q in enumerate(states)}
        self.starts, self.final = [number[q] for q in whole.starts], [q in whole.finals for q in states]
        self.arcs: list[list[tuple[int, int] | None]] = [[None] * len(SYMBOLS) for _ in states]
        for (q, x), out in whole.arcs.items():
            ((y, to),) = out  # only the start is open
            self.arcs[number[q]][x] = (_EMITTED.get(y, -1), number[to])

    def read(self, symbols: list[int]) -> list[int]:
        """The output of each symbol, -1 for none."""
        for state in self.starts:
            out = []
            for x in symbols:
                arc = self.arcs[state][x]
                if arc is None:
                    break
                out.append(arc[0])
                state = arc[1]
            else:
                if self.final[state]:
                    return out
        raise AssertionError("every clause has a path")


MACHINE = Machine()


class Grammar:
    """patterns: word or word beginning (ending in *) to weight, for insults. weights and bias: of the outputs."""

    def __init__(self, patterns: dict[str, float], weights: np.ndarray | None = None, bias: float = -2.0):
        import ahocorasick

        self.patterns, self.bias = patterns, bias
        self.weights = PRIOR.copy() if weights is None else weights
        self.automaton = ahocorasick.Automaton()
        for word in (*VERBS_BEFORE_TARGET, *VERBS_AFTER_TARGET, *VERBS_WITH_TARGET):
            self.automaton.add_word(word, (len(word), 0.0, True))
        for pattern, weight in patterns.items():
            word = pattern.removesuffix("*")
            self.automaton.add_word(word, (len(word), weight, not pattern.endswith("*")))
        self.automaton.make_automaton()

    def accepted(self, text: str) -> list[tuple[int, float]]:
        """(place, weight) of insults, and with weight 0 of threatening words; the heaviest at a place."""
        found: dict[int, float] = {}
        for end, (length, weight, whole) in self.automaton.iter(text):
            start = end - length + 1
            if (start and text[start - 1].isalpha()) or (whole and end + 1 < len(text) and text[end + 1].isalpha()):
                continue
            found[start] = max(weight, found.get(start, 0.0))
        return sorted(found.items())

    def outputs(self, text: str) -> np.ndarray:
        """The machine's outputs over all clauses of a lower-case text, the heaviest emission, and how many clauses emit."""
        out, hits = np.zeros(len(OUTPUTS)), self.accepted(text)
        k = stop = 0
        while k < len(hits):
            at = hits[k][0]
            start = max(text.rfind(c, stop, at) for c in _CLAUSE_ENDS)
            start = stop if start < 0 else start + 1
            end = _CLAUSE_END.search(text, at)
            stop = end.start() if end else len(text)
            weights = {}
            while k < len(hits) and hits[k][0] < stop:
                if hits[k][1]:
                    weights[hits[k][0]] = hits[k][1]
                k += 1
            self._clause(text, start, stop, weights, out)
        return out

    @staticmethod
    def _clause(text: str, start: int, stop: int, weights: dict[int, float], out: np.ndarray) -> None:
        words = [(m.start(), m.group()) for m in _WORD.finditer(text, start, stop)]
        emitted = MACHINE.read([INSULT if at in weights else _CLASSES.get(word, OTHER) for at, word in words])
        heaviest = 0.0
        for (at, _), output in zip(words, emitted, strict=True):
            if output >= 0:
                weight = weights.get(at, THREAT_WEIGHT)
                out[output] += weight
                heaviest = max(heaviest, weight)
        out[6] = max(out[6], heaviest)
        out[7] += heaviest > 0

    def score(self, outputs: np.ndarray) -> np.ndarray:
        z = np.log1p(outputs) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, outputs: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float = 5.0) -> Grammar:
        """Learn the outputs' weights by logistic regression, drawn towards the grammar's own; Newton's method."""
        x = np.column_stack([np.log1p(outputs), np.ones(len(outputs))])
        prior, pulls = np.append(PRIOR, self.bias), np.append(np.full(len(PRIOR), pull), 1e-3)
        w = prior.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            g = x.T @ (weight * (p - y)) + pulls * (w - prior)
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pulls + 1e-9)
            step = np.linalg.solve(h, g)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        return Grammar(self.patterns, w[:-1], float(w[-1]))


def _word_forms(text: str) -> set[str]:
    forms = set()
    for word in set(_WORD.findall(text.lower())):
        if len(word) >= 3:
            forms.add(word)
            forms.update(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)
    return forms


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in some_at_a_time(batch.column("text")):
            labels, toxic, clean = batch.column("label").slice(row, len(texts)).to_pylist(), Counter(), Counter()
            for label, text in zip(labels, texts.to_pylist(), strict=True):
                (toxic if label else clean).update(_word_forms(text))
            forms = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), *(pa.array([c[f] for f in forms], pa.int64()) for c in (toxic, clean))], ["form", "a", "b"])


def learn_patterns(texts: DataFrame) -> dict[str, float]:
    """Words and word beginnings that texts of label 1 hold far more often; a longer one only where no shorter one is learned.

    All that are found are kept. There can't be many: each is in several of the sample's toxic texts.
    """
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = texts.mapInArrow(_count_forms, "form string, a long, b long").groupBy("form").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rate1, rate0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    expected = (F.col("a") + F.col("b")) * (n1 / (n1 + n0))
    evidence = 2 * (F.col("a") * F.log(F.col("a") / expected) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (F.col("a") + F.col("b") - expected))).otherwise(0.0))
    strong = counts.where(F.col("a") > 0).withColumns({"ratio": rate1 / rate0, "evidence": evidence}).where((F.col("ratio") >= RATIO) & (F.col("evidence") >= SIGNIFICANCE))
    kept: dict[str, float] = {}
    for row in sorted(strong.select("form", "ratio").collect(), key=lambda r: (len(r["form"].rstrip("*")), not r["form"].endswith("*"), r["form"])):
        word = row["form"].rstrip("*")
        if not any(word[:n] + "*" in kept for n in BEGINNINGS if n <= len(word)):
            kept[row["form"]] = float(min(5.0, np.log(row["ratio"])))
    return kept


def fit_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN) -> Grammar:
    """A grammar from at most so many labelled rows of each class, none of them held out.

    Rows of labels without doc_id, or with another label than 0 and 1, teach nothing; without rows of both classes the grammar
    has its own weights and no patterns.
    """
    texts = sample_texts(docs, sample_labels(labels, column, {1: most_toxic, 0: most_clean}))
    patterns = learn_patterns(texts)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Grammar(patterns)
        for batch in batches:
            for row, some in some_at_a_time(batch.column("text")):
                x = [here.outputs(t.lower()).tolist() for t in some.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(row, len(x)), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = texts.mapInArrow(describe, "label int, x array<double>").toPandas()  # no more rows than the sample
    forget(texts)
    if not len(rows) or rows["label"].nunique() < 2:
        return Grammar(patterns)
    x, y = np.array(rows["x"].tolist()), rows["label"].to_numpy(float)
    order = np.lexsort((y, *x.T))
    return Grammar(patterns).fit(x[order], y[order], np.ones(len(y)))


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5).

    Whole texts are read, however long, and nothing but the text counts; null is as empty, and texts without a match share
    the lowest score. Equal texts have equal scores; repeated rows are rows of their own. An empty table gives no rows.
    Columns of docs that are named like an output column are replaced.
    """
    patterns, weights, bias = grammar.patterns, grammar.weights, grammar.bias

    def make():
        here = Grammar(patterns, weights, bias)

        def score(texts: pa.Array) -> pa.Array:
            x = np.array([here.outputs(t.lower()) for t in texts.to_pylist()]).reshape(-1, len(OUTPUTS))
            return pa.array(here.score(x), pa.float64())

        return score

    scored = without(docs, "score", "predicted").withColumn("score", over_texts(make, "double")(text_or_empty()))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    grammar = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, grammar).select("doc_id", held_out().alias("held_out"), "score", "predicted")
