"""Toxicity: composed weighted finite-state transducers over clauses, their insult lexicon and the text's weights learned.

Five transducers read a clause's words, each as the match it may be (insult, threat or none) and the cues
it bears (target, negation, report): `insults` and `threats` choose one match, `negation` and `reports` count
the words since their cue and soften the choice, `targets` guesses at the start whether the clause has a
target and keeps or raises the choice by that. Each arc has a factor; composed, every accepting path is one
match in its context, and its weight the product of the arcs' factors and the lexicon's weight. A clause's
scores are the sums of its paths, by what they put out: plain insults, softened ones, threats. A logistic
model over a text's clause scores, fitted to the labelled rows, gives the score; the best clause counts 12 at most.

Null and empty texts match no clause and get the score of that. Texts are read whole. Repeated rows
get equal scores. Where no row is labelled, or one class only, the lexicon is empty and the score is
the share of toxic labels (0 without any). Labels other than 0 and 1 are not learned from. Other
columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keyed_fraction

#: At most about so many labelled texts are learned from.
SAMPLE = 12_000
#: Learned terms: least log-odds, least log-likelihood ratio (24: one chance in a million for a term), most terms.
LEAST_ODDS, LEAST_RATIO, TERMS = 1.5, 24.0, 4000
#: Beginnings of words that may become terms, in letters.
STEMS = (3, 4, 5, 6)
#: Words that negation and reported speech hold for after their cue; factors on an insult's weight.
REACH, NEGATED, REPORTED, TARGETED = 4, 0.6, 0.7, 1.25
THREAT_WEIGHT = 2.0
#: What the best clause counts at the most.
BEST = 12.0

#: Closed-class words of the grammar in English, German, French and Spanish.
TARGET = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch euer sie ihr tu toi ton ta tes vous votre vos tú ti tus vosotros vuestro usted ustedes he she they him her them".split())
NEGATION = frozenset("not no never none neither nor cannot dont isnt arent wasnt werent wont aint nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ni tampoco".split())
REPORT = frozenset("said says say wrote writes claimed claims called quoted told tells reported according sagte sagt schrieb behauptete nannte laut dit disait écrit selon appelé dijo dice escribió llamó según".split())
THREAT = frozenset("kill murder stab strangle shoot destroy exterminate töten umbringen ermorden erschießen tuer tuerai égorger matar mataré asesinar".split())
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The word itself, and its beginnings, marked."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Symbol(NamedTuple):
    """What a word is: its match (I insult, K threat, O none; P, S, T once chosen: plain, softened, threat) and its cues."""

    match: str
    target: bool
    negation: bool
    report: bool


class Transducer(NamedTuple):
    """Arcs by (state, symbol read): (symbol written, next state, factor). Weights multiply along a path and add up over paths."""

    start: tuple
    arcs: dict
    final: frozenset


def machine(states, start, final, step) -> Transducer:
    """step(state, symbol) gives the arcs; it is asked for every state and symbol."""
    alphabet = [Symbol(*x) for x in product("IKOPST", (False, True), (False, True), (False, True))]
    arcs = {(s, x): found for s in states for x in alphabet if (found := step(s, x))}
    return Transducer(tuple(start), arcs, frozenset(final))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Reads what a reads and writes what b writes of what a writes."""
    start = tuple(product(a.start, b.start))
    arcs, queue, seen = {}, list(start), set(start)
    symbols = {x for _, x in a.arcs}
    while queue:
        here = p, q = queue.pop()
        for x in symbols:
            found = [(z, (p2, q2), v * w) for y, p2, v in a.arcs.get((p, x), ()) for z, q2, w in b.arcs.get((q, y), ())]
            if found:
                arcs[here, x] = found
                new = {n for _, n, _ in found} - seen
                seen |= new
                queue += new
    return Transducer(start, arcs, frozenset(product(a.final, b.final)) & seen)


def insults() -> Transducer:
    """Passes words on; once it may choose an insult."""

    def step(chosen, x):
        pass_on = [(x, chosen, 1.0)]
        return pass_on + [(x._replace(match="P"), True, 1.0)] if x.match == "I" and not chosen else pass_on

    return machine((False, True), (False,), (False, True), step)


def threats() -> Transducer:
    """Passes words on; chooses a threat unless an insult is chosen, and ends only with a choice."""

    def step(chosen, x):
        if x.match == "P":
            return [] if chosen else [(x, True, 1.0)]
        pass_on = [(x, chosen, 1.0)]
        return pass_on + [(x._replace(match="T"), True, THREAT_WEIGHT)] if x.match == "K" and not chosen else pass_on

    return machine((False, True), (False,), (True,), step)


def scope(cue: str, factor: float, threats_pass: bool) -> Transducer:
    """Counts down REACH words from a cue; a chosen insult within is softened by the factor, a threat too or not accepted."""

    def step(left, x):
        after = REACH if getattr(x, cue) else max(0, left - 1)
        if not left or x.match not in "PST":
            return [(x, after, 1.0)]
        if x.match == "T":
            return [(x, after, factor)] if threats_pass else []
        return [(x._replace(match="S"), after, factor)]

    return machine(range(REACH + 1), (0,), range(REACH + 1), step)


def targets() -> Transducer:
    """Guesses whether a target comes: without one threats are not accepted, with one insults are raised."""

    def step(state, x):
        if state == "none":
            return [] if x.target or x.match == "T" else [(x, "none", 1.0)]
        after = "met" if x.target else state
        return [(x, after, TARGETED if x.match in "PS" else 1.0)]

    return machine(("none", "coming", "met"), ("none", "coming"), ("none", "met"), step)


def grammar_machine() -> Transducer:
    whole = compose(insults(), threats())
    for part in (scope("negation", NEGATED, False), scope("report", REPORTED, True), targets()):
        whole = compose(whole, part)
    return whole


class Grammar:
    def __init__(self, lexicon: dict[str, float], coefficients: np.ndarray):
        self.lexicon, self.coefficients = lexicon, coefficients
        self.memo: dict[str, float] = {}
        self.machine = grammar_machine()

    def insult(self, word: str) -> float:
        weight = self.memo.get(word)
        if weight is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            weight = self.memo[word] = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)
        return weight

    def matters(self, words) -> bool:
        insult = self.insult
        return any(insult(w) > 0 or w in THREAT for w in words)

    def clause(self, words: list[str]) -> tuple[float, float, float]:
        """Sums over the machine's accepting paths by their choice: plain insults, softened ones, threats."""
        if not self.matters(words):
            return 0.0, 0.0, 0.0
        arcs = self.machine.arcs
        paths = {(s, "O"): 1.0 for s in self.machine.start}
        for w in words:
            weight = self.insult(w)
            x = Symbol("I" if weight > 0 else "K" if w in THREAT else "O", w in TARGET, w in NEGATION, w in REPORT)
            longer: dict = {}
            for (state, chosen), total in paths.items():
                for y, after, factor in arcs.get((state, x), ()):
                    if y.match in "PST":
                        key = after, y.match
                        value = total * factor * (1.0 if y.match == "T" else weight)
                    else:
                        key, value = (after, chosen), total * factor
                    longer[key] = longer.get(key, 0.0) + value
            paths = longer
        sums = {"P": 0.0, "S": 0.0, "T": 0.0}
        for (state, chosen), total in paths.items():
            if chosen in sums and state in self.machine.final:
                sums[chosen] += total
        return sums["P"], sums["S"], sums["T"]

    def features(self, text: str | None) -> list[float]:
        """1; the best clause; its log sum; the same of softened ones; threats; matched clauses for each of the words, logged."""
        low = (text or "").lower()
        words = WORD.findall(low)
        if not self.matters(set(words)):
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        scores = [s for c in CLAUSE.split(low) if any(s := self.clause(WORD.findall(c)))]
        plain = [s[0] for s in scores] or [0.0]
        return [1.0, min(max(plain), BEST), math.log1p(sum(plain)), math.log1p(sum(s[1] for s in scores)), math.log1p(sum(s[2] for s in scores))]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))


def likelihood_ratio(a: Column, b: Column, n: int, m: int) -> Column:
    """Of a in n toxic and b in m clean texts."""

    def part(k: Column, size: int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < size, (size - k) * F.log1p(-p)).otherwise(0.0)

    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method; every coefficient but the first is held to be no less than 0, so a match never lowers a score."""
    w = np.zeros(x.shape[1])
    free = np.ones(x.shape[1], bool)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w[free] -= np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
        for i in range(1, len(w)):
            if w[i] < 0:
                w[i], free[i] = 0.0, False
    return w


def training_rows(docs: DataFrame, labels: DataFrame, fold: Column, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """id, text, toxic of about most labelled rows, near copies of one label taken once: one text for each least hash of its word triples, by two hashes."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("toxic"))
    known = known.where(fold)
    n = known.count()
    known = known.where(keyed_fraction(F.col("id"), F.lit(min(1.0, most / max(1, n)))))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(known, "id")
    words = F.split(F.lower("text"), r"\s+")
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))), lambda i: F.slice("_w", i + 1, 3))
    rows = rows.withColumn("_w", words)
    rows = rows.withColumn("_a", F.array_min(F.transform(triples, lambda t: F.xxhash64(t)))).withColumn("_b", F.array_min(F.transform(triples, lambda t: F.xxhash64(t, F.lit(7)))))
    rows = rows.select("id", "text", F.col("toxic").cast("int").alias("toxic"), "_a", "_b")
    for key in ("_a", "_b"):  # of each group the least row, so every run learns from the same texts
        rows = rows.groupBy(F.col("toxic").alias("_t"), F.col(key).alias("_key")).agg(F.min(F.struct("id", "text", "toxic", "_a", "_b")).alias("_r")).select("_r.*")
    return rows.select("id", "text", "toxic")


def count_terms(batches):
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            found = {t for w in set(WORD.findall(text.as_py().lower())) for t in terms_of(w)}
            (toxic if label.as_py() else clean).update(found)
    terms = list(toxic.keys() | clean.keys())
    for at in range(0, len(terms), 50_000):
        part = terms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "toxic", "clean"])


def learn(docs: DataFrame, labels: DataFrame, fold: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Grammar:
    """fold: which ids, as column `id`, may be learned from."""
    from .shared import materialize

    rows = materialize(training_rows(docs, labels, fold, doc_id, text, label, most), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not m:
        return Grammar({}, np.array([30.0 if n else -30.0, 0, 0, 0, 0]))
    counts = rows.select("text", "toxic").mapInArrow(count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n + 1.0)) - F.log((F.col("b") + 0.5) / (m + 1.0))
    likely = counts.withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (F.col("a") >= 4) & (likelihood_ratio(F.col("a"), F.col("b"), n, m) >= LEAST_RATIO))
    # The tests leave as many terms as a sample of SAMPLE texts supports; TERMS bounds what is broadcast.
    lexicon = {r["term"]: float(r["odds"]) for r in likely.orderBy(F.desc(F.col("a") * F.col("odds")), "term").limit(TERMS).collect()}
    grammar = Grammar(lexicon, np.zeros(5))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    measured = rows.select("toxic", features(F.col("text")).alias("x")).toArrow()  # at most about SAMPLE rows of five numbers
    x, y = np.array(measured.column("x").to_pylist()), measured.column("toxic").to_numpy()
    return Grammar(lexicon, fit_logistic(x, y))


def toxicity(docs: DataFrame, grammar: Grammar, text: str | Column = "text") -> Column:
    """A column: the score of docs' texts, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        g = shared.value
        x = np.array([g.features(t.as_py()) for t in texts]).reshape(len(texts), 5)
        return pa.array(g.score(x), pa.float64())

    return score(F.col(text) if isinstance(text, str) else text)
