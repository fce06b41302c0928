"""Toxicity: a weighted finite-state pattern grammar over clauses.

A text is a row of symbols: word classes (insult, harm, modal, target, negator, report verb,
first person, conjunction), commas, quotes and clause ends. A cascade of finite-state
transducers reads them, each the output of the one before; together they are one automaton
whose states are tuples and whose transitions are kept once made (composition on the fly):

* negation  marks insults and harm that follow a negator, up to NEGATION_REACH words on,
            a comma, an adversative conjunction or the clause's end
* reported  marks what a verb of speech governs, to the clause's end (over a colon), unless
            the first person speaks; and what stands in quotes, over clauses
* target    marks insults up to TARGET_REACH words after a second or third person
* threat    turns harm after a modal, or as an imperative with a target, into a threat; a
            target up to OBJECT_REACH words after it marks the threat
* insult    passes an insult on with the learned weight of its word or stem

What comes out are matches: insults and threats with marks. A match weighs its weight,
times 1 + target factor if a target is marked, 1 - negation factor if negated, 1 - reported
factor if reported. The factors are never zero: the fit takes the first of FACTORS unless
others are better by LEAST_GAIN. A clause
weighs the sum of its matches, and the document's score is a logistic of the clauses (summed
weight, largest clause, weight per word, matches, length), so matched clauses count, not
lone words; weights other than that of length are not negative, so a mark moves a score in
its own direction only. A document without a match has one low score.

Insult weights are learned: for words and word stems (prefixes of STEM lengths), Spark
counts documents with and without label 1 over a bounded sample of labelled rows (the
MOST_LABELS smallest hashes of doc_id among rows whose crc32(doc_id) mod FOLDS is not 0);
log odds of those with enough evidence become weights, a threat weighs as much as the upper
quartile of insults. Factors and logistic are fitted on the same rows. Labels, lang, source
and doc_id are no inputs of a score.

Null or empty texts have the score of no match. Rows that repeat are scored alike; a
doc_id with contradicting labels counts once for each. Texts of any length are read whole, clause by clause. An empty table
gives an empty result; without any label 1 every score is low. Extra columns are ignored. A
score of exactly 0.5 is predicted 1; equal scores need no order.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, materialize, texts_of

FOLDS, MOST_LABELS = 5, 20_000
STEM = (3, 4, 5, 6, 7, 8)
#: Least documents with label 1 behind an insult, least share of label 1 among its documents.
LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.4
#: Least log-likelihood ratio (G squared) of an insult with label 1; 1.8 log N where N terms are tried, if that is more.
LEAST_EVIDENCE = 12.0
CLEARER = 0.5
NEGATION_REACH, TARGET_REACH, MODAL_REACH, OBJECT_REACH = 5, 5, 3, 3
#: (target, negation, reported) factors to choose from, likely ones first.
FACTORS = [(0.5, 0.95, 0.8), *((t, g, r) for t in (0.25, 0.5, 1.0) for g in (0.8, 0.9, 0.95) for r in (0.6, 0.8, 0.9))]
#: By how much the mean log loss of other factors must be less than that of the first: labels without marked matches choose nothing.
LEAST_GAIN = 2e-3
#: Marks of a match.
NEGATED, REPORTED, AIMED = 1, 2, 4

# Closed word classes of the grammar, in the four languages; fixed values of this library.
MODALS = {"will", "shall", "gonna", "going", "should", "must", "want", "werde", "werden", "wird", "sollte", "will", "vais", "va", "vas", "doit", "veux", "voy", "vamos", "debe", "quiero"}
HARM = {"kill", "hurt", "destroy", "burn", "attack", "shoot", "stab", "beat", "punch", "strangle", "töten", "verletzen", "zerstören", "schlagen", "tuer", "blesser", "détruire", "frapper", "matar", "matarte", "herir", "destruir", "golpear"}
TARGETS = {"you", "your", "you're", "he", "she", "they", "him", "her", "them", "du", "dich", "dein", "ihr", "euch", "tu", "toi", "te", "vous", "usted", "ella", "ellos", "ustedes"}
NEGATORS = {"not", "no", "never", "isn't", "aren't", "don't", "won't", "nobody", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "ni"}
REPORTS = {"said", "says", "called", "calls", "wrote", "reported", "claimed", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió"}
FIRST = {"i", "we", "ich", "wir", "je", "nous", "yo", "nosotros"}
CONJUNCTIONS = {"but", "yet", "although", "because", "aber", "sondern", "obwohl", "mais", "pero", "sino", "aunque"}
_CLASSES = {w: c for c, ws in (("CONJ", CONJUNCTIONS), ("FIRST", FIRST), ("REPORT", REPORTS), ("MODAL", MODALS), ("HARM", HARM), ("TARGET", TARGETS), ("NEG", NEGATORS)) for w in ws}
_SIGNS = {",": "COMMA", ":": "COLON", '"': "QUOTE", "“": "OPEN", "„": "OPEN", "«": "OPEN", "”": "CLOSE", "»": "CLOSE"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[,:\"“”„«»]|[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Scope:
    """A transducer that marks symbols of `marks` with `flag` from an opening symbol on, to a closing one or for `reach` symbols."""

    def __init__(self, opens, closes, marks, flag, reach=None, toggles=(), unless=()):
        self.opens, self.closes, self.marks, self.flag, self.reach, self.toggles, self.unless = opens, closes, marks, flag, reach, toggles, unless

    def step(self, state: int, symbol: str, flags: int) -> tuple[int, int]:
        """(state, flags): state 0 is outside, n the n-th symbol inside, -1 right after a symbol of `unless`."""
        inside = state > 0
        if inside and symbol in self.marks:
            flags |= self.flag
        if symbol in self.closes or (inside and symbol in self.toggles):
            return 0, flags
        if symbol in self.toggles or (symbol in self.opens and state >= 0):
            return 1, flags
        if inside:
            if self.reach is None:
                return state, flags
            return (state + 1 if state < self.reach else 0), flags
        return (-1 if symbol in self.unless else 0), flags


class Threat:
    """A transducer from harm, modals and targets to threats. States: where a clause begins, outside, after a modal, and harm that waits for its object."""

    BEGIN, OUTSIDE = ("begin",), ("outside",)

    def step(self, state: tuple, symbol: str, flags: int) -> tuple[tuple, list[int]]:
        """(state, flags of the threats written)."""
        out = []
        if state[0] == "waits":
            _, left, sure, held = state
            if symbol == "TARGET":
                return self.OUTSIDE, [held | AIMED]
            if left > 1 and symbol not in ("END", "COLON", "HARM"):
                return ("waits", left - 1, sure, held), out
            out, state = [held] * sure, self.OUTSIDE
        if symbol in ("END", "COLON"):
            return self.BEGIN, out
        if symbol == "HARM" and state[0] != "outside":
            return ("waits", OBJECT_REACH, state[0] == "modal", flags), out
        if symbol == "MODAL":
            return ("modal", MODAL_REACH), out
        if state[0] == "modal" and state[1] > 1:
            return ("modal", state[1] - 1), out
        return (state if state[0] == "begin" and symbol in ("NEG", "QUOTE", "OPEN", "COMMA") else self.OUTSIDE), out


class Cascade:
    """The transducers composed: one automaton over tuples of states, whose transitions are made when first met."""

    MATCHES = ("INSULT", "HARM")

    def __init__(self):
        ends = ("END", "COLON")
        self.scopes = (
            Scope({"NEG"}, {*ends, "COMMA", "CONJ"}, self.MATCHES, NEGATED, NEGATION_REACH),
            Scope({"REPORT"}, {"END"}, self.MATCHES, REPORTED, unless={"FIRST"}),
            Scope({"OPEN"}, {"CLOSE"}, self.MATCHES, REPORTED, toggles={"QUOTE"}),
            Scope({"TARGET"}, ends, ("INSULT",), AIMED, TARGET_REACH),
        )
        self.threat = Threat()
        self.start = (*(0 for _ in self.scopes), Threat.BEGIN)
        self.made: dict = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, list[tuple[str, int]]]:
        """(state, matches written as (kind, flags))."""
        got = self.made.get((state, symbol))
        if got is None:
            flags, new = 0, []
            for scope, s in zip(self.scopes, state, strict=False):
                s, flags = scope.step(s, symbol, flags)
                new.append(s)
            last, threats = self.threat.step(state[-1], symbol, flags)
            out = [("THREAT", f) for f in threats] + ([("INSULT", flags)] if symbol == "INSULT" else [])
            got = self.made[state, symbol] = (*new, last), out
        return got


def features_of(words) -> set[str]:
    """Words, and stems of longer words marked with a trailing star."""
    out = set(words)
    for w in set(words):
        for k in STEM:
            if len(w) > k:
                out.add(w[:k] + "*")
    return out


class Grammar:
    """The cascade with its lexicon. insults: word or stem -> weight; factors: (target, negation, reported)."""

    def __init__(self, insults: dict[str, float], factors=FACTORS[0]):
        self.words = {w: v for w, v in insults.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in insults.items() if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.threat = max(2.0, float(np.quantile(list(insults.values()), 0.75))) if insults else 2.0
        self.factors, self.cascade = factors, Cascade()
        self.known: dict[bytes, bool] = {}
        self.symbols: dict[str, tuple[str, float]] = {}

    def insult(self, word: str) -> float:
        """Weight written for a lower-case word; 0 for none."""
        v = self.words.get(word)
        if v is None:
            v = next((self.stems[word[:k]] for k in self.lengths if word[:k] in self.stems and len(word) > k), 0.0)
        return v

    def symbol(self, token: str) -> tuple[str, float]:
        """The symbol of a token, and the weight of an insult."""
        got = self.symbols.get(token)
        if got is None:
            if len(self.symbols) > 100_000:
                self.symbols.clear()
            word = token.replace("’", "'")
            own = _CLASSES.get(word) or _SIGNS.get(token) or (None if word[0].isalpha() else "END")
            v = 0.0 if own else self.insult(word)
            got = self.symbols[token] = own or ("INSULT" if v else "OTHER"), v
        return got

    def _interesting(self, word: bytes) -> bool:
        known = self.known
        v = known.get(word)
        if v is None:
            if len(known) > 200_000:
                known.clear()
            v = known[word] = any(self.insult(w) or w in HARM for w in _WORD.findall(word.decode("utf-8", "replace").lower()))
        return v

    def matched(self, text: bytes | None) -> list[list[float]]:
        """Clauses with a match: weight by marks (8 numbers), then matches by marks (8). Texts without a word that can match are not parsed."""
        if not text or not any(map(self._interesting, text.split())):
            return []
        out, now, state, step = [], None, self.cascade.start, self.cascade.step
        for token in chain(_TOKEN.findall(text.decode("utf-8", "replace").lower()), (".",)):
            symbol, weight = self.symbol(token)
            state, found = step(state, symbol)
            for kind, flags in found:
                now = now or [0.0] * 16
                now[flags] += weight if kind == "INSULT" else self.threat
                now[8 + flags] += 1
            if now and symbol in ("END", "COLON"):
                out.append(now)
                now = None
        return out

    def summary(self, text: bytes | None) -> np.ndarray | None:
        """Features of a document with a match, else None."""
        found = self.matched(text)
        return document_features(np.array(found, float), len(text.split()), self.factors) if found else None


def mark_factors(factors) -> np.ndarray:
    """What a match's weight is multiplied by, for each set of marks."""
    t, g, r = factors
    return np.array([(1 + t * bool(f & AIMED)) * (1 - g * bool(f & NEGATED)) * (1 - r * bool(f & REPORTED)) for f in range(8)])


#: Features that may only raise a score; the last, the document's length, may have either sign.
N_RAISING = 4


def document_features(clauses: np.ndarray, words: int, factors) -> np.ndarray:
    """log(1 + summed clause weight), largest clause weight, weight per word, log(1 + matches), log words.

    clauses: rows of weight by marks and matches by marks. Chance matches grow with a
    text's length, so length is a feature of its own.
    """
    by_mark = mark_factors(factors)
    v, n = clauses[:, :8] @ by_mark, clauses[:, 8:] @ np.minimum(by_mark, 1.0)
    return np.array([math.log1p(v.sum()), v.max(), 10 * math.sqrt(v.sum() / max(20, words)), math.log1p(n.sum()), math.log(max(1, words))])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, text, toxic of the labelled rows of the training folds, `most` at most (the smallest hashes of doc_id)."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = known.filter(fold() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")


def fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Words and stems that mark label 1, with log odds; counted by Spark over the training rows."""

    def run(batches):
        for batch in batches:
            toxic, terms, marks = batch.column(1).to_pylist(), [], []
            for text, y in zip(texts_of(batch.column(0)), toxic, strict=True):
                found = sorted(features_of(_WORD.findall(text.decode("utf-8", "replace").lower()))) if text else []
                terms += found
                marks += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(marks, pa.int64())], names=["term", "toxic"])

    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    if not t:
        return {}
    terms = rows.select("text", F.col("toxic").cast("long")).mapInArrow(run, "term string, toxic long").groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    terms = materialize(terms.filter(F.col("n") >= LEAST_DOCUMENTS), "terms")
    least = max(LEAST_EVIDENCE, 1.8 * math.log(max(1, terms.count())))
    good = terms.filter((F.col("t") >= LEAST_DOCUMENTS) & (F.col("t") >= LEAST_SHARE * F.col("n")))
    p = t / n
    evidence = 2 * (F.col("t") * F.log(F.col("t") / (F.col("n") * p)) + F.when(F.col("n") > F.col("t"), (F.col("n") - F.col("t")) * F.log((F.col("n") - F.col("t")) / (F.col("n") * (1 - p)))).otherwise(0.0))
    odds = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - t + 1))
    best = good.withColumn("evidence", evidence).filter(F.col("evidence") >= least).select("term", "t", "n", odds.alias("odds")).collect()
    return _simplest({r["term"]: (r["t"], r["n"], r["odds"]) for r in best})


def _simplest(terms: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """The words and stems that are needed.

    A stem stays if it marks clearly more documents than any one word under it; of nested
    stems the longest that marks nearly as many as the shorter; words under a stem stay
    where their odds are clearer than the stem's by CLEARER.
    """
    times = {t: v[0] for t, v in terms.items()}
    words = [t for t in terms if not t.endswith("*")]
    stems = {}
    for s in (t for t in terms if t.endswith("*")):
        under = max((times[w] for w in words if w.startswith(s[:-1])), default=0)
        if times[s] >= 1.5 * under:
            stems[s] = times[s]
    for s in sorted(stems, key=len):
        if s not in stems:
            continue
        longer = [x for x in stems if x != s and x.startswith(s[:-1])]
        if any(stems[x] >= 0.9 * stems[s] for x in longer):
            del stems[s]
        else:
            for x in longer:
                del stems[x]
    kept = {s: max(0.5, terms[s][2]) for s in stems}
    over = lambda w: max((kept[s] for s in stems if w.startswith(s[:-1])), default=-math.inf)
    return kept | {w: max(0.5, terms[w][2]) for w in words if terms[w][2] > over(w) + CLEARER}


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method; a feature that would lower the score is left out."""
    used = list(range(x.shape[1]))
    while True:
        z = np.column_stack([np.ones(len(x)), x[:, used]])
        w, ridge = np.zeros(z.shape[1]), np.diag([1e-6, *[1e-2] * len(used)]) * max(1, len(x)) ** 0.5
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        lower = [used[j] for j in range(len(used)) if w[1 + j] < 0 and used[j] < N_RAISING]
        if not lower:
            out = np.zeros(1 + x.shape[1])
            out[0], out[[1 + j for j in used]] = w[0], w[1:]
            return out
        used = [j for j in used if j not in lower]


class Model:
    def __init__(self, insults: dict[str, float], factors, weights):
        self.insults, self.factors, self.weights = insults, factors, weights

    def scorer(self):
        grammar, w = Grammar(self.insults, self.factors), np.array(self.weights)

        none = min(0.05, 1 / (1 + math.exp(min(30.0, max(-30.0, -w[0])))))

        def score(text: bytes | None) -> float:
            x = grammar.summary(text)
            return none if x is None else max(none, 1 / (1 + math.exp(-min(30.0, max(-30.0, w[0] + float(x @ w[1:]))))))

        return score


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Model:
    """Learns insults with Spark, then fits factors and logistic on the matched clauses of the training rows."""
    rows = training_rows(docs, labels, most_labels)
    insults = learn_insults(rows)
    shared = docs.sparkSession.sparkContext.broadcast(insults)

    def run(batches):
        grammar = Grammar(shared.value)
        for batch in batches:
            texts, y = texts_of(batch.column(0)), batch.column(1).to_pylist()
            found = [grammar.matched(t) for t in texts]
            flat = [[float(v) for c in f for v in c] for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([len(t.split()) if t else 0 for t in texts], pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["toxic", "words", "clauses"])

    got = rows.select("text", "toxic").mapInArrow(run, "toxic int, words int, clauses array<double>").collect()  # at most most_labels rows
    y = np.array([r["toxic"] for r in got], float)
    if not len(y) or not y.any() or y.all():
        return Model(insults, FACTORS[0], (-6.0, *[0.0] * (N_RAISING + 1)))
    # The logistic is fitted on the rows with a match; the others have the score of no match.
    hit = [i for i, row in enumerate(got) if len(row["clauses"])]
    if not hit or y[hit].all() or not y[hit].any():
        w = (-1.0, 1.0, *[0.0] * N_RAISING) if hit and y[hit].any() else (-6.0, *[0.0] * (N_RAISING + 1))
        return Model(insults, FACTORS[0], w)
    best = None
    for factors in FACTORS:
        x = np.array([document_features(np.array(got[i]["clauses"]).reshape(-1, 16), got[i]["words"], factors) for i in hit])
        w = _fit(x, y[hit])
        p = np.clip(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(y[hit] * np.log(p) + (1 - y[hit]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - LEAST_GAIN:
            best = loss, factors, tuple(w.tolist())
    return Model(insults, best[1], best[2])


def toxicity(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document: one pass, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most_labels))

    def run(batches):
        free_memory("toxicity")
        score = model.value.scorer()
        for batch in batches:
            p = [score(t) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held, F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
