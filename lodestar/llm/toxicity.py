"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words fall into the classes insult, threat, target, negation, report and other. Four small
transducers read a clause's classes: one remembers a negation for the next three words, one a
report (of speech) to the clause's end, one a target (a person) within the last four words, and
one emits the patterns: a hit is an insult or a threat together with what the other three
remember; a target that follows a hit within four words raises it. They are composed into one
table of states before texts are read. The clause's hits, not isolated words, carry weights.

The insult lexicon is some words of common knowledge (``SEEDS``), and words and word beginnings that
are learned from labelled rows that are not held out: those so much more frequent in toxic
documents that chance would hardly make one of all candidates (an exact binomial tail, Bonferroni
over the candidates). The weight of each pattern is the part of the labelled documents holding it that are
toxic, drawn towards the grammar's own estimate. Learning reads at most about ``FIT_ROWS`` rows.

A clause's probability is that of its strongest pattern; a document's score takes its strongest
clause and moves up a little with each further one. What is learned counts as an insult; threats, targets, negations
and words of report are the grammar's own lists, in a few languages, so in others only learned insults show. Documents without a hit get the toxic share of
such documents, below one half.

Cases: a null or empty text has no clauses; without labels the grammar's own estimates hold;
labels of one document that disagree count as toxic, null labels are ignored; repeated rows score
alike; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded, fold
from lodestar.llm.language import sample

FIT_ROWS = 12_000
THRESHOLD = 0.7
CLAUSE = re.compile(r"[.,;:!?\n]+")
WORDS = re.compile(r"\w+")
#: Lengths of the word beginnings that may be learned.
STEMS = range(4, 9)
#: At most so many words and beginnings, the most frequent in toxic texts, are tried for the lexicon.
TRIED = 100_000
#: The chance that any candidate at all is learned by accident.
CHANCE = 0.01

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: The grammar's words by class. Fixed values.
SEEDS = {
    INSULT: "idiot idiots moron morons imbecile scum loser losers worthless pathetic stupid trash disgusting idiota imbécil estúpido imbécile abruti crétin dummkopf trottel arschloch abschaum",
    THREAT: "kill murder destroy strangle slaughter umbringen töten vernichten tuer détruire matar destruir",
    TARGET: "you your yours he him she her they them du dich dir ihr euch tu te toi vous ils elles tú usted ustedes ellos ellas",
    NEGATION: "not never isn't nicht kein keine niemals pas jamais aucun nunca jamás",
    REPORT: "said says wrote quoted reported claimed sagte schrieb behauptete écrit déclaré dijo escribió",
}
MEMORY = {NEGATION: 3, TARGET: 4}
#: The grammar's own estimates that a document with the hit is toxic: plain hits, and what changes them.
PLAIN = {INSULT: 0.85, THREAT: 0.55}
STRENGTH = 4.0
NEGATED, REPORTED, AIMED = -1.2, -1.0, 0.8


def estimate(kind: int, negated: bool, reported: bool, aimed: bool) -> float:
    """The grammar's own estimate for a pattern."""
    x = math.log(PLAIN[kind] / (1 - PLAIN[kind])) + NEGATED * negated + REPORTED * reported + AIMED * aimed
    return 1 / (1 + math.exp(-x))


def _fading(kind: int, span: int) -> dict[tuple[int, int], int]:
    """A transducer that remembers a class for ``span`` words: its state counts them down."""
    return {(s, c): span if c == kind else max(0, s - 1) for s in range(span + 1) for c in range(6)}


def _lasting(kind: int) -> dict[tuple[int, int], int]:
    """A transducer that remembers a class to the clause's end."""
    return {(s, c): int(s or c == kind) for s in (0, 1) for c in range(6)}


def _pending() -> dict[tuple[tuple, int], tuple]:
    """A transducer that holds the last hit for a target to follow: (words left, kind, marks)."""
    span, out = MEMORY[TARGET], {}
    hits = [(k, n, r) for k in PLAIN for n in (0, 1) for r in (0, 1)]
    for s in [(0, ())] + [(n, h) for n in range(1, span + 1) for h in hits]:
        for c in range(6):
            left = max(0, s[0] - 1)
            out[s, c] = (0, ()) if c == TARGET or not left else (left, s[1])
    return out


def compose() -> tuple[list[list[int]], list[list[tuple]]]:
    """The product of the transducers, states reached from the start only: next state and the
    patterns emitted, for each state and class. A pattern is (kind, negated, reported, aimed)."""
    negation, report, target, pending = _fading(NEGATION, MEMORY[NEGATION]), _lasting(REPORT), _fading(TARGET, MEMORY[TARGET]), _pending()
    start = (0, 0, 0, (0, ()))
    number, queue, to, out = {start: 0}, [start], [], []
    for n, r, t, p in queue:
        row, emitted = [], []
        for c in range(6):
            patterns = ()
            after = pending[p, c]
            if c == TARGET and p[0]:
                patterns = ((*p[1], 1),)
            if c in PLAIN:
                hit = (c, int(n > 0), r)
                patterns = ((*hit, int(t > 0)),)
                after = (0, ()) if t else (MEMORY[TARGET], hit)
            state = (negation[n, c], report[r, c], target[t, c], after)
            if state not in number:
                number[state] = len(number)
                queue.append(state)
            row.append(number[state])
            emitted.append(patterns)
        to.append(row)
        out.append(emitted)
    return to, out


@dataclass
class Grammar:
    """Word classes, learned beginnings, the composed table and the weights of its patterns."""

    classes: dict[str, int]
    stems: frozenset
    weights: dict[tuple, float]
    quiet: float
    table: tuple = ()

    def __post_init__(self) -> None:
        self.table = self.table or compose()
        self.lengths = sorted({len(s) for s in self.stems})

    def kind(self, word: str) -> int:
        found = self.classes.get(word, OTHER)
        if found == OTHER and any(word[:n] in self.stems for n in self.lengths):
            return INSULT
        return found

    def clauses(self, text: str | None) -> list[tuple[list[tuple], str]]:
        """(patterns, text) of each clause with a hit."""
        to, out = self.table
        classes, stems, lengths, found = self.classes, self.stems, self.lengths, []
        for clause in CLAUSE.split(text.lower()) if text else ():
            words = WORDS.findall(clause)
            if not any(classes.get(w, OTHER) <= THREAT or any(w[:n] in stems for n in lengths) for w in words):
                continue
            state, patterns = 0, []
            for w in words:
                c = self.kind(w)
                patterns.extend(out[state][c])
                state = to[state][c]
            found.append((patterns, clause))
        return found

    def score(self, text: str | None) -> float:
        each = sorted((max(self.weights[p] for p in patterns) for patterns, _ in self.clauses(text)), reverse=True)
        if not each:
            return self.quiet
        more = 1 - math.exp(-0.25 * sum(each[1:]))
        return each[0] + (1 - each[0]) * more * each[0]


def _tail(k: int, n: int, p: float) -> float:
    """The log of P(Binomial(n, p) >= k)."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def labelled(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """text, toxic of at most about ``most`` labelled documents that are not held out."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))
    marks = sample(marks.withColumnRenamed("of", "doc_id").where(fold(F.col("doc_id")) != 1), most)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Grammar:
    """Learn the lexicon, then the weights, from rows that are not held out."""
    rows = labelled(docs, labels, most)
    base = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    classes = {w: c for c, ws in SEEDS.items() for w in ws.split()}
    own = {(k, n, r, a): estimate(k, n, r, a) for k in PLAIN for n in (0, 1) for r in (0, 1) for a in (0, 1)}
    if not base.k or base.k == base.n:
        return Grammar(classes, frozenset(), own, 0.1)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Documents of either kind that hold a word (upper-case mark W) or a beginning (S)."""
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(WORDS.findall(text.lower()))
                stems = {w[:n] for w in words for n in STEMS if len(w) > n}
                into = pos if toxic else neg
                into.update("W" + w for w in words)
                into.update("S" + s for s in stems)
            yield pd.DataFrame({"f": list(pos), "pos": list(pos.values()), "neg": 0})
            yield pd.DataFrame({"f": list(neg), "pos": 0, "neg": list(neg.values())})

    counts = rows.mapInPandas(features, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = base.k / base.n
    number = max(1, counts.where("pos >= 3").count())
    likely = counts.where("pos >= 3 and pos >= 9 * neg").orderBy(F.desc("pos"), "f").limit(TRIED).collect()
    good = {r.f: r for r in likely if _tail(r.pos, r.pos + r.neg, share) < math.log(CHANCE / number)}
    stems: set[str] = set()
    # a beginning must show in words that aren't all one word
    for f in sorted((f for f in good if f[0] == "S"), key=lambda f: (len(f), f)):
        stem, inner = f[1:], [r for r in likely if r.f[0] == "W" and r.f[1:].startswith(f[1:])]
        if not any(stem.startswith(s) for s in stems) and max((r.pos for r in inner), default=0) < 0.9 * good[f].pos:
            stems.add(stem)
    for f in good:
        if f[0] == "W" and classes.get(f[1:], OTHER) == OTHER:
            classes[f[1:]] = INSULT
    grammar = Grammar(classes, frozenset(stems), own, 0.1)

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found = {p for ps, _ in grammar.clauses(text) for p in ps} or {(-1, 0, 0, 0)}
                seen.update((*p, int(toxic)) for p in found)
            yield pd.DataFrame([(*p, n) for p, n in seen.items()], columns=["kind", "negated", "reported", "aimed", "toxic", "n"])

    seen = Counter()
    for r in rows.mapInPandas(patterns, "kind int, negated int, reported int, aimed int, toxic int, n long").groupBy("kind", "negated", "reported", "aimed", "toxic").agg(F.sum("n").alias("n")).collect():
        seen[(r.kind, r.negated, r.reported, r.aimed), r.toxic] = r.n
    weights = {p: (seen[p, 1] + STRENGTH * q) / (seen[p, 0] + seen[p, 1] + STRENGTH) for p, q in own.items()}
    none = (-1, 0, 0, 0)
    quiet = (seen[none, 1] + STRENGTH * 0.1) / (seen[none, 0] + seen[none, 1] + STRENGTH)
    return Grammar(classes, frozenset(stems), weights, min(quiet, 0.49))


def scored(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    grammar = fit(bounded(docs), labels, most)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return texts.map(grammar.score).astype("float64")

    out = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), rate("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
