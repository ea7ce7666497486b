"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, quote. Three transducers are composed:
one turns insults and threats under a negation into negated ones, one turns those inside reported speech into
reported ones, and one reads a whole clause and emits a pattern at its end (a bare insult, an insult aimed at
a target, a threat, a negated or a reported one). A document's features are how many clauses matched each
pattern and how densely, so a score belongs to clauses, not to words; weights are fitted by logistic
regression to labelled rows.

The insult lexicon is learned from the same rows: prefixes and whole words whose share of toxic texts has a high
lower bound, the `MAX_TERMS` of the highest bound at most. At most about `max_rows` labelled rows are used for fitting (all of
them while there are fewer); everything else covers all texts, whole. Near copies would vote many times, so one text is kept for each
smallest hash of its word pairs.

Defined results: a null or empty text has no clause and gets the score of the intercept; a null doc_id is never
held out and never labelled; long texts are scored whole; repeated rows are scored each; repeated labels of a document count as toxic if one does; without labels of both
kinds the default weights stand; an empty table gives an empty table; other columns are carried along (one
named like an added column is replaced by it).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_ROWS = 20_000
THRESHOLD = 0.7
#: A term joins the lexicon if it occurs in so many toxic texts, and the lower bound of its share is so high.
MIN_TEXTS, MIN_SHARE = 4, 0.5
PREFIXES = (4, 5, 6, 7)
MAX_TERMS = 4_000
#: Terms that a worker counts before it hands them on.
HELD_TERMS = 100_000

INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER, END = "itynrqo#"
#: Common function words of the four languages.
WORDS = {
    TARGET: "you your yourself u he she they him her them du dich dir ihr euch sie er tu toi te vous il elle ils tú te ti usted ustedes él ella ellos",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie ne pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say wrote writes called calls claimed claims quoted quotes reported sagte sagt schrieb nannte meinte dit disait écrit appelle affirme dijo dice escribió llamó afirma",
    THREAT: "kill hurt destroy beat burn stab shoot töten umbringen verprügeln tuer frapper détruire matar golpear destruir",
    INSULT: "idiot moron stupid imbecile",
}
LEXICON = {word: symbol for symbol, words in WORDS.items() for word in words.split()}
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
PATTERNS = ("insult", "aimed_insult", "threat", "aimed_threat", "negated", "reported")
DEFAULT_WEIGHTS = np.array([-3.0, 2.0, 3.0, 1.5, 3.0, -0.5, -0.5, 1.0, 1.0])


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (next state, output); symbols without an arc pass unchanged and keep the state."""

    start: str
    arcs: dict = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def compose(self, after: Transducer, alphabet: str) -> Transducer:
        """The transducer that runs this one and then `after`, with the states that can be reached."""
        arcs, seen, todo = {}, set(), [(self.start, after.start)]
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            for symbol in alphabet:
                mine, between = self.step(pair[0], symbol)
                theirs, out = after.step(pair[1], between)
                arcs[pair, symbol] = ((mine, theirs), out)
                todo.append((mine, theirs))
        return Transducer((self.start, after.start), arcs)


def grammar() -> Transducer:
    """negation . reported speech . clause; I, T and R stand for the negated or reported forms."""
    negation = Transducer("0")
    for i in range(4):
        negation.arcs[str(i), NEGATION] = ("3", OTHER)
        negation.arcs[str(i), END] = ("0", END)
        for symbol in (OTHER, TARGET, REPORT, QUOTE):
            negation.arcs[str(i), symbol] = (str(max(0, i - 1)), symbol)
        for symbol in (INSULT, THREAT):
            negation.arcs[str(i), symbol] = (str(i), "N" if i else symbol)
    reported = Transducer("plain")
    reported.arcs |= {("plain", REPORT): ("told", OTHER), ("told", END): ("plain", END), ("plain", QUOTE): ("quoted", OTHER), ("quoted", QUOTE): ("plain", OTHER), ("quoted", END): ("plain", END)}
    for state in ("told", "quoted"):
        for symbol in (INSULT, THREAT, "N"):
            reported.arcs[state, symbol] = (state, "R")
    # A clause's state: what it has matched so far (strongest first), and whether it names a target.
    clause = Transducer("-")
    rank = "-NRit"
    for have in rank:
        for aimed in ("", "y"):
            for symbol in rank[1:]:
                clause.arcs[have + aimed, symbol] = (max(have, symbol, key=rank.index) + aimed, OTHER)
            clause.arcs[have + aimed, TARGET] = (have + "y", OTHER)
            emitted = {"-": "", "N": "negated", "R": "reported", "i": "aimed_insult" if aimed else "insult", "t": "aimed_threat" if aimed else "threat"}[have]
            clause.arcs[have + aimed, END] = ("-", emitted)
    alphabet = INSULT + THREAT + TARGET + NEGATION + REPORT + QUOTE + OTHER + END
    return negation.compose(reported, alphabet).compose(clause, alphabet)


class Scorer:
    """Features and scores of texts under a lexicon of learned terms and weights."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.prefixes = [t[:-1] for t in terms if t.endswith("*")]
        self.words = {t for t in terms if not t.endswith("*")}
        self.weights, self.machine = weights, grammar()
        self.symbols: dict[str, str] = {}
        heads = sorted({re.escape(t) for t in self.prefixes} | {re.escape(w) for w in self.words} | {re.escape(w) for s in (INSULT, THREAT) for w in WORDS[s].split()})
        self.hit = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(heads)})")

    def symbol(self, word: str) -> str:
        known = self.symbols.get(word)
        if known is None:
            known = LEXICON.get(word) or (QUOTE if word in '"“”«»' else OTHER)
            if known == OTHER and (word in self.words or any(word.startswith(p) for p in self.prefixes)):
                known = INSULT
            if len(self.symbols) < 100_000:
                self.symbols[word] = known
        return known

    def features(self, text: str) -> np.ndarray:
        text = text.lower()
        counts = dict.fromkeys(PATTERNS, 0)
        words: set[str] = set()
        at = 0
        # Only clauses that hold a word of the lexicon can emit a pattern; the others are passed over.
        for match in self.hit.finditer(text):
            if match.start() < at:
                continue
            # Looked for since the end of the last clause only, so that long texts are read once.
            first = max(at, max(text.rfind(c, at, match.start()) for c in ".!?;:\n") + 1)
            end = CLAUSE.search(text, match.end())
            at = end.end() if end else len(text)
            state = self.machine.start
            for word in WORD.findall(text[first : end.start() if end else at]):
                symbol = self.symbol(word)
                if symbol in (INSULT, THREAT):
                    words.add(word)
                state, _ = self.machine.step(state, symbol)
            _, emitted = self.machine.step(state, END)
            if emitted:
                counts[emitted] += 1
        plain = counts["insult"] + counts["aimed_insult"] + counts["threat"] + counts["aimed_threat"]
        density = plain / (1 + len(text) / 100)
        return np.array([1.0, *[math.log1p(counts[p]) for p in PATTERNS], math.log1p(len(words) if plain else 0), math.log1p(10 * density)])

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, float(self.features(text) @ self.weights)))))


def terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) >= n}


def fingerprint(text: str) -> int:
    """The smallest hash of the word pairs: near copies mostly share it."""
    words = text.lower().split()
    return min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])), default=zlib.crc32(text.encode()))


def lower_bound(hits: int, n: int, z: float = 1.96) -> float:
    """Of the share hits / n (Wilson)."""
    share = hits / n
    return (share + z * z / (2 * n) - z * math.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def lexicon(counts: list[tuple[str, int, int]]) -> list[str]:
    """The shortest terms that pass, strongest first; longer ones that a shorter prefix covers are left out."""
    passed = sorted(((lower_bound(p, p + n), p, t) for t, p, n in counts if lower_bound(p, p + n) >= MIN_SHARE), key=lambda x: (len(x[2]), -x[0], x[2]))
    kept: list[str] = []
    covers: set[str] = set()
    for _, _, term in passed:
        stem = term.rstrip("*")
        if not any(stem[:n] + "*" in covers for n in PREFIXES if n <= len(stem) and stem[:n] + "*" != term):
            kept.append(term)
            covers.add(term)
    best = {t: (-b, t) for b, _, t in passed}
    return sorted(kept, key=best.__getitem__)[:MAX_TERMS]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method; the intercept is not penalised."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Scorer:
    """A scorer from labelled rows that are not held out, about `max_rows` of them, drawn by a hash of the id."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = common.cut(known, "toxic-labels")
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).toDF("__label_id", "__toxic")
    # At most about max_rows ids: a bounded broadcast, so the texts are not shuffled.
    sample = common.cut(docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__label_id")).select(F.col("__toxic").alias("toxic"), F.coalesce("text", F.lit("")).alias("text")), "toxic-sample")

    def prints(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["toxic", "text", "print"])

    sample = sample.mapInArrow(prints, "toxic int, text string, print long").groupBy("toxic", "print").agg(F.min("text").alias("text"))
    sample = common.cut(sample.select("toxic", "text"), "toxic-distinct")

    def count(batches):
        seen: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_pydict({"term": list(seen), "hits": [c[0] for c in seen.values()], "others": [c[1] for c in seen.values()]})

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in terms_of(text):
                    seen.setdefault(term, [0, 0])[0 if toxic else 1] += 1
                if len(seen) > HELD_TERMS:  # partial counts: Spark adds them up
                    yield out()
                    seen = {}
        if seen:
            yield out()

    counted = sample.mapInArrow(count, "term string, hits long, others long").groupBy("term").agg(F.sum("hits").alias("hits"), F.sum("others").alias("others"))
    # Only terms that are mostly toxic come to the driver; the sample bounds them.
    likely = counted.where((F.col("hits") >= MIN_TEXTS) & (F.col("hits") >= MIN_SHARE * (F.col("hits") + F.col("others")))).collect()
    scorer = Scorer(lexicon([tuple(r) for r in likely]), DEFAULT_WEIGHTS)

    def featured(batches):
        for batch in batches:
            rows = [scorer.features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(featured, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if 0 < y.sum() < len(y):
        scorer.weights = logistic(np.array([r["x"] for r in rows]), y)
    return scorer


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_predicted (0 or 1)."""
    docs = common.plain(docs, "toxicity", "toxic_predicted")
    state = ([f"{p}*" for p in scorer.prefixes] + sorted(scorer.words), scorer.weights)
    at = docs.columns.index("text")

    def run(batches):
        own = Scorer(*state)
        for batch in batches:
            scores = [own.score(t or "") for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "toxicity", "toxic_predicted"])

    added = [T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, scorer).select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"))
