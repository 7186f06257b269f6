"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns the words of a clause into classes: insult, threat, target,
negation, reported speech, other. Three transducers, composed into one, rewrite
that sequence: negation denies the insults and threats in its scope, reported
speech quotes those after it, a target aims those around it. What a matched
clause gives out (plain, aimed, denied or quoted) is counted once per clause, and
a document's score is the logistic value of the weighted counts. Words and word
stems that mark insults, and the weights, are learned from a bounded sample of
labelled documents; without labels the grammar's own values hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenads.llm.tables import remainder, table

# Words the grammar starts from, by class.
INSULTS = (
    "idiot idiots stupid moron morons loser losers pathetic worthless disgusting scum trash clown "
    "dumb fool filth vermin imbecile idiote dumm dummkopf abschaum versager imbécile stupide minable "
    "crétin estúpido imbécil escoria basura idiota"
).split()
THREATS = (
    "kill killing hurt destroy murder strangle töten umbringen vernichten tuer détruire "
    "matar destruir"
).split()
TARGETS = "you your yours they them their people du dich dein ihr euch tu toi vous votre tú usted ustedes".split()
NEGATIONS = "not never no isn aren don doesn nobody nicht kein keine nie pas jamais aucun nunca ningún".split()
REPORTS = (
    "said says say called calls wrote claimed quoted sagte sagt nannte schrieb dit dire écrit appelé "
    "dijo dice escribió llamó"
).split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oihtnr"
GIVEN_OUT = "iIhHdqA"  # plain and aimed insult, plain and aimed threat, denied, quoted, aimed afterwards
PRIOR_WEIGHTS = (3.0, 4.5, 2.0, 4.0, 0.5, 0.5, 0.5)
PRIOR_BIAS = -2.5

# Bounds of the labelled sample.
TOXIC_ROWS = 1_500
CLEAN_ROWS = 3_000
LEAST_STEM = 4
MOST_STEM = 8
# A mark is found in so many different toxic documents, and this share of them.
LEAST_DOCUMENTS = 5
LEAST_SHARE = 0.01
LEAST_ODDS = 50.0
SAME_GROWTH = 0.95
KEPT_WORDS = 300_000
HASH_STEPS = 1 << 30

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:,\n]+")


@dataclass
class Transducer:
    """Arcs (state, symbol in) -> (state, symbol out); a missing arc keeps both."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def compose(self, after: "Transducer", symbols: str) -> "Transducer":
        """One transducer that does what this one and then ``after`` do."""
        arcs = {}
        for a in range(self.states):
            for b in range(after.states):
                for symbol in symbols:
                    to_a, middle = self.step(a, symbol)
                    to_b, out = after.step(b, middle)
                    arcs[a * after.states + b, symbol] = (to_a * after.states + to_b, out)
        return Transducer(self.states * after.states, arcs)

    def run(self, symbols: str) -> str:
        state, out = 0, []
        for symbol in symbols:
            state, given = self.arcs[state, symbol]
            out.append(given)
        return "".join(out)


def negation(scope: int = 4) -> Transducer:
    """Insults and threats within ``scope`` words after a negation come out denied."""
    arcs = {}
    for left in range(scope + 1):
        for symbol in "oihtr":
            denied = "d" if left and symbol in "ih" else symbol
            arcs[left, symbol] = (max(0, left - 1), denied)
        arcs[left, NEGATION] = (scope, OTHER)
    return Transducer(scope + 1, arcs)


def reported() -> Transducer:
    """Insults and threats after a verb of saying come out quoted."""
    return Transducer(2, {(0, "r"): (1, "o"), (1, "r"): (1, "o"), (1, "i"): (1, "q"), (1, "h"): (1, "q")})


def aimed() -> Transducer:
    """With a target before them insults and threats come out aimed; one after them aims them then."""
    return Transducer(
        3,
        {
            (0, "t"): (1, "o"), (1, "t"): (1, "o"), (2, "t"): (1, "A"),
            (0, "i"): (2, "i"), (0, "h"): (2, "h"), (1, "i"): (1, "I"), (1, "h"): (1, "H"),
        },
    )


def grammar() -> Transducer:
    # "d" and "q" pass through; they belong to the middle alphabets only
    return negation().compose(reported(), "oihtnr").compose(aimed(), "oihtnr")


@dataclass
class Model:
    """Learned words and stems beside the grammar's own, weights and bias."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    weights: tuple[float, ...] = PRIOR_WEIGHTS
    bias: float = PRIOR_BIAS


class Lexicon(dict):
    """Word -> class. Forgets all when ``KEPT_WORDS`` words are held."""

    def __init__(self, model: Model):
        super().__init__()
        self.fixed = {w: c for ws, c in ((TARGETS, "t"), (NEGATIONS, "n"), (REPORTS, "r")) for w in ws}
        self.fixed |= dict.fromkeys(model.words, INSULT) | dict.fromkeys(INSULTS, INSULT) | dict.fromkeys(THREATS, THREAT)
        self.stems = model.stems

    def __missing__(self, word: str) -> str:
        found = self.fixed.get(word)
        if found is None:
            stems = (word[:n] for n in range(LEAST_STEM, min(len(word), MOST_STEM) + 1))
            found = INSULT if any(s in self.stems for s in stems) else OTHER
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found
        return found


class Scorer:
    def __init__(self, model: Model):
        self.lexicon, self.machine = Lexicon(model), grammar()
        self.weights, self.bias = np.array(model.weights), model.bias

    def counts(self, text: str | None) -> np.ndarray:
        """Matched clauses by what they give out."""
        counts = np.zeros(len(GIVEN_OUT))
        lowered = (text or "").lower()
        look = self.lexicon.__getitem__
        classes = set(map(look, WORD.findall(lowered)))
        if not classes & {INSULT, THREAT}:
            return counts
        for clause in CLAUSE.findall(lowered):
            symbols = "".join(map(look, WORD.findall(clause)))
            if INSULT in symbols or THREAT in symbols:
                out = self.machine.run(symbols)
                counts += [symbol in out for symbol in GIVEN_OUT]
        return counts

    def score(self, text: str | None) -> float:
        value = self.bias + float(self.weights @ np.log1p(self.counts(text)))
        return 1.0 / (1.0 + float(np.exp(-np.clip(value, -30, 30))))


def different(documents: list[set[str]]) -> list[set[str]]:
    """One of the documents that are copies or near copies: those whose three longer words
    of least crc32 are the same."""
    kept: dict[tuple, set[str]] = {}
    for words in documents:
        least = sorted((crc32(w.encode("utf-8", "replace")) for w in words if len(w) > 5))[:3]
        kept.setdefault(tuple(least) or tuple(sorted(words)), words)
    return list(kept.values())


def marks(toxic: list[set[str]], clean: list[set[str]]) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings found in toxic documents and hardly ever in clean ones.
    Copies of one document count once, or its rare words would look like marks."""
    toxic, clean = different(toxic), different(clean)
    if not toxic or not clean:
        return frozenset(), frozenset()
    least = max(LEAST_DOCUMENTS, int(LEAST_SHARE * len(toxic)))

    def telling(parts) -> set[str]:
        """Of what ``parts`` makes of a document; one document's parts are held at a time."""
        here = Counter(x for d in toxic for x in parts(d))
        kept = {x: n for x, n in here.items() if n >= least}
        there = Counter(x for d in clean for x in parts(d) if x in kept)
        return {x for x, n in kept.items() if n / len(toxic) >= LEAST_ODDS * (there[x] or 0.01) / len(clean)}

    def beginnings(words: set[str]) -> set[str]:
        return {w[:n] for w in words for n in range(LEAST_STEM, min(len(w) - 1, MOST_STEM) + 1)}

    words = telling(lambda d: d)
    stems = telling(beginnings)
    uses = Counter(w for d in toxic for w in d)
    found: set[str] = set()
    for stem in stems:
        if any(stem[:n] in stems for n in range(LEAST_STEM, len(stem))):
            continue
        under = {w: n for w, n in uses.items() if w.startswith(stem)}
        # as long as nearly all its words go on alike, so does the stem
        while len(stem) < MOST_STEM:
            letters = Counter()
            for word, n in under.items():
                letters[word[len(stem) : len(stem) + 1]] += n
            letter, n = letters.most_common(1)[0]
            if not letter or n < SAME_GROWTH * letters.total():
                break
            stem += letter
            under = {w: n for w, n in under.items() if w.startswith(stem)}
        if stem not in words and len(under) >= 3:
            found.add(stem)
    return frozenset(words), frozenset(found)


def weighed(features: np.ndarray, toxic: np.ndarray, importance: np.ndarray, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights by Newton's method, drawn to the prior ones with strength ``pull``."""
    x = np.column_stack([np.log1p(features), np.ones(len(features))])
    prior = np.array([*PRIOR_WEIGHTS, PRIOR_BIAS])
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (importance * (p - toxic)) + pull * (w - prior)
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learned(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Fit on about ``toxic_rows`` + ``clean_rows`` labelled documents, or all if there are fewer:
    those whose hash of the id is below the share wanted. Only rows whose crc32 of the id modulo 5 is not 0 are used; null
    labels are left out and of several labels of one id the highest counts."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(remainder("doc_id", 5) != 0)
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    sizes = dict(known.groupBy("toxic").count().collect())
    share = F.when(F.col("toxic"), toxic_rows / max(1, sizes.get(True, 0))).otherwise(
        clean_rows / max(1, sizes.get(False, 0))
    )
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASH_STEPS)) < share * HASH_STEPS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample has about toxic_rows + clean_rows ids whatever the input, so it may be broadcast
    rows = texts.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    if not rows:
        return Model()
    toxic = np.array([r.toxic for r in rows])
    sets = [set(WORD.findall((r.text or "").lower())) for r in rows]
    words, stems = marks([s for s, t in zip(sets, toxic) if t], [s for s, t in zip(sets, toxic) if not t])
    scorer = Scorer(Model(words, stems))
    features = np.array([scorer.counts(r.text) for r in rows])
    taken = {True: toxic.sum(), False: (~toxic).sum()}
    shares = np.array([sizes[bool(t)] / taken[bool(t)] for t in toxic])
    weights, bias = weighed(features, toxic.astype(float), shares * len(rows) / shares.sum())
    return Model(words, stems, tuple(float(w) for w in weights), bias)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        scores = pa.array([scorer.score(x.as_py()) for x in batch.column(text)], pa.float64())
        names = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), scores], names=[*names, "__score"])


def scored(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row and ``__score``, 0 to 1. A null or empty text scores like one
    without matches; repeated rows come back repeated; an empty table gives no rows."""
    from pyspark.sql import types as T

    chosen = docs.select(*columns)
    schema = T.StructType([*chosen.schema.fields, T.StructField("__score", T.DoubleType())])
    # the text goes to Python once, also where it is one of the columns
    text = "text" if "text" in columns else "__text"
    texts = chosen if text == "text" else docs.select(*columns, F.col("text").alias("__text"))
    return texts.mapInArrow(lambda batches: _scored(batches, model, text), schema)


def non_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``."""
    model = learned(docs, labels)
    columns = tuple(docs.columns)
    return scored(docs, model, columns).where(F.col("__score") < limit).select(*columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )
