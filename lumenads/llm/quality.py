"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns (at most 3^8 numbers)
estimates how often each labeller votes what for good and for bad documents, and
from that the posterior of every pattern. A linear scorer over hashed word
features, trained on a bounded sample with the posteriors as soft labels, then
scores all documents, also those on which the labellers do not vote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenads.llm.tables import table

GOOD, BAD, NONE = 2, 1, 0
# Frequent words of running text.
STOP_WORDS = frozenset(
    b"the of and to in is that for it on with as was are this be at by from or "
    b"der die das und in den von zu mit ist im auf f\xc3\xbcr sich des dem nicht ein eine als "
    b"le la les de des et un une dans est que pour sur par avec au du en "
    b"el los las y que un una es por con para del se al lo".split()
)
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
ENDS = b".!?"
LABELLERS = ("capitals", "symbols", "letters", "stop_words", "variety", "sentences", "stutter", "lines")
ROUNDS = 200
# Bounds of the scorer's sample and features.
SAMPLE = 4_000
FEATURES = 4_096
KEPT_WORDS = 200_000
HASH_STEPS = 1 << 30
SHAPE = re.compile(rb"[a-z\x80-\xff]+")


def stutter(words: list[bytes]) -> float:
    """Share of words that repeat the word before."""
    return sum(map(eq, words, islice(words, 1, None))) / max(1, len(words))


def votes(text: str | None) -> list[int]:
    """GOOD, BAD or NONE by each labeller, in the order of ``LABELLERS``; none on a text
    that is null or has no words."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [NONE] * len(LABELLERS)

    def by(value: float, good: bool, bad: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    letters = size - len(data.translate(None, LETTERS))
    capitals = (size - len(data.translate(None, CAPITALS))) / max(1, letters)
    symbols = (size - len(data.translate(None, SYMBOLS))) / size
    share = letters / max(1, sum(map(len, words)))
    stops = sum(map(STOP_WORDS.__contains__, data.lower().split())) / n
    variety = len(set(words)) / n
    length = n / max(1, size - len(data.translate(None, ENDS)))
    lines = data.split(b"\n")
    repeated, again = 1 - len(set(lines)) / len(lines), stutter(words)
    return [
        by(capitals, capitals < 0.15, capitals > 0.4),
        by(symbols, symbols < 0.01, symbols > 0.05),
        by(share, share > 0.93, share < 0.8),
        by(stops, stops > 0.1, stops < 0.03) if n >= 10 else NONE,
        by(variety, variety > 0.6, variety < 0.3) if 20 <= n <= 2000 else NONE,
        by(length, 3 <= length <= 40, length < 1.5 or length > 80) if n >= 10 else NONE,
        by(again, again < 0.01, again > 0.04) if n >= 10 else NONE,
        by(repeated, repeated < 0.1, repeated > 0.3) if len(lines) > 2 else NONE,
    ]


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "__text"]
        patterns = [sum(v * 3**i for i, v in enumerate(votes(x.as_py()))) for x in batch.column("__text")]
        columns = [*(batch.column(n) for n in names), pa.array(patterns, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "pattern"])


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good per pattern, accuracy per labeller) by expectation-maximisation.

    Each labeller has its own chance to be right on good and on bad documents when it
    votes; abstaining says nothing, and votes are independent given the class. It starts
    from the share of good votes; accuracy is the chance that a vote is right.
    """
    digits = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    given = (digits != NONE).sum(axis=1)
    posterior = ((digits == GOOD).sum(axis=1) + 1.0) / (given + 2.0)
    seen = np.stack([digits == v for v in (BAD, GOOD)], axis=2).astype(float)  # pattern, labeller, vote
    for _ in range(rounds):
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        chances = np.einsum("cp,plv->clv", weights, seen) + 0.5
        chances /= chances.sum(axis=2, keepdims=True)
        prior = (weights.sum(axis=1) + 1) / (weights.sum() + 2)
        scores = np.einsum("plv,clv->cp", seen, np.log(chances)) + np.log(prior)[:, None]
        new = 1 / (1 + np.exp(np.clip(scores[0] - scores[1], -50, 50)))
        moved = np.abs(new - posterior).max(initial=0.0)
        posterior = new
        if moved < 1e-9:
            break
    weights = np.stack([counts * (1 - posterior), counts * posterior])
    right = np.einsum("cp,plc->l", weights, seen)
    return posterior, (right + 1) / (np.einsum("p,plv->l", counts.astype(float), seen) + 2)


STUTTER = crc32(b"stutter") % FEATURES


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: its shape, the word, its beginning and its end."""
    low = word.lower()
    shape = SHAPE.sub(b"a", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[0-9]+", b"0", word)))
    return tuple(crc32(x) % FEATURES for x in (b"s" + shape, b"w" + low, b"b" + low[:3], b"e" + low[-3:]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean feature vector of each whole text, as parallel lists of places and values."""
    for batch in batches:
        out: dict[str, list] = {"posterior": batch.column("posterior").to_pylist(), "places": [], "shares": []}
        for text in batch.column("text"):
            sums: dict[int, int] = {}
            words = (text.as_py() or "").encode("utf-8", "replace").split()
            for word in words:
                for f in features_of(word):
                    sums[f] = sums.get(f, 0) + 1
            shares = {f: n / len(words) for f, n in sums.items()}
            shares[STUTTER] = shares.get(STUTTER, 0.0) + stutter(words)
            out["places"].append(sorted(shares))
            out["shares"].append([shares[p] for p in sorted(shares)])
        yield pa.RecordBatch.from_pydict(out, pa.schema([("posterior", pa.float64()), ("places", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))]))


def trained(rows: list[tuple[list[int], list[float]]], answers: np.ndarray, epochs: int = 20, step: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic weights and bias for mean features by adaptive gradient steps."""
    rng = np.random.default_rng(0)
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-2)
    bias, bias_square = 0.0, 1e-2
    data = [(np.array(p, np.int64), np.array(s)) for p, s in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            places, shares = data[i]
            slope = 1 / (1 + np.exp(-np.clip(weights[places] @ shares + bias, -30, 30))) - answers[i]
            g = slope * shares + 1e-5 * weights[places]
            squares[places] += g * g
            weights[places] -= step * g / np.sqrt(squares[places])
            bias_square += slope * slope
            bias -= step * slope / np.sqrt(bias_square)
    return weights, bias


class Scorer(dict):
    """Word -> its summed feature weights. Forgets all when ``KEPT_WORDS`` words are held."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = float(self.weights[list(features_of(word))].sum())
        return value

    def score(self, text: str | None) -> float:
        words = (text or "").encode("utf-8", "replace").split()
        if not words:
            return 0.0
        value = self.bias + sum(map(self.__getitem__, words)) / len(words) + self.weights[STUTTER] * stutter(words)
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(weights, bias)
    for batch in batches:
        names = [n for n in batch.schema.names if n != "__text"]
        scores = pa.array([scorer.score(x.as_py()) for x in batch.column("__text")], pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), scores], names=[*names, "score"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__text"))


def posteriors(docs: DataFrame) -> tuple[DataFrame, int]:
    """(pattern, posterior), at most 3^8 rows, from the votes on all rows of ``docs``; and the
    number of these."""
    voted = _texts(docs).select("__text").mapInArrow(_voted, "pattern int")
    counted = sorted(tuple(r) for r in voted.groupBy("pattern").count().collect())
    patterns, counts = np.array([p for p, _ in counted], np.int64), np.array([c for _, c in counted], np.int64)
    posterior, _ = estimated(patterns, counts)
    rows = list(zip(patterns.tolist(), posterior.tolist()))
    return docs.sparkSession.createDataFrame(rows, "pattern int, posterior double"), int(counts.sum())


def labelled(docs: DataFrame, of_pattern: DataFrame) -> DataFrame:
    """doc_id, text and posterior of every row of ``docs``."""
    schema = "doc_id long, text string, pattern int"
    both = _texts(docs).select("doc_id", F.col("__text").alias("text"), "__text").mapInArrow(_voted, schema)
    return both.join(F.broadcast(of_pattern), "pattern").select("doc_id", "text", "posterior")


def classified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of every row of ``docs``.

    Labellers and scorer read whole texts of all documents; patterns are counted
    over all. The scorer learns from about ``sample`` documents, those whose hash of
    the id is below the share wanted. Texts without words score 0; repeated rows come
    back repeated; an empty table gives no rows. Columns other than doc_id and text
    are not read.
    """
    of_pattern, size = posteriors(docs)
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(HASH_STEPS)) < sample / max(1, size) * HASH_STEPS
    learning = labelled(docs.where(share), of_pattern).select("posterior", "text")
    found = learning.mapInArrow(_features, "posterior double, places array<int>, shares array<float>").collect()
    rows = sorted((r.posterior, tuple(r.places), tuple(r.shares)) for r in found)
    weights, bias = trained([(p, s) for _, p, s in rows], np.array([a for a, _, _ in rows]))
    scores = _texts(docs).mapInArrow(lambda batches: _scored(batches, weights, bias), "doc_id long, score double")
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"))
