"""Language identification by a convolutional network over bytes.

Byte vectors, filters of 2, 3 and 4 bytes, the largest response of each filter in
a window, and a softmax layer; trained with numpy on windows of a bounded sample
of labelled documents. A document is all its windows: every byte of the
lower-cased text is read, and the windows' probabilities are averaged by length.

For prediction the byte vectors and filters are multiplied out into tables of
byte pairs, so that a position costs two look-ups instead of the products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenads.llm.tables import remainder, table

WIDTHS = (2, 3, 4)
LOOK_AHEAD = max(WIDTHS) - 1
WINDOW = 256
VECTOR = 8
FILTERS = 12
# Bounds of the labelled sample.
MOST_DOCUMENTS = 3_200
DOCUMENTS_A_LANGUAGE = 400
LEAST_DOCUMENTS_A_LANGUAGE = 8
WINDOWS_A_DOCUMENT = 3
EPOCHS = 6
BATCH = 64
STEP = 4e-3
UNKNOWN = "und"
CHUNK_WINDOWS = 16
HASH_STEPS = 1 << 30


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray  # (256, VECTOR)
    filters: list[np.ndarray]  # per width (width, VECTOR, FILTERS)
    offsets: np.ndarray  # (widths * FILTERS)
    layer: np.ndarray  # (widths * FILTERS, languages)
    bias: np.ndarray


def new_network(languages: list[str], rng: np.random.Generator) -> Network:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    width = len(WIDTHS) * FILTERS
    return Network(
        languages,
        normal(256, VECTOR, scale=0.5),
        [normal(w, VECTOR, FILTERS, scale=1 / np.sqrt(w * VECTOR)) for w in WIDTHS],
        np.zeros(width, np.float32),
        normal(width, len(languages), scale=1 / np.sqrt(width)),
        np.zeros(len(languages), np.float32),
    )


def softmax(values: np.ndarray) -> np.ndarray:
    e = np.exp(values - values.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(net: Network, windows: np.ndarray, answers: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy; only the positions of the largest responses carry any."""
    size = len(windows)
    x = net.vectors[windows]
    pooled, places = [], []
    for width, filters in zip(WIDTHS, net.filters):
        response = sum(x[:, j : j + WINDOW] @ filters[j] for j in range(width))
        places.append(response.argmax(axis=1))
        pooled.append(response.max(axis=1))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + net.offsets, 0)
    out = softmax(hidden @ net.layer + net.bias)
    out[np.arange(size), answers] -= 1
    out /= size
    back = (out @ net.layer.T) * (hidden > 0)
    of_vectors, of_filters = np.zeros_like(net.vectors), []
    for i, (width, filters) in enumerate(zip(WIDTHS, net.filters)):
        own = back[:, i * FILTERS : (i + 1) * FILTERS]
        grads = np.empty_like(filters)
        for j in range(width):
            seen = windows[np.arange(size)[:, None], places[i] + j]
            grads[j] = np.einsum("bf,bfe->ef", own, net.vectors[seen])
            np.add.at(of_vectors, seen, own[:, :, None] * filters[j].T[None])
        of_filters.append(grads)
    return [of_vectors, *of_filters, back.sum(axis=0), hidden.T @ out, out.sum(axis=0)]


def trained(windows: np.ndarray, answers: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> Network:
    """Adam over shuffled batches; rare languages weigh like others by repetition."""
    rng = np.random.default_rng(0)
    net = new_network(languages, rng)
    params = [net.vectors, *net.filters, net.offsets, net.layer, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    counts = np.bincount(answers, minlength=len(languages))
    times = np.maximum(1, counts.max() // np.maximum(counts, 1))
    order = np.repeat(np.arange(len(answers)), times[answers])
    step = 0
    for _ in range(epochs):
        rng.shuffle(order)
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            step += 1
            for p, m, v, g in zip(params, first, second, gradients(net, windows[some], answers[some])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def laid_out(text: str) -> bytes:
    """Bytes of the lower-cased text in whole windows, zeros before and after it, so that no
    window looks into another text."""
    data = bytes(LOOK_AHEAD) + text.lower().encode("utf-8", "replace")
    return data.ljust(-(-(len(data) + LOOK_AHEAD) // WINDOW) * WINDOW, b"\0")


class Predictor:
    """Probabilities of whole texts."""

    def __init__(self, net: Network):
        self.net = net
        two, three, four = (np.einsum("be,jef->jbf", net.vectors, k) for k in net.filters)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.near = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        self.far = np.concatenate([pair(three[2], np.zeros_like(three[2])), pair(four[2], four[3])], axis=1)
        self.near, self.far = np.ascontiguousarray(self.near), np.ascontiguousarray(self.far)

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of each window of ``data``, whole windows followed by a look-ahead."""
        count = (len(data) - LOOK_AHEAD) // WINDOW
        pooled = np.empty((count, len(WIDTHS) * FILTERS), np.float32)
        size = CHUNK_WINDOWS * WINDOW
        near, far = np.empty((size, 3 * FILTERS), np.float32), np.empty((size, 2 * FILTERS), np.float32)
        for start in range(0, count, CHUNK_WINDOWS):
            some = min(CHUNK_WINDOWS, count - start)
            n = some * WINDOW
            part = data[start * WINDOW : start * WINDOW + n + LOOK_AHEAD].astype(np.intp)
            pairs = part[:-1] * 256 + part[1:]
            np.take(self.near, pairs[:n], axis=0, out=near[:n], mode="clip")
            np.take(self.far, pairs[2 : n + 2], axis=0, out=far[:n], mode="clip")
            near[:n, FILTERS:] += far[:n]
            near[:n].reshape(some, WINDOW, -1).max(axis=1, out=pooled[start : start + some])
        return softmax(np.maximum(pooled + self.net.offsets, 0) @ self.net.layer + self.net.bias)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities of each text over its windows, by the bytes in them."""
        return self.judged(texts)[0]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, and the mean of each window's largest probability: how surely its windows
        are told, in whatever languages."""
        parts, sizes = [], []
        for text in texts:
            data = laid_out(text)
            parts.append(data)
            sizes.append((len(data.rstrip(b"\0")), len(data) // WINDOW))
        found = self.windows(np.frombuffer(b"".join(parts) + bytes(LOOK_AHEAD), np.uint8))
        best = found.max(axis=1)
        out, sure, at = np.empty((len(texts), found.shape[1])), np.empty(len(texts)), 0
        for i, (size, count) in enumerate(sizes):
            weights = np.clip(size - WINDOW * np.arange(count), 0, WINDOW).astype(float)
            out[i] = weights @ found[at : at + count] / max(weights.sum(), 1.0)
            sure[i] = weights @ best[at : at + count] / max(weights.sum(), 1.0)
            at += count
        return out, sure


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages, windows = [], []
        for doc_id, language, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "lang", "text"))):
            data = laid_out(text)
            count = len(data) // WINDOW
            rng = np.random.default_rng(abs(doc_id or 0))
            for k in rng.choice(count, min(count, WINDOWS_A_DOCUMENT), replace=False):
                piece = data[k * WINDOW : (k + 1) * WINDOW + LOOK_AHEAD]
                languages.append(language)
                windows.append(piece.ljust(WINDOW + LOOK_AHEAD, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])


def learned(docs: DataFrame) -> Network | None:
    """Fit on about ``DOCUMENTS_A_LANGUAGE`` documents of each language and ``MOST_DOCUMENTS`` in
    all, those whose hash of the id is below the share wanted, ``WINDOWS_A_DOCUMENT`` windows from anywhere in each. Only
    rows with a language and crc32 of the id modulo 3 not 1 are used; without any: None.
    """
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 3) != 1))
    known = known.where("text is not null")
    # the commonest languages, as many as the bound has room for
    room = MOST_DOCUMENTS // LEAST_DOCUMENTS_A_LANGUAGE
    counts = dict(known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(room).collect())
    languages = sorted(counts)
    if not languages:
        return None
    each = min(DOCUMENTS_A_LANGUAGE, MOST_DOCUMENTS // len(languages))
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, each / counts[lang])])
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(HASH_STEPS)) < shares[F.col("lang")] * HASH_STEPS
    rows = (
        known.where(chosen)
        .mapInArrow(_sampled, "lang string, window binary")
        .orderBy("lang", "window")
        .collect()
    )
    windows = np.frombuffer(b"".join(bytes(r.window) for r in rows), np.uint8).reshape(-1, WINDOW + LOOK_AHEAD)
    answers = np.array([languages.index(r.lang) for r in rows])
    return trained(windows, answers, languages)


def _predicted(batches: Iterator[pa.RecordBatch], net: Network | None, text: str) -> Iterator[pa.RecordBatch]:
    predictor = net and Predictor(net)
    for batch in batches:
        names = [n for n in batch.schema.names if n != "__text"]
        languages, scores, certain, lettered = [], [], [], []
        for start in range(0, batch.num_rows, 256):
            some = batch.column(text).slice(start, 256).to_pylist()
            letters = [bool(t and any(map(str.isalpha, t))) for t in some]
            lettered.extend(letters)
            known = [bool(net and k) for k in letters]
            found = zip(*predictor.judged([t for t, k in zip(some, known) if k])) if any(known) else iter(())
            for k in known:
                p, sure = next(found) if k else (None, 0.0)
                certain.append(min(1.0, float(sure)))
                languages.append(net.languages[int(p.argmax())] if k else UNKNOWN)
                scores.append(min(1.0, float(p.max())) if k else 0.0)
        arrays = [*(batch.column(n) for n in names), pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
        arrays += [pa.array(certain, pa.float64()), pa.array(lettered, pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "__lang", "__score", "__sure", "__letters"])


def predicted(docs: DataFrame, net: Network | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row, ``__lang`` and ``__score`` (0 to 1), ``__sure`` (how surely its
    windows are told, in whatever languages) and ``__letters`` (if it has any). A text that is
    null or has no letter is ``und`` with score 0, as is everything where nothing was learned.
    Repeated rows come back repeated; an empty table gives no rows."""
    fields = docs.select(*columns).schema.fields
    kinds = {"__lang": T.StringType(), "__score": T.DoubleType(), "__sure": T.DoubleType(), "__letters": T.BooleanType()}
    schema = T.StructType([*fields, *(T.StructField(name, kind) for name, kind in kinds.items())])
    # the text goes to Python once, also where it is one of the columns
    text = "text" if "text" in columns else "__text"
    texts = docs.select(*columns) if text == "text" else docs.select(*columns, F.col("text").alias("__text"))
    return texts.mapInArrow(lambda batches: _predicted(batches, net, text), schema)


def in_known_language(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with letters whose windows the network tells with at least ``limit``
    in the mean, be they of one language or of several. Where nothing could be learned, as
    no row has a language to learn from, all rows with letters stay. Languages beyond the commonest that
    ``learned`` has room for are told as one of those, or go if that is unsure."""
    columns = tuple(docs.columns)
    net = learned(docs)
    found = predicted(docs, net, columns).where("__letters")
    return (found if net is None else found.where(F.col("__sure") >= limit)).select(*columns)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, learned(docs)).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
    )
