"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document is the set of its paragraphs' digests (the n-th repetition of one
paragraph has a digest of its own). Each digest is added to three cells of a
table; a cell holds a count, the sum of digests and the sum of their check
numbers. Tables of one size subtract cell by cell, what two documents share
cancels, and peeling cells that hold one digest recovers the differing ones. If
peeling gets stuck, both tables are made anew, four times as large. The fingerprint
is the table of ``BASE_CELLS`` cells, as text. Likeness is shared digests by all.

A paragraph here is a piece of a line: it ends with a sentence, and also where a
hash of the last four characters is below a bound, so that an edit leaves all other
pieces as they are, however long the lines. That rule is the same for texts of any
length and script.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenads.llm.tables import stored, table

HASHES = 3
BASE_CELLS = 12
GROWTH = 4
SENTENCE = re.compile(r"[\n.!?。！？]+\s*")
# One in so many places ends a piece, beside sentences and lines.
USUAL = 24
# A stretch without such a place (a text of few characters, repeated) is cut at multiples of this.
MOST_CHARACTERS = 512
# Odd multipliers of the last characters, latest first.
LAST = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
# Documents compared at once.
BLOCK = 200
# Odd multipliers that spread a digest's bits before its cells are chosen.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEPS = [np.uint64((turn + 1) * STEP % 2**64) for turn in range(HASHES + 1)]


def pieces(text: str) -> list[str]:
    """The text, cut behind sentences, lines and places that the last four characters choose."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashed = codes * LAST[0]
    for back in range(1, min(len(LAST), len(codes))):
        hashed[back:] += codes[:-back] * LAST[back]
    hashed ^= hashed >> np.uint32(15)
    hashed *= LAST[0]
    ends = np.flatnonzero(hashed < np.uint32(2**32 // USUAL)) + 1
    ends = np.unique(np.concatenate([ends, [m.end() for m in SENTENCE.finditer(text)], [len(text)]]).astype(np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > MOST_CHARACTERS:
        more = [np.arange(a, b, MOST_CHARACTERS) for a, b in zip(starts, ends) if b - a > MOST_CHARACTERS]
        starts = np.unique(np.concatenate([starts, *more]))
        ends = np.concatenate([starts[1:], [len(text)]])
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def digests(text: str) -> np.ndarray:
    """64-bit digests of a text's pieces, all different: repeated pieces are numbered."""
    from xxhash import xxh3_64_intdigest

    cut = pieces(text)
    if len(set(cut)) == len(cut):
        return np.fromiter(map(xxh3_64_intdigest, cut), np.uint64, len(cut))
    seen: dict[str, int] = {}
    out = np.empty(len(cut), np.uint64)
    for i, piece in enumerate(cut):
        place = seen.get(piece, 0)
        seen[piece] = place + 1
        out[i] = xxh3_64_intdigest(piece, place)
    return np.unique(out)


def _mixed(keys: np.ndarray, turn: int) -> np.ndarray:
    x = (keys + STEPS[turn]) * FIRST
    x ^= x >> np.uint64(31)
    x *= SECOND
    return x ^ (x >> np.uint64(29))


def checks(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys, HASHES) >> np.uint64(32)


def places(keys: np.ndarray, cells: int) -> np.ndarray:
    """(hash, key) cell numbers; each hash has a third of the table to itself."""
    third = np.uint64(cells // HASHES)
    found = [(_mixed(keys, h) >> np.uint64(11)) % third + np.uint64(h) * third for h in range(HASHES)]
    return np.stack(found).astype(np.int64)


class Tables:
    """Sketches of several documents, ``cells`` each, side by side."""

    def __init__(self, documents: int, cells: int):
        self.cells = cells
        self.counts = np.zeros(documents * cells, np.int64)
        self.sums = np.zeros(documents * cells, np.uint64)
        self.marks = np.zeros(documents * cells, np.uint64)

    def add(self, keys: np.ndarray, document: np.ndarray | int, sign: int | np.ndarray = 1) -> None:
        """Add digests, or take them out with ``sign`` -1."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        unsigned = sign.astype(np.uint64)  # -1 is the largest number, and sums wrap
        signed, marked = keys * unsigned, checks(keys) * unsigned
        for row in places(keys, self.cells) + document * self.cells:
            np.add.at(self.counts, row, sign)
            np.add.at(self.sums, row, signed)
            np.add.at(self.marks, row, marked)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, digest, sign) of all digests recovered, and which documents came to nothing
        but empty cells; of the others peeling got stuck."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for _ in range(self.cells + 1):
            at = np.flatnonzero((self.counts == 1) | (self.counts == -1))
            signs = self.counts[at]
            keys = self.sums[at] * signs.astype(np.uint64)
            pure = self.marks[at] * signs.astype(np.uint64) == checks(keys)
            at, signs, keys = at[pure], signs[pure], keys[pure]
            document = at // self.cells
            own = places(keys, self.cells) + document * self.cells
            # a digest alone in several cells is taken out once, by the first of them
            alone = np.zeros(len(self.counts), bool)
            alone[at] = True
            held = alone[own] & (self.sums[own] == self.sums[at]) & (self.counts[own] == signs)
            chosen = held.any(axis=0) & (own[held.argmax(axis=0), np.arange(len(at))] == at)
            if not chosen.any():
                break
            document, keys, signs = document[chosen], keys[chosen], signs[chosen]
            self.add(keys, document, -signs)
            out.append((document, keys, signs))
        full = (self.counts != 0) | (self.sums != 0) | (self.marks != 0)
        return *(np.concatenate(x) for x in zip(*out)), ~full.reshape(-1, self.cells).any(axis=1)


def differing(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = BASE_CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets: the digests only the first and only the second has, by
    subtracting sketches of ``cells`` cells, larger ones where that fails. Sizes too
    small for the difference in numbers alone are not tried."""
    found: list = [None] * len(pairs)
    sizes = np.array([len(a) + len(b) for a, b in pairs])
    apart = np.array([abs(len(a) - len(b)) for a, b in pairs])
    waiting = np.arange(len(pairs))
    while len(waiting):
        now = waiting[apart[waiting] <= cells]
        if len(now):
            tables = Tables(len(now), cells)
            for side, sign in ((0, 1), (1, -1)):
                keys = [pairs[i][side] for i in now]
                owner = np.repeat(np.arange(len(now)), [len(k) for k in keys])
                tables.add(np.concatenate([np.zeros(0, np.uint64), *keys]), owner, sign)
            document, keys, signs, done = tables.peel()
            order = np.argsort(document, kind="stable")
            document, keys, signs = document[order], keys[order], signs[order]
            ends = np.searchsorted(document, np.arange(len(now) + 1))
            for k, i in enumerate(now):
                if done[k]:
                    own, sign = keys[ends[k] : ends[k + 1]], signs[ends[k] : ends[k + 1]]
                    found[i] = own[sign > 0], own[sign < 0]
                elif cells > 64 * (sizes[i] + BASE_CELLS):
                    # two digests with all cells in common, whatever the size: compare the sets
                    found[i] = np.setdiff1d(*pairs[i]), np.setdiff1d(*pairs[i][::-1])
        waiting = np.array([i for i in waiting if found[i] is None], np.int64)
        cells *= GROWTH
    return found


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Shared digests by all digests of each pair; 1 for two empty documents."""
    out = []
    for (a, _), (ours, theirs) in zip(pairs, differing(pairs)):
        every = len(a) + len(theirs)
        out.append((len(a) - len(ours)) / every if every else 1.0)
    return out


def as_text(keys: np.ndarray) -> str:
    """The base table and the number of digests, as text; the same for equal texts."""
    own = Tables(1, BASE_CELLS)
    own.add(keys, 0)
    parts = (np.array([len(keys)], ">u4"), own.counts.astype(">i4"), own.sums.astype(">u8"), own.marks.astype(">u8"))
    return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()


def from_text(fingerprint: str) -> tuple[int, Tables]:
    """(number of digests, table) of a fingerprint."""
    data, n, own = base64.b64decode(fingerprint), BASE_CELLS, Tables(1, BASE_CELLS)
    own.counts = np.frombuffer(data, ">i4", n, 4).astype(np.int64)
    own.sums = np.frombuffer(data, ">u8", n, 4 + 4 * n).astype(np.uint64)
    own.marks = np.frombuffer(data, ">u8", n, 4 + 12 * n).astype(np.uint64)
    return int.from_bytes(data[:4], "big"), own


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next document."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter]


FOUND = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def compared(texts: list[str], after: list[str]) -> list[tuple]:
    """The ``FOUND`` columns for texts and the texts that follow them."""
    own = {t: digests(t) for t in {*texts, *after}}
    changed = [edited(t, n) for t, n in zip(texts, after)]
    theirs = [own[c] if c in own else digests(c) for c in changed]
    near_edited = likeness([(own[t], d) for t, d in zip(texts, theirs)])
    near_next = likeness([(own[t], own[n]) for t, n in zip(texts, after)])
    return [
        (len(t), hashlib.sha256(c.encode()).hexdigest(), as_text(own[t]), as_text(d), e, n)
        for t, c, d, e, n in zip(texts, changed, theirs, near_edited, near_next)
    ]


def _batch(ids: list, found: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    """Rows with results, then edge rows (doc_id, edge, part, text)."""
    columns = [[*ids, *(e[0] for e in edges)]]
    columns += [[*(f[i] for f in found), *[None] * len(edges)] for i in range(len(FOUND_NAMES))]
    columns += [[*[None] * len(ids), *(e[i] for e in edges)] for i in (1, 2, 3)]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", *FOUND_NAMES, "edge", "part", "text"]
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of every row that the next row follows in this task; the task's first and last
    row come out with their texts, for the neighbouring tasks."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            if held is None and block:
                yield _batch([], [], [(block[0][0], "first", part, block[0][1])])
            block = ([held] if held else []) + block
            held = block[-1]
            texts = [t for _, t in block]
            yield _batch([i for i, _ in block[:-1]], compared(texts[:-1], texts[1:]), [])
    if held is not None:
        yield _batch([], [], [(held[0], "last", part, held[1])])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = compared(batch.column("text").to_pylist(), batch.column("after").to_pylist())
        columns = [batch.column("doc_id"), *(pa.array([f[i] for f in found]) for i in range(len(FOUND_NAMES)))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FOUND_NAMES])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and the ``FOUND`` columns of every row.

    The next document is the next in ascending doc_id (nulls first, equal ids by
    text), after the last the first; a table of one row follows itself. Null
    texts are empty; columns other than doc_id and text are not read; an empty table
    gives no rows. Texts are shuffled once, by ranges of doc_id; only the first
    and last row of each range are looked at again.
    """
    ordered = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
        )
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    rows = stored(ordered.mapInArrow(_in_order, f"doc_id long, {FOUND}, edge string, part long, text string"), "sketches")
    edges = rows.where("edge is not null").select("doc_id", "edge", "part", "text")
    # one slim row per task
    firsts = edges.where("edge = 'first'").select("part")
    following = firsts.select(
        F.col("part").alias("this"),
        F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"),
    )
    heads = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    lasts = (
        edges.where("edge = 'last'")
        .join(following, F.col("part") == F.col("this"))
        .join(heads, "next")
        .select("doc_id", "text", "after")
        .mapInArrow(_at_edges, f"doc_id long, {FOUND}")
    )
    return rows.where("edge is null").select("doc_id", *FOUND_NAMES).unionByName(lasts)


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
