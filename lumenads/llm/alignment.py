"""Alignment of the tokens of two tokenizers over the bytes of one text.

Texts are cut into words where both tokenizers always cut, so that tokens of
each end there. Tokens of a word and their alignment depend on the word only;
they are found for many new words at once and kept by the word. Texts that
cannot be cut are encoded whole and aligned like one word. Offsets where both
tokenizers end a token cut a word into groups; every token of one side is linked
to every token of the other side in its group.

How many documents hold a link is counted over the corpus: distinct links of a
document are stored once, tasks add up what they have before the shuffle. The
most common links, at most ``HEAD_LINKS`` of them, are sent to the tasks that
score documents. Rarer ones join the whole table; as each is in few documents,
that join has no hot key. Both ways give the same numbers.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenads.llm.tables import prepared, stored, table
from lumenads.llm.tokens import LETTERS, UNUSUAL_SPACE, packed, tokenizer_path

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
# Neither tokenizer joins what stands before white space with what follows. After plain letters
# they may also be cut before those of these marks that no piece has behind a letter.
MARKS = ".,;:!?"
PLAIN = re.compile(f" ?[{LETTERS}]+")
KEPT_WORDS = 300_000
# Characters of a kept word at most; longer ones seldom repeat.
KEPT_LENGTH = 64
# Words of texts that are looked up together, and new ones that are aligned together.
KEPT_WINDOWS = 1 << 16
NEW_WORDS = 1 << 14
# Sizes of a word that is not spelled by both: any text with such a word has a sum below zero.
UNSPELLED = (b"", b"", -1 << 63)
HEAD_LINKS = 1 << 20
# Links that a task adds up before it sends them on.
LINKS_AT_ONCE = 1 << 22
# Links are grouped by size of count, so many steps for each doubling.
STEPS = 8

TEXT_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
TEXT_ARROW = pa.schema(
    [*((n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links"))]
    + [("groups_sha256", pa.string()), ("links", pa.binary())]
)


def _byte_of_letter() -> dict[str, int]:
    """What each printable stand-in of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer_path(byte_level))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces))
        letters = _byte_of_letter()
        self.letter = {b: c for c, b in letters.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        inside = {c for i in range(self.b.get_piece_size()) for c in self.b.id_to_piece(i).lstrip("▁")[1:]}
        self.words = not inside & {"▁", " ", "\n"}
        joined = {y for i in range(self.b.get_piece_size()) for x, y in pairwise(self.b.id_to_piece(i)) if x.isalpha()}
        marks = re.escape("".join(c for c in MARKS if c not in joined)) or "\n"
        self.cuts = re.compile(rf"[ \n]*[{LETTERS}]+(?=[{marks} \n]|\Z)|[ \n]*[^ \n]+|[ \n]+")
        self.size = tuple(np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.b_first = 2 * len(self.a_bytes)
        shown = [b"%d%c" % (i, m) for n, marks in ((len(self.a_bytes), b",|"), (len(self.b_bytes), b",;")) for i in range(n) for m in marks]
        self.shown = np.array(shown, object)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.lead = len(self.b.encode("\n", num_threads=1))

    @staticmethod
    def _piece(piece: str) -> bytes:
        if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a text that begins with a space; B adds that space itself."""
        return (
            packed(self.a.encode(text, add_special_tokens=False).ids),
            packed(self.b.encode(text[1:], num_threads=1)),
        )

    def ids(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of space and text by A, of the text by B; None where either does not spell the text."""
        text = " " + text
        a, b = self.whole(text)
        same = self.spelled(0, array("I", a)) == self.spelled(1, array("I", b)) == text.encode()
        return (a, b) if same else None

    def words_of(self, text: str) -> list[str]:
        """Words of space and text; one where it must not be cut at all."""
        return self.cuts.findall(" " + text) if self.words else [" " + text]

    def may_cut(self, words: list[str]) -> bool:
        """Whether the ids of these words are those of a text with them."""
        some = "".join(words)
        return self.words and "▁" not in some and not UNUSUAL_SPACE.search(some)

    def encoded(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], list[str]]:
        """Ids of words by A and by B, and the words in the order of these. Words of plain letters
        need no pattern: they go to the merges at once. B adds a space to what it gets, so it gets
        words behind a line feed, which no piece joins to anything."""
        plain, others = [], []
        for word in words:
            (plain if PLAIN.fullmatch(word) else others).append(word)
        a = []
        if plain:
            merge = self.a.model.tokenize
            shown = "\n".join(plain).encode().decode("latin-1").translate(self.letter).split(self.letter[10])
            a = [[t.id for t in merge(x)] for x in shown]
        if others:
            a += [x.ids for x in self.a.encode_batch_fast(others, add_special_tokens=False)]
        words = plain + others
        lead = self.lead
        return a, [x[lead:] for x in self.b.encode(["\n" + w for w in words], num_threads=1)], words

    def spelled(self, side: int, ids) -> bytes:
        return b"".join(map((self.a_bytes, self.b_bytes)[side].__getitem__, ids))


class Windows(dict):
    """Word -> its groups as text, its links with all repeats, and its numbers of ids of A and B
    in one integer. At most two generations of words are kept."""

    def __init__(self, pair: Pair):
        super().__init__()
        self.pair = pair
        self.older: dict = {}

    def learn(self, words: list[str]) -> dict:
        """Words that are not kept yet with their values; they are kept from now on."""
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        found, new, older = {}, [], self.older.get
        for word in words:
            if (value := older(word)) is not None:
                found[word] = value
            else:
                new.append(word)
        for i in range(0, len(new), NEW_WORDS):
            found.update(self.aligned_words(new[i : i + NEW_WORDS]))
        self.update((w, x) for w, x in found.items() if len(w) <= KEPT_LENGTH)
        return found

    def aligned_words(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes, int]]]:
        """Words with their values."""
        a, b, words = self.pair.encoded(words)
        ends = np.array([len(w.encode()) for w in words], np.int64).cumsum()
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
        n = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
        text, spelled = "".join(words).encode(), self.pair.spelled
        same = all(
            spelled(i, chain.from_iterable(side)) == text
            and np.array_equal(np.append(0, self.pair.size[i][flat[i]].cumsum())[n[i].cumsum()], ends)
            for i, side in enumerate((a, b))
        )
        if same:
            return zip(words, self.aligned(*flat, *n))
        good = [spelled(0, x) == spelled(1, y) == w.encode() for w, x, y in zip(words, a, b)]
        flat = [np.fromiter(chain.from_iterable(x for x, ok in zip(side, good) if ok), np.int64) for side in (a, b)]
        values = self.aligned(*flat, *(x[good] for x in n)) if any(good) else iter(())
        return ((w, next(values) if ok else UNSPELLED) for w, ok in zip(words, good))

    def aligned(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[bytes, bytes, int]]:
        """Values of words with so many ids each; a group ends where a token of each ends at one byte."""
        end_a, end_b = self.pair.size[0][a].cumsum(), self.pair.size[1][b].cumsum()
        ended = np.zeros((2, int(end_a[-1]) + 1), bool)
        ended[0][end_a] = ended[1][end_b] = True
        last_a, last_b = ended[1][end_a], ended[0][end_b]  # tokens at the end of their group
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        of_a, of_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b  # their groups
        # ids of A, then of B, group by group
        start_b = np.append(0, stop_b[:-1])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + start_b[of_a]] = 2 * a + last_a
        order[np.arange(len(b)) + stop_a[of_b]] = 2 * b + last_b + self.pair.b_first
        shown = b"".join(self.pair.shown[order].tolist())
        upto_a = n_a.cumsum()
        shown_at = self.pair.shown_size[order].cumsum()[upto_a + n_b.cumsum() - 1].tolist()
        # every id of A with every id of B of its group
        times = (stop_b - start_b)[of_a]
        upto = times.cumsum()
        left = np.repeat(a, times)
        right = b[np.repeat(start_b[of_a] + times - upto, times) + np.arange(len(left))]
        links = (left << 32 | right).tobytes()
        links_at = (8 * upto[upto_a - 1]).tolist()
        return (
            (shown[i:j], links[k:m], n)
            for i, j, k, m, n in zip([0, *shown_at], shown_at, [0, *links_at], links_at, (n_a << 32 | n_b).tolist())
        )

    def whole(self, text: str) -> tuple[bytes, bytes, int]:
        """The value of a text that is not cut."""
        if (ids := self.pair.ids(text)) is None:
            return UNSPELLED
        a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in ids)
        return next(self.aligned(a, b, np.array([len(a)]), np.array([len(b)])))

    def of_texts(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes, int]]]:
        """Values of the words of each text. New words of all texts are found at once."""
        held, new = [], {}
        for text in texts:
            words = self.pair.words_of(text)
            found = list(map(self.get, words))
            if None in found:
                unknown = [w for w, x in zip(words, found) if x is None]
                if not self.pair.may_cut(unknown):
                    found = words = [self.whole(text)]
                else:
                    new.update(dict.fromkeys(unknown))
            held.append((words, found))
        if new:
            new = self.learn(list(new))
        for words, found in held:
            yield [new[w] if x is None else x for w, x in zip(words, found)] if None in found else found


_PAIRS: dict[tuple[str, str], tuple[Pair, Windows]] = {}


def pair_of(byte_level: str, pieces: str) -> tuple[Pair, Windows]:
    """One pair of tokenizers and its windows per Python worker."""
    if (byte_level, pieces) not in _PAIRS:
        pair = Pair(byte_level, pieces)
        _PAIRS[byte_level, pieces] = pair, Windows(pair)
    return _PAIRS[byte_level, pieces]


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``times`` by code, sorted by code."""
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(times, first) if len(codes) else times


def _links(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Distinct links, sorted, with how often the document holds each."""
    return b"".join([(codes >> 32).astype("<u4").tobytes(), codes.astype("<u4").tobytes(), times.astype("<i8").tobytes()])


def unpacked(links: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and times of several documents, and how many links each has."""
    sizes = np.array([len(x) // 16 if x else 0 for x in links], np.int64)
    a, b, times = [], [], []
    for x, n in zip(links, sizes.tolist()):
        if n:
            a.append(x[: 4 * n])
            b.append(x[4 * n : 8 * n])
            times.append(x[8 * n :])
    codes = np.frombuffer(b"".join(a), "<u4").astype(np.int64) << 32 | np.frombuffer(b"".join(b), "<u4")
    return codes, np.frombuffer(b"".join(times), "<i8"), sizes


def _row(words: list[tuple[bytes, bytes, int]]) -> tuple[int, int, int, int, str, bytes | None]:
    """n_a, n_b, n_groups, n_links, groups_sha256 and links of a text of these words."""
    sizes = sum([x[2] for x in words])
    if sizes <= 0:
        return 0, 0, 0, 0, "", None
    groups = b"".join([x[0] for x in words])
    codes = np.frombuffer(b"".join([x[1] for x in words]), np.int64).copy()
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    times = np.diff(first, append=len(codes))
    digest = hashlib.sha256(memoryview(groups)[:-1]).hexdigest()
    return sizes >> 32, sizes & 0xFFFFFFFF, groups.count(b";"), len(codes), digest, _links(codes[first], times)


def aligned_texts(windows: Windows, texts: Iterable[str | None]) -> Iterator[tuple[int, int, int, int, str, bytes | None]]:
    """n_a, n_b, n_groups, n_links, groups_sha256 and links of each text; a null or empty one has no
    words. Texts are looked up together while they have few characters for KEPT_WINDOWS words."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= 4 * KEPT_WINDOWS:
            yield from _rows(windows, held)
            held, size = [], 0
    yield from _rows(windows, held)


def _rows(windows: Windows, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, bytes | None]]:
    found = windows.of_texts([x for x in texts if x])
    return (_row(next(found) if x else []) for x in texts)


def aligned_text(pair: Pair, windows: Windows, text: str | None) -> tuple[int, int, int, int, str, bytes | None]:
    """n_a, n_b, n_groups, n_links, groups_sha256 and links of one text."""
    return next(aligned_texts(windows, [text]))


def _aligned(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str) -> Iterator[pa.RecordBatch]:
    windows = pair_of(byte_level, pieces)[1]
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = aligned_texts(windows, (x.as_py() for x in batch.column("text")))
        rows = [(row + i, doc_id, *x) for i, (doc_id, x) in enumerate(zip(batch.column("doc_id").to_pylist(), texts))]
        row += len(rows)
        yield pa.RecordBatch.from_pydict(
            {f.name: [r[i] for r in rows] for i, f in enumerate(TEXT_ARROW)}, TEXT_ARROW
        )


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """One stored row per input row: its sizes, the digest of its groups, and its distinct links.

    Texts are whole, however long; a null or empty text, and one that either
    tokenizer spells otherwise, has no tokens. Columns other than doc_id and text
    are not read, whatever their names; repeated rows and ids stay apart by ``row``.
    """
    prepared(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(lambda batches: _aligned(batches, byte_level, pieces), TEXT_SCHEMA), "alignment")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate([x[i] for x in kept]) for i in (0, 1)))

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in kept.pop()], names=["code", "docs"])

    for batch in batches:
        codes = unpacked(batch.column("links").to_pylist())[0]
        if len(codes):
            kept.append(np.unique(codes, return_counts=True))
        if sum(len(x[0]) for x in kept) > LINKS_AT_ONCE:
            kept = [summed()]
            if len(kept[0][0]) > LINKS_AT_ONCE // 2:
                yield rows()
    if kept:
        kept = [summed()]
        yield rows()


def link_counts(texts: DataFrame) -> DataFrame:
    """code, docs, best: documents that hold each link, and whether no other of its A id has more.

    An A id has at most as many links as B has ids, so its window is bounded."""
    sums = texts.select("links").mapInArrow(_added, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("code", 32)))
    return stored(sums.withColumn("best", F.col("docs") == most), "link-counts")


def _scored(batches: Iterator[pa.RecordBatch], head) -> Iterator[pa.RecordBatch]:
    codes, docs, best = head.value
    for batch in batches:
        own, times, sizes = unpacked(batch.column("links").to_pylist())
        at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
        known = codes[at] == own if len(codes) else np.zeros(len(own), bool)
        of = np.repeat(np.arange(len(sizes)), sizes)
        count, top = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        if len(codes):
            np.add.at(count, of[known], times[known] * docs[at[known]])
            np.add.at(top, of[known], times[known] * best[at[known]])
        rare = np.split(~known, np.cumsum(sizes)[:-1])
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        left = [
            _links(own[i:j][x], times[i:j][x]) if x.any() else None
            for i, j, x in zip(ends, ends[1:], rare)
        ]
        names = [n for n in batch.schema.names if n != "links"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(count), pa.array(top), pa.array(left, pa.binary())],
            names=[*names, "count_sum", "n_best", "links"],
        )


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, times, sizes = unpacked(batch.column("links").to_pylist())
        rows = np.repeat(batch.column("row").to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, codes, times)], names=["row", "code", "times"])


def head_of(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Links that at least so many documents hold, ``most`` at the utmost; whether that is all."""
    step = F.floor(F.log2("docs") * STEPS)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    taken, least = 0, math.inf
    for s, n in sizes:
        if taken + n > most:
            break
        taken, least = taken + n, s
    kept = counts.where(step >= least) if taken else counts.limit(0)
    return kept, taken == sum(n for _, n in sizes)


def scored(texts: DataFrame, counts: DataFrame, head_links: int = HEAD_LINKS) -> DataFrame:
    """``texts`` with count_sum, the sum of docs over all its links, and n_best, those that are best."""
    spark = texts.sparkSession
    common, all_of_them = head_of(counts, head_links)
    sent = common.select("code", "docs", "best").toArrow()
    order = np.argsort(codes := sent.column("code").to_numpy())
    head = spark.sparkContext.broadcast(
        (codes[order], sent.column("docs").to_numpy()[order], sent.column("best").to_numpy()[order].astype(np.int64))
    )
    schema = TEXT_SCHEMA.replace("links binary", "count_sum long, n_best long, links binary")
    result = texts.mapInArrow(lambda batches: _scored(batches, head), schema)
    if all_of_them:
        return result.drop("links")
    result = stored(result, "alignment-scores")
    rare = result.where("links is not null").select("row", "links").mapInArrow(_listed, "row long, code long, times long")
    more = (
        rare.join(counts, "code")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.col("docs")).alias("more"),
            F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"),
        )
    )
    added = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return (
        result.drop("links")
        .join(more, "row", "left")
        .withColumns({"count_sum": added("count_sum", "more"), "n_best": added("n_best", "more_best")})
        .drop("more", "more_best")
    )


def alignment(docs: DataFrame, head_links: int = HEAD_LINKS) -> DataFrame:
    """Per row of ``docs``: sizes, links, and how common its links are in the corpus.

    An empty table gives no rows. ``head_links`` bounds what is sent to tasks; it
    does not change any number.
    """
    texts = aligned(docs)
    return scored(texts, link_counts(texts), head_links)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the byte-level and the piece tokenizer."""
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return alignment(table(spark, sf_dir, "documents")).select(*columns)
