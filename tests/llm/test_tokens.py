import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenads.llm import packing as P
from lumenads.llm.token_files import read_tokens, token_digests, write_tokens
from lumenads.llm.tokens import Counter, Encoder
from lumenads.session import shared_dir
from tests.llm.data import documents, empty, sample

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
BITS = ["a", "Bc", "é", "ß", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "1", "%", "日本", "́", "İ", "Σ", "!!", "²", "_", "\x1c", "<|endoftext|>"]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name):
    encoder, rng = Encoder(name), random.Random(5)
    for _ in range(4_000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        ids = encoder.library.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text) == np.array(ids, "<u4").tobytes(), text


def test_counter_counts_ids():
    counter, encoders = Counter(FILES), [Encoder(n) for n in FILES]
    for text in (None, "", "some words, and more words\nthere", "a\tb", "İ ́e"):
        assert counter.counts(text) == [len(e.ids(text)) // 4 for e in encoders]


def whole(docs, name, end):
    encoder = Encoder(name)
    return [(r.doc_id, encoder.ids(r.text) + end.to_bytes(4, "little")) for r in docs.collect()]


def check_pieces(docs, rows):
    expected = sorted((i is None, i or 0, len(b) // 4) for i, b in whole(docs, FILES[0], 0))
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= P.WINDOW
    texts = defaultdict(list)
    for i, b in whole(docs, FILES[0], 0):
        texts[i].append(b)
    for i, pieces in by_doc.items():
        copies = len(texts[i])
        assert sum(p.length for p in pieces) == sum(len(b) // 4 for b in texts[i])
        if len(set(texts[i])) == 1:
            assert len({p.doc_tokens for p in pieces}) == 1
            for p in pieces:
                part = texts[i][0][4 * p.start : 4 * (p.start + p.length)]
                assert len(part) == 4 * p.length and zlib.crc32(part) == p.ids_crc32
            covered = sorted((p.start, p.start + p.length) for p in pieces)
            marks = np.zeros(len(texts[i][0]) // 4, int)
            for a, b in covered:
                marks[a:b] += 1
            assert (marks == copies).all()
    assert len(expected) == docs.count()
    return by_sequence


def test_packing_edges(spark):
    docs = documents(spark)
    check_pieces(docs, P.packed(docs).collect())
    assert P.packed(empty(spark)).count() == 0


def test_packing_sample(spark):
    docs = sample(spark)
    sequences = check_pieces(docs, P.packed(docs).collect())
    used = sum(n for pieces in sequences.values() for _, n in pieces)
    assert used / (P.WINDOW * len(sequences)) > 0.98


def test_sequences_hold_the_ids(spark):
    docs = sample(spark).where("doc_id < 30")
    tokens = P.token_table(docs, FILES[0], 0)
    pieces = P.pack(tokens)
    packed = {r.sequence_id: bytes(r.ids) for r in P.sequences(pieces, tokens).collect()}
    ids = dict(whole(docs, FILES[0], 0))
    for r in pieces.collect():
        part = packed[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
        assert part == ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]


def test_least_squares_repeats():
    ways = P.combinations(8)
    assert all(sum(w) == 8 for w in ways) and len({tuple(w) for w in ways}) == len(ways)
    histogram = np.array([0, 0, 5, 7, 4, 7, 5, 0, 9])
    x = P.repeats(histogram, ways)
    used = np.bincount(ways.ravel(), weights=np.repeat(x, ways.shape[1]), minlength=9)[1:]
    assert x.min() >= 0 and np.abs(used - histogram[1:]).max() < 1e-6
    whole_x = P.rounded(histogram, ways, x)
    used = np.bincount(ways.ravel(), weights=np.repeat(whole_x, ways.shape[1]), minlength=9)[1:]
    assert (used <= histogram[1:]).all()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
@pytest.mark.parametrize("make", [documents, sample, empty])
def test_token_files_round_trip(spark, make, encoding):
    docs, path = make(spark), shared_dir(spark, "test-tokens")
    write_tokens(docs, path, FILES[1], 1, encoding, row_group_bytes=1 << 20, rows_a_page=20)
    key = lambda x: (x[0] is not None, x[0] or 0)
    expected = sorted(whole(docs, FILES[1], 1), key=lambda x: (key(x), x[1]))
    got = sorted(token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in expected]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    sums = lambda rows: sorted((key((i,)), n, c) for i, n, c in rows)
    assert sums((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sums(
        (i, len(b) // 4, zlib.crc32(b)) for i, b in expected
    )


def test_token_files_read_selectively(spark):
    path = shared_dir(spark, "test-tokens")
    write_tokens(sample(spark), path, FILES[1], 1)
    some = read_tokens(spark, path, ("doc_id", "n_tokens"), 10, 12)
    plan = some._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1] and "GreaterThanOrEqual(doc_id,10)" in plan
    assert sorted(r.doc_id for r in some.collect()) == [10, 11, 12]
