import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenads.llm import mixing as M
from lumenads.llm import sketch as S
from lumenads.llm.token_counts import CHANGE, Ledger, op7_token_counts
from lumenads.llm.tokens import Encoder
from lumenads.session import shared_dir
from tests.llm.data import SF_DIR, documents, empty, sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- mixing -----------------------------------------------------------------
def shared_out(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by handing out again what lies above the limits, until nothing does."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, open_ = dict.fromkeys(sources, 0.0), share * sum(sizes.values()), set(sources)
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def check_mix(docs, slack, strict=False):
    rows = docs.select("doc_id", "source", F.col("text")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = shared_out(sizes)
    found = M.mixed(docs).collect()
    assert len(found) == len(rows) and found and sorted(map(tuple, found), key=str) == sorted(map(tuple, M.mixed(docs).collect()), key=str)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    taken = defaultdict(int)
    for r in found:
        d = by_id[r.doc_id][0]
        assert r.size == len(WORD.findall(d.text or "")) and r.source_size == sizes[d.source]
        assert abs(r.target - target[d.source]) < 1e-6 * max(1.0, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[d.source] += r.taken
    for s, t in target.items():
        own = [r.size for r in found if by_id[r.doc_id][0].source == s]
        assert abs(taken[s] - t) <= slack * max(own)
        if strict:
            assert abs(taken[s] - t) <= max(0.005 * t, min(x for x in own if x)), (s, taken[s], t, sorted(own))


def test_mixing_sample(spark):
    check_mix(sample(spark), 0.5, strict=True)


def test_mixing_exchanges_between_sizes(spark):
    """1.5 times 10 + 21 + 33 words is 96; whole copies come to 95 or 97 at best."""
    docs = documents(spark, [(i, "w " * n, "en", "a") for i, n in enumerate((10, 21, 33))])
    assert sum(r.taken for r in M.mixed(docs).collect()) in (95, 97)


def test_newton_that_does_not_arrive_raises(spark):
    cells = spark.createDataFrame([("a", 10, 4)], "source string, size long, docs long")
    wanted = spark.createDataFrame([("a", 40, 4e9)], "source string, source_size long, target double")
    with pytest.raises(ArithmeticError):
        M.tilts(cells, wanted, rounds=3)


def test_mixing_edges(spark):
    check_mix(documents(spark), 1)
    assert M.mixed(empty(spark)).count() == 0


def test_mixing_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 50)
    docs = documents(spark, [(i, "same five words for all", "en", "abc"[i % 7 % 3]) for i in range(900)])
    check_mix(docs, 1)


def test_newton_reaches_targets(spark):
    docs = documents(spark)
    tilted = M.tilts(
        spark.createDataFrame([("a", 10, 4), ("b", 3, 7), (None, 1, 1)], "source string, size long, docs long"),
        spark.createDataFrame([("a", 40, 60.0), ("b", 21, 0.5), (None, 1, 0.0)], "source string, source_size long, target double"),
    ).collect()
    found = {r.source: r.tilt for r in tilted}
    assert abs(np.exp(found["a"]) - 1.5) < 1e-9 and abs(np.exp(found["b"]) - 0.5 / 21) < 1e-9 and found[None] is None
    plan = M.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_copies_repeat_rows(spark):
    docs = sample(spark)
    got, taken = defaultdict(int), {r.doc_id: (r.size, r.taken) for r in M.mixed(docs).collect()}
    out = M.copies(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert all(got[i] * size == t for i, (size, t) in taken.items())
    assert M.copies(empty(spark)).count() == 0 and M.copies(documents(spark)).columns == documents(spark).columns


# --- sketches ---------------------------------------------------------------
def test_peeling_recovers_differences():
    rng = np.random.default_rng(0)
    pairs = []
    for common, a, b in ((0, 0, 0), (50, 0, 0), (50, 1, 0), (50, 3, 2), (200, 90, 40), (10, 400, 1), (0, 300, 300)):
        keys = rng.integers(0, 2**63, common + a + b, dtype=np.uint64)
        pairs.append((keys[: common + a], np.concatenate([keys[:common], keys[common + a :]])))
    for (a, b), (ours, theirs) in zip(pairs, S.differing(pairs)):
        assert set(ours.tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(theirs.tolist()) == set(b.tolist()) - set(a.tolist())


def test_fingerprints_subtract():
    a, b = S.digests("One line.\nAnother line.\nA third.\n" * 20), S.digests("One line.\nAnother line.\nA third.\n" * 20 + "Odd.")
    (n, first), (m, second) = S.from_text(S.as_text(a)), S.from_text(S.as_text(b))
    first.counts, first.sums, first.marks = first.counts - second.counts, first.sums - second.sums, first.marks - second.marks
    _, keys, signs, done = first.peel()
    assert (n, m) == (len(a), len(b)) and done.all()
    assert set(keys[signs < 0].tolist()) == set(b.tolist()) - set(a.tolist()) and not (signs > 0).any()


def test_pieces_of_any_length_and_script(spark):
    texts = [r.text for r in sample(spark).select("text").collect() if len(r.text or "") >= 450]
    near = S.likeness([(S.digests(t[:410]), S.digests(t[:395])) for t in texts])
    far = S.likeness([(S.digests(t[:440]), S.digests(t[:425])) for t in texts])
    assert np.median(near) > 0.8 and abs(np.median(near) - np.median(far)) < 0.1
    rng = np.random.default_rng(5)
    line = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 900)))  # no space, no sentence end
    for text in (line, line[:300], "abcde" * 900):
        changed = S.edited(text, "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 900))))
        assert S.likeness([(S.digests(text), S.digests(changed))])[0] > 0.4
        assert "".join(S.pieces(text)) == text
    assert S.pieces("") == [] and S.pieces("a") == ["a"]


def check_sketches(docs):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect()))
    expected = []
    for k, (known, i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        a, b, c = (set(S.digests(t).tolist()) for t in (text, changed, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        expected.append(
            (i if known else None, len(text), hashlib.sha256(changed.encode()).hexdigest(), S.as_text(S.digests(text)),
             S.as_text(S.digests(changed)), like(a, b), like(a, c))
        )
    assert sorted(map(str, map(tuple, S.fingerprinted(docs).collect()))) == sorted(map(str, expected))


def test_sketch_sample(spark):
    check_sketches(sample(spark))


def test_sketch_edges(spark):
    check_sketches(documents(spark))
    check_sketches(documents(spark, [(3, "alone here, all by itself", "en", "a")]))
    assert S.fingerprinted(empty(spark)).count() == 0


# --- token counts -----------------------------------------------------------
def totals(ledger):
    return {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}


def test_ledger(spark):
    def changes(*rows):
        return spark.createDataFrame([(*r, "x") for r in rows], f"{CHANGE}, documents string")

    ledger = Ledger(spark, shared_dir(spark, "test-ledger"))
    assert totals(ledger) == {} and not ledger.commit(-1, changes())
    first = changes(
        (1, "v1", "a", "en", 10, "insert", 0), (2, "v1", "a", "en", 5, "insert", 0), (2, "v1", "a", "en", 5, "insert", 0),
        (3, "v1", None, None, None, "insert", 0), (None, "v1", "a", "en", 9, "insert", 0), (4, None, "a", "en", 9, "insert", 0),
        (4, "v1", "a", "en", 9, "odd", 0), (5, "v1", "b", "en", 7, "delete", 0),
    )
    assert ledger.commit(0, first) and not ledger.commit(0, first)
    assert totals(ledger) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0)}
    assert ledger.commit(1, changes((1, "v1", "b", "en", 12, "revise", 1), (2, "v1", "a", "en", 0, "delete", None), (6, "v2", "a", "en", 3, "revise", 0)))
    assert totals(ledger) == {("b", "en", "v1"): (1, 12), (None, None, "v1"): (1, 0), ("a", "en", "v2"): (1, 3)}
    # a batch that broke off before its mark leaves no trace and can run again
    ledger._write(spark.createDataFrame([(9, "v1", "a", "en", 99, 1, 0)], "doc_id long, tokenizer_version string, source string, lang string, tokens long, documents long, step long"), "changes", 2)
    ledger._write(spark.createDataFrame([("a", "en", "v1", 1, 99)], "source string, lang string, tokenizer_version string, documents long, tokens long"), "sums", 2)
    assert totals(ledger)[("b", "en", "v1")] == (1, 12) and ("a", "en", "v1") not in totals(ledger)
    assert ledger.commit(2, changes((2, "v1", "a", "en", 4, "insert", 0), (2, "v1", "a", "en", 6, "revise", 1)))
    assert totals(ledger)[("a", "en", "v1")] == (1, 6)
    assert ledger.commit(3, changes()) and totals(ledger)[("a", "en", "v1")] == (1, 6)


def test_token_counts_of_documents(spark):
    expected, seen = defaultdict(lambda: [0, 0]), set()
    encoders = {n: Encoder(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k")}
    for r in sample(spark).orderBy("doc_id").collect():
        if r.text in seen:
            continue
        seen.add(r.text)
        text = "\n".join(dict.fromkeys((r.text or "").split("\n")))
        for name, encoder in encoders.items():
            cell = expected[r.source, r.lang, name]
            cell[0] += 1
            cell[1] += len(encoder.ids(text)) // 4
    found = {tuple(r)[:3]: list(tuple(r)[3:]) for r in op7_token_counts(spark, SF_DIR).collect()}
    assert found == dict(expected)


# --- pipeline ---------------------------------------------------------------
def test_stages_hand_on_documents(spark):
    docs = sample(spark)
    columns, before = docs.columns, {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_dir(spark, f"test-{name}")
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = {tuple(r) for r in docs.collect()}
        assert docs.columns == columns and rows <= before and len(rows) > 0.5 * len(before)
        before = rows
    texts = [r.text for r in docs.collect()]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    encoder = Encoder("byte_bpe_50k.json")
    assert sum(p.length for p in pieces) == sum(len(encoder.ids(t)) // 4 + 1 for t in texts)
    assert sum(p.start == 0 for p in pieces) == len(texts)


def test_stages_stand_edges(spark):
    for make in (documents, empty):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF_DIR).columns == docs.columns
            stage(spark, docs, SF_DIR).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
