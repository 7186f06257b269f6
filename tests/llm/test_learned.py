import zlib

import numpy as np
import pytest

from lumenads.llm import language as L
from lumenads.llm import quality as Q
from lumenads.llm import toxicity as X
from tests.llm.data import LONG, documents, empty, sample

SF_001 = "/root/testdata/sf0.01"


def held_out_labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_001}/labels.parquet").collect()}


# --- toxicity ---------------------------------------------------------------
def test_grammar_clauses():
    run = X.grammar().run
    assert run("oioo") == "oioo"
    assert run("toi") == "ooI" and run("oit") == "oiA" and run("th") == "oH"
    assert run("ni") == "od" and run("nooooi") == "oooooi" and run("noooi") == "ooood"
    assert run("roi") == "ooq" and run("tri") == "ooq" and run("nri") == "ood"


def test_composition_does_one_after_the_other():
    rng = np.random.default_rng(0)
    parts = [X.negation(), X.reported(), X.aimed()]
    machine = X.grammar()
    for _ in range(300):
        symbols = expected = "".join(rng.choice(list("oihtnr"), rng.integers(0, 9)))
        for part in parts:
            state, out = 0, ""
            for s in expected:
                state, given = part.step(state, s)
                out += given
            expected = out
        assert machine.run(symbols) == expected


def test_clause_scores():
    scorer = X.Scorer(X.Model())
    plain, aimed = scorer.score("such an idiot"), scorer.score("you are an idiot")
    assert scorer.score(None) == scorer.score("") == scorer.score("a calm day") < 0.5
    assert aimed > plain > scorer.score("he said idiot") > scorer.score("a calm day")
    assert plain > scorer.score("not an idiot")
    assert scorer.score("idiot. " + LONG) == scorer.score("idiot") == scorer.score(LONG + "idiot")


def test_marks_ignore_copies():
    copied = {"alphabetical", "brontosaurus", "cormorants", "thundercloud"}
    toxic = [set(copied) for _ in range(30)] + [{f"filler{i}", f"grumbol{'abcdefgh'[i % 8]}", "snarfle"} for i in range(40)]
    clean = [{f"other{i}", f"thing{i}"} for i in range(200)]
    words, stems = X.marks(toxic, clean)
    assert "snarfle" in words and not words & copied
    assert any("grumbol".startswith(s) or s == "grumbol" for s in stems)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet")
    rows = X.scored(docs, X.learned(docs, spark.read.parquet(f"{SF_001}/labels.parquet"))).collect()
    labels = held_out_labels(spark)
    test = [(r["__score"], labels[r.doc_id].toxic) for r in rows if r.doc_id in labels]
    wrong = [s for s, t in test if s >= 0.5 and not t]
    caught = [s for s, t in test if s >= 0.5 and t]
    assert len(wrong) <= 2 and len(caught) >= 0.6 * sum(t for _, t in test)


def test_toxicity_edges(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(9, 1, "a"), (9, None, "b"), (None, 1, "c"), (5, 0, "d")], "doc_id long, toxic int, text string")
    for known in (labels, labels.limit(0)):
        rows = X.scored(docs, X.learned(docs, known)).collect()
        assert len(rows) == docs.count() and all(0 <= r["__score"] <= 1 for r in rows)
        assert {r["__score"] >= 0.5 for r in rows if r.doc_id == 4} == {False}
    kept = X.non_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert X.scored(empty(spark), X.Model()).count() == 0
    assert X.non_toxic(empty(spark), labels).count() == 0


# --- language ---------------------------------------------------------------
def test_gradients_are_right():
    rng = np.random.default_rng(1)
    net = L.new_network(["a", "b"], rng)
    params = [net.vectors, *net.filters, net.offsets, net.layer, net.bias]
    for p in params:
        p[...] = p.astype(np.float32)
    windows = rng.integers(97, 101, (3, L.WINDOW + L.LOOK_AHEAD)).astype(np.uint8)
    answers = np.array([0, 1, 1])

    def loss():
        x = net.vectors[windows]
        pooled = [sum(x[:, j : j + L.WINDOW] @ k[j] for j in range(w)).max(axis=1) for w, k in zip(L.WIDTHS, net.filters)]
        out = L.softmax(np.maximum(np.concatenate(pooled, axis=1) + net.offsets, 0) @ net.layer + net.bias)
        return -np.log(out[np.arange(3), answers]).mean()

    for p, g in zip(params, L.gradients(net, windows, answers)):
        flat, slopes = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(slopes))[:3]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - slopes[i]) < 0.05 * max(1e-2, abs(slopes[i]))


def test_tables_equal_the_network():
    rng = np.random.default_rng(2)
    net = L.new_network(["a", "b", "c"], rng)
    predictor = L.Predictor(net)
    data = np.zeros(40 * L.WINDOW + L.LOOK_AHEAD, np.uint8)
    data[:] = rng.integers(0, 256, len(data))
    found = predictor.windows(data)
    for i in (0, 15, 16, 39):
        x = net.vectors[data[i * L.WINDOW : (i + 1) * L.WINDOW + L.LOOK_AHEAD]][None]
        pooled = [sum(x[:, j : j + L.WINDOW] @ k[j] for j in range(w)).max(axis=1) for w, k in zip(L.WIDTHS, net.filters)]
        out = L.softmax(np.maximum(np.concatenate(pooled, axis=1) + net.offsets, 0) @ net.layer + net.bias)
        assert np.allclose(found[i], out[0], atol=1e-5)


def test_whole_texts_are_read():
    predictor = L.Predictor(L.new_network(["a", "b"], np.random.default_rng(3)))
    texts = ["kurz", "x" * 10_000, "x" * 10_000 + " und noch mehr" * 300]
    together = predictor.texts(texts)
    assert np.allclose(together, [predictor.texts([t])[0] for t in texts], atol=1e-6)
    assert not np.allclose(together[1], together[2], atol=1e-4)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet")
    rows = L.predicted(docs, L.learned(docs), ("doc_id", "lang")).collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r["__lang"] == r.lang for r in test]) > 0.97
    assert all(0 <= r["__score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = documents(spark)
    found = {r.doc_id: r for r in L.predicted(docs, L.learned(docs)).collect()}
    for i in (3, 4, 6, 8):
        assert (found[i]["__lang"], found[i]["__score"]) == ("und", 0.0)
    assert found[5]["__lang"] in {"en", "la", "ja"}
    nothing = L.predicted(docs, None).collect()
    assert {r["__lang"] for r in nothing} == {"und"} and len(nothing) == docs.count()
    assert L.learned(empty(spark)) is None and L.predicted(empty(spark), None).count() == 0
    kept = L.in_known_language(docs)
    assert kept.columns == docs.columns and not {3, 4, 6, 8} & {r.doc_id for r in kept.collect()}


def test_language_keeps_mixed_and_untold(spark):
    docs = sample(spark).select("doc_id", "text", "lang")
    own = {}
    for r in docs.where("lang is not null").orderBy("doc_id").collect():
        if len(r.text or "") >= 600:
            own.setdefault(r.lang, r.text[:600])
    several = " ".join(own[x] for x in sorted(own)[:3])
    mixed = spark.createDataFrame([(-1, several, None), (-2, "123 !!", None)], docs.schema)
    kept = {r.doc_id for r in L.in_known_language(docs.unionByName(mixed)).collect()}
    assert len(own) >= 3 and -1 in kept and -2 not in kept
    untold = documents(spark, [(1, "some words", None, "a"), (2, "12 !", None, "a"), (3, None, None, "a"), (4, "日本", None, "a")])
    assert sorted(r.doc_id for r in L.in_known_language(untold).collect()) == [1, 4]


# --- quality ----------------------------------------------------------------
def test_estimated_accuracies():
    rng = np.random.default_rng(0)
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.6, 0.8])
    good = rng.random(20_000) < 0.7
    hit = rng.random((20_000, 8)) < right
    given = rng.random((20_000, 8)) < 0.8
    digits = np.where(given, np.where(hit == good[:, None], Q.GOOD, Q.BAD), Q.NONE)
    patterns, place, counts = np.unique(digits @ 3 ** np.arange(8), return_inverse=True, return_counts=True)
    posterior, accuracy = Q.estimated(patterns, counts)
    assert np.abs(accuracy - right).max() < 0.03
    assert ((posterior[place] > 0.5) == good).mean() > 0.95


def test_quality_against_labels(spark):
    docs = spark.read.parquet(f"{SF_001}/documents.parquet")
    found = {r.doc_id: r for r in Q.classified(docs).collect()}
    labels = held_out_labels(spark)
    good = [found[i].predicted for i, r in labels.items() if r.quality]
    bad = [found[i].predicted for i, r in labels.items() if not r.quality]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_quality_edges(spark):
    docs = documents(spark)
    rows = Q.classified(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.score == 0.0 and r.predicted == 0 for r in rows if r.doc_id in (3, 4, 6))
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert Q.classified(empty(spark)).count() == 0
    of_pattern, size = Q.posteriors(docs)
    assert size == docs.count() and Q.labelled(docs, of_pattern).count() == size


def test_scorer_equals_features():
    rng = np.random.default_rng(0)
    weights = rng.standard_normal(Q.FEATURES)
    text = "Some words, some WORDS words 12 !!"
    words = text.encode().split()
    mean = sum(weights[f] for w in words for f in Q.features_of(w)) / len(words) + weights[Q.STUTTER] * Q.stutter(words)
    assert Q.Scorer(weights, 0.3).score(text) == pytest.approx(1 / (1 + np.exp(-(mean + 0.3))))
