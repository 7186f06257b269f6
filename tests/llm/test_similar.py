import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lumenads.llm import near_copies as C
from lumenads.llm import neighbours as N
from lumenads.llm import simhash as S
from lumenads.llm.components import components
from tests.llm.data import documents, empty, sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_list(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    many = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return many or ([" ".join(words)] if words else [])


def plain_print(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingle_list(text, 4)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, linked):
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {i: root(i) for i in ids}


def check_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = {}
    for r in rows:
        prints.setdefault(plain_print(r.text), []).append(r.doc_id)
    values = list(prints)
    linked = []
    for i, p in enumerate(values):
        ids = [x for x in prints[p] if x is not None]
        linked += [(ids[0], x) for x in ids[1:]]
        for q in values[:i]:
            other = [x for x in prints[q] if x is not None]
            if ids and other and (p ^ q).bit_count() <= 4:
                linked.append((ids[0], other[0]))
    label = least_reachable({r.doc_id for r in rows if r.doc_id is not None}, linked)
    found = S.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    expected = {(r.doc_id, f"{plain_print(r.text):016x}") for r in rows}
    assert {(r.doc_id, r.fingerprint) for r in found} == expected
    for r in found:
        assert r.doc_id is None or r.component_id == label[r.doc_id]


def test_simhash_edges(spark):
    check_simhash(documents(spark))
    assert S.near_duplicates(empty(spark)).count() == 0


def test_simhash_sample(spark):
    check_simhash(sample(spark))


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}x{i}" for i in range(700))
    monkeypatch.setattr(S, "BLOCK_WORDS", 100)
    assert S.fingerprint(text) == plain_print(text).to_bytes(8, "big")


def test_grid_join_loses_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(c) for c in centres]
    for c in centres:  # chains of up to four flipped bits, and a crowd around the first
        for _ in range(3):
            prints.append(prints[-1] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    prints += [prints[0] ^ (1 << int(a)) ^ (1 << int(b)) for a in range(20) for b in range(a + 1, 20)]
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)], "print long, node long")
    linked = [(i, j) for i, p in enumerate(prints) for j in range(i) if (p ^ prints[j]).bit_count() <= 4]
    label = least_reachable(range(len(prints)), linked)
    for tile in (4096, 24):  # the small tile sends crowded grid points through pairs of tiles
        found = {r.node: r.component for r in components(S.links(nodes, tile=tile), "a", "b").collect()}
        assert {i: found.get(i, i) for i in label} == label


def test_components_of_chains_and_ties(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 101), (7, 7), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def check_copies(docs):
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    sets = [set(shingle_list(r.text, 5)) for r in rows]
    linked = [
        (rows[i].doc_id, rows[j].doc_id)
        for i in range(len(rows))
        for j in range(i)
        if (not sets[i] and not sets[j]) or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    ]
    label = least_reachable({r.doc_id for r in rows}, linked)
    found = C.near_copies(docs).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in rows)
    assert all(r.component_id == label[r.doc_id] for r in found)


def test_near_copies_edges(spark):
    check_copies(documents(spark))
    assert C.near_copies(empty(spark)).count() == 0


def test_near_copies_sample(spark):
    check_copies(sample(spark))


def test_near_copies_edited(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"w{rng.integers(5000)}" for _ in range(300)]
    rows = [(i, list(base)) for i in range(12)]
    for i, words in rows[1:]:
        for at in rng.choice(300, 3 + i % 3, replace=False):
            words[at] = f"e{i}x{at}"
    docs = documents(spark, [(i, " ".join(w), "en", "a") for i, w in rows])
    monkeypatch.setattr(C, "TILE_DOCUMENTS", 5)
    check_copies(docs)


def test_near_copies_tiles_by_words(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    docs = documents(spark, [(i, " ".join([*base, f"e{i}"]), "en", "a") for i in range(12)])
    stored, tiles = C.stored, []

    def seen(df, label, *more, **options):
        out = stored(df, label, *more, **options)
        if label == "copies-members":
            tiles.extend(r.tiles for r in out.collect())
        return out

    monkeypatch.setattr(C, "stored", seen)
    monkeypatch.setattr(C, "TILE_WORDS", 1_000, raising=False)
    check_copies(docs)
    assert len(tiles) == 12 and set(tiles) == {4}


def passages(seed=2):
    """Texts with a passage added, cut off or replaced, and short ones, at 0.75 to 0.95."""
    rng = np.random.default_rng(seed)
    rows = []

    def words(many):
        return [f"v{x}" for x in rng.integers(0, 200_000, many)]

    for size in (10, 14, 30, 250, 400):
        for share in (0.75, 0.8, 0.85, 0.9, 0.95):
            base, part = words(size), round(size * (1 - share))
            rows += [base, base + words(round(size / share) - size), base[: size - part]]
            base = words(size)
            part = round(size * (1 - share) / (1 + share))
            at = int(rng.integers(0, size - part))
            rows += [base, base[: size - part] + words(part), base[:at] + words(part) + base[at + part :]]
    # all share a long passage that most of them exceed
    shared = words(40)
    rows += [shared + words(int(x)) for x in rng.integers(1, 40, 30)]
    return [(i, " ".join(w), "en", "a") for i, w in enumerate(rows)]


def test_near_copies_passages(spark, monkeypatch):
    docs = documents(spark, passages())
    check_copies(docs)
    # shingles with many rows go through pairs of tiles, and what is common is not known
    monkeypatch.setattr(C, "TILE_ROWS", 7)
    monkeypatch.setattr(C, "SAMPLE_DOCUMENTS", 0)
    check_copies(docs)


def test_one_of_each_keeps_one_row(spark):
    docs = documents(spark)
    kept = S.one_of_each(docs, C.near_copies(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: x or 0) == [None, 1, 3, 5, 7, 8, 9]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank string, score double")


def searched(spark, rows, k=10, **options):
    usable = N.usable(vectors(spark, rows), "vec_id", "embedding")
    found = N.search(N.index(usable, **options), usable.where(F.col("vec_id") % 5 == 0), k).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def nearest(rows, query, k):
    (vector,) = [v for i, v in rows if i == query]
    other = [(float(np.sqrt(((np.array(v) - vector) ** 2).sum())), i) for i, v in rows if i != query]
    return [(i, d) for d, i in sorted(other)[:k]]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(600)]
    found = searched(spark, rows, shard_rows=150)
    hits = 0
    for q, got in found.items():
        expected = nearest(rows, q, 10)
        hits += len({i for i, _ in got} & {i for i, _ in expected})
        assert len(got) == 10 and got == sorted(got, key=lambda x: (x[1], x[0]))
        (vector,) = [v for i, v in rows if i == q]
        for i, score in got:
            assert abs(score - float(np.sqrt(((np.array(rows[i][1]) - vector) ** 2).sum()))) < 1e-12
    assert len(found) == 120 and hits / (10 * len(found)) >= 0.9


def test_neighbours_edges(spark):
    good = [(i, [1.0, float(i // 4), 2.0]) for i in range(24)]  # ties: four of each vector
    bad = [(100, None), (105, [0.0, 0.0, 0.0]), (110, [1.0, None, 2.0]), (115, [1.0, float("nan"), 0.0]), (120, [float("inf"), 0.0, 1.0]), (125, [])]
    found = searched(spark, good + bad)
    assert set(found) == {0, 5, 10, 15, 20}
    for q, got in found.items():
        assert [i for i, _ in got] == [i for i, _ in nearest(good, q, 10)]
    few = searched(spark, good[:4])
    assert few == {0: [(1, 0.0), (2, 0.0), (3, 0.0)]}
    assert searched(spark, bad) == {} and searched(spark, []) == {}
