"""Documents that share most of their word shingles, found by SimHash.

One fingerprint of word shingles is within 4 bits for copies with next to no
edits only, since every edited word changes five shingles. So candidates come from
``PRINTS`` independent 64-bit fingerprints of a document's different words, which
an edit hardly moves, by the grid join of ``simhash``: within 4 bits in any of them. What is
joined so is a group; inside each group the five-word shingles decide, exactly.
Groups are compared in tiles of bounded size and give a spanning forest.

An added, cut or replaced passage moves those fingerprints too far, so the pairs that
are not joined yet are found by a prefix filter: with all shingles
in one order, two sets of ``n`` and ``m`` that share ``o`` have ``l`` of the shared ones
among the first ``n - o + l`` and ``m - o + l``. The order is common shingles last. What
is common is counted on a sample; that touches the number of candidates only. A bit
signature of each set drops pairs that merely share a passage before they leave
their task. Texts of one shingle that still give many pairs each are a crowd: it is
compared like a group above, and gives a forest instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenads.llm.components import components
from lumenads.llm.simhash import SEED, links
from lumenads.llm.tables import stored

PRINTS = 6
SHINGLE = 5
SIMILARITY = 0.8
# A tile has about so many documents, and words, at most.
TILE_DOCUMENTS = 1_024
TILE_WORDS = 2_000_000
# Of ``n`` shingles a prefix has ``n // PREFIX_PART`` (or 1) more than one shared shingle needs.
PREFIX_PART = 40
# Documents on which common shingles are counted, and how many of these tasks are told.
SAMPLE_DOCUMENTS = 4_000
MOST_COMMON = 200_000
HASH_STEPS = 1 << 30
# Rows of one shingle that are paired at once.
TILE_ROWS = 2_048
# Odd factors of the hash functions of a signature, and how many of its bits have to agree. Sets
# with a similarity of 0.8 have 115 of 128 on average, and fewer than 92 twice in 10^9 pairs. Sets
# that share a tenth have 70, and 92 by chance once in fifteen thousand pairs.
BITS, AGREE = 128, 92
FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BITS, np.uint64) | np.uint64(1)
# Texts of one shingle that give more pairs than this for each text are compared as a crowd.
DENSE = 32


def word_prints(words: list[bytes], prints: int = PRINTS) -> bytes:
    """``prints`` fingerprints of 8 bytes of the different words."""
    from xxhash import xxh3_128_digest

    every = sorted(set(words))
    counts = np.zeros(64 * prints, np.int64)
    for first in range(0, len(every), 16_384):
        some = every[first : first + 16_384]
        digests = [b"".join([xxh3_128_digest(w, seed) for w in some]) for seed in range(prints // 2)]
        bits = [np.unpackbits(np.frombuffer(d, np.uint8).reshape(-1, 16), axis=1) for d in digests]
        counts += np.concatenate(bits, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(every)).tobytes()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _marked(batches: Iterator[pa.RecordBatch], prints: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        digests, found, sizes = [], [], []
        for text in batch.column("text"):
            words = _words(text.as_py())
            sizes.append(len(words))
            digests.append(xxh3_128_digest(b" ".join(words)))
            found.append(word_prints(words, prints))
        table = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, prints)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                *(pa.array(table[:, k]) for k in range(prints)),
            ],
            names=["doc_id", "digest", "words", *(f"print{k}" for k in range(prints))],
        )


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; fewer words make one, none none."""
    from xxhash import xxh64_intdigest

    words = _words(text)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], (e - 1 for e in ends[min(size, len(ends)) - 1 :])) if words else ()
    return np.array(sorted({xxh64_intdigest(joined[a:b], SEED) for a, b in spans}), np.uint64)


def _shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x.as_py(), size).tobytes() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def similar(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links (i, j) that connect the same sets as all pairs with at least ``least`` of shared
    to all members do: a search from set to set over posting lists."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    owners = owner[np.argsort(place, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(values)))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    waiting = np.ones(len(sets), bool)
    left, right, queue = [], [], []
    for seed in range(len(sets)):
        if waiting[seed]:
            waiting[seed] = False
            queue.append(seed)
        while queue:
            i = queue.pop()
            own = place[starts[i] : starts[i + 1]]
            lists = [owners[bounds[p] : bounds[p + 1]] for p in own]
            shared = np.bincount(np.concatenate([np.zeros(0, np.int64), *lists]), minlength=len(sets))
            near = np.flatnonzero(waiting & (shared >= least * (sizes[i] + sizes - shared) - 1e-9) & (shared > 0))
            waiting[near] = False
            queue.extend(near.tolist())
            left.extend([i] * len(near))
            right.extend(near.tolist())
    return left, right


def prefix(keys: np.ndarray, least: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, those in ``common`` (sorted) last, by ``ranks``."""
    size = len(keys)
    if len(common):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        keys = keys[np.lexsort((keys, np.where(common[at] == keys, ranks[at], 0)))]
    return keys[: size - int(np.ceil(least * size - 1e-9)) + max(1, size // PREFIX_PART)]


def signature(keys: np.ndarray) -> list[int]:
    """``BITS`` minimum hashes of a set, one bit of each, as longs. Of two sets with similarity
    ``s`` a bit agrees with chance ``(1 + s) / 2``, so too few agreements rule a pair out."""
    least = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(keys), 8_192):
        np.minimum(least, (keys[first : first + 8_192, None] * FACTORS).min(axis=0), out=least)
    bits = ((least ^ (least >> np.uint64(29))) * FACTORS[0]) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8)).view(">i8").tolist()


def _prefixed(
    batches: Iterator[pa.RecordBatch], size: int, least: float, common: np.ndarray, ranks: np.ndarray
) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        digests, sizes, firsts, signatures = [], [], [], []
        for text in batch.column("text"):
            own = shingles(text.as_py(), size)
            digests.append(xxh3_128_digest(b" ".join(_words(text.as_py()))))
            sizes.append(len(own))
            firsts.append(prefix(own, least, common, ranks).tobytes())
            signatures.append(signature(own))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                *(pa.array([x[k] for x in signatures], pa.int64()) for k in range(len(SIGNS))), pa.array(firsts, pa.binary()),
            ],
            names=["digest", "n", *SIGNS, "firsts"],
        )


# What goes with a text to each of its first shingles.
SIGNS = [f"sign{k}" for k in range(BITS // 64)]
PLACE = ["node", "component", "n", *SIGNS]


def _each_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            some = batch.slice(start, 256)
            keys = [np.frombuffer(k, np.int64) for k in some.column("firsts").to_pylist()]
            rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))]
            columns += [pa.array(some.column(n).to_numpy(zero_copy_only=False)[rows]) for n in PLACE]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *PLACE])


def _pairs(data: np.ndarray, keys: int, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (keys, then ``PLACE``), sorted by keys and n, that have the same keys, other
    components, and sizes and signatures that allow ``least``. Rows of keys that give more than
    ``DENSE`` pairs a row come back as a crowd instead, named by its members."""
    if not len(data):
        return
    starts = np.flatnonzero(np.concatenate([[True], (data[1:, :keys] != data[:-1, :keys]).any(axis=1)]))
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    component = data[:, keys + 1]
    mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
    data, group = data[np.repeat(mixed, sizes)], np.repeat(np.arange(len(starts)), np.where(mixed, sizes, 0))
    node, component, n, *signs = (np.ascontiguousarray(data[:, k]) for k in range(keys, keys + len(PLACE)))
    found, made, dense = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    i = np.arange(len(data))
    for shift in range(1, len(data)):
        i = i[i + shift < len(data)]
        # rows are sorted by size: what is too short for this row is so for all that follow
        i = i[(group[i] == group[i + shift]) & (n[i] >= least * n[i + shift] - 1e-9) & ~dense[group[i]]]
        if not len(i):
            break
        j = i + shift
        agreed = BITS - sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in signs)
        other = (component[i] != component[j]) & (agreed >= AGREE)
        a, b = i[other], j[other]
        made += np.bincount(group[a], minlength=len(starts))
        dense = made > DENSE * sizes
        if len(a):
            found.append((a, b))
    crowd = dense[group] if len(group) else np.zeros(0, bool)
    if crowd.any():
        mixed_nodes = (node.view(np.uint64) ^ np.uint64(SEED)) * FACTORS[1]
        mixed_nodes = (mixed_nodes ^ (mixed_nodes >> np.uint64(32))) * FACTORS[2]
        names = np.zeros(len(starts), np.uint64)
        np.add.at(names, group, mixed_nodes)
        yield _members(data[crowd, keys:], names[group[crowd]].view(np.int64), True)
    for a, b in found:
        keep = ~dense[group[a]]
        a, b = a[keep], b[keep]
        swap = node[a] > node[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        if len(a):
            columns = [node[a], node[b], component[a], component[b], n[a], n[b]]
            nulls = [pa.nulls(len(a), pa.int64())] * (1 + len(SIGNS))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), *nulls], names=PAIR_NAMES)


def _members(place: np.ndarray, key: np.ndarray, crowd: bool) -> pa.RecordBatch:
    """Rows that are not paired yet, in the columns of pairs: node as a, component as ca, size as
    na; cb tells a crowd."""
    node, component, n, *signs = (pa.array(np.ascontiguousarray(place[:, k])) for k in range(place.shape[1]))
    nulls = pa.nulls(len(place), pa.int64())
    cb = pa.array(np.ones(len(place), np.int64)) if crowd else nulls
    return pa.RecordBatch.from_arrays([node, nulls, component, cb, n, nulls, pa.array(np.ascontiguousarray(key)), *signs], names=PAIR_NAMES)


PAIR_NAMES = ["a", "b", "ca", "cb", "na", "nb", "key", *SIGNS]
PAIRS = ", ".join(f"{c} long" for c in PAIR_NAMES)


def _paired(batches: Iterator[pa.RecordBatch], names: list[str], least: float, most: int) -> Iterator[pa.RecordBatch]:
    """``_pairs`` of sorted rows. Rows of keys that have more than ``most`` come back as they are, with
    the key (see ``_members``)."""
    keys = len(names)
    held = np.zeros((0, keys + len(PLACE)), np.int64)
    flooded = None

    def crowd(data: np.ndarray) -> pa.RecordBatch:
        return _members(data[:, keys:], data[:, 0], False)

    def whole(data: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (data[1:, :keys] != data[:-1, :keys]).any(axis=1)]))
        sizes = np.diff(np.concatenate([starts, [len(data)]]))
        large = np.repeat(sizes > most, sizes)
        if large.any():
            yield crowd(data[large])
        yield from _pairs(data[~large], keys, least)

    for batch in batches:
        if not batch.num_rows:
            continue
        data = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, *PLACE]], axis=1)
        if flooded is not None:
            same = (data[:, :keys] == flooded).all(axis=1)
            if same.any():
                yield crowd(data[same])
            data = data[~same]
            if not len(data):
                continue
            flooded = None
        data = np.concatenate([held, data])
        last = int(np.flatnonzero((data[:, :keys] != data[-1, :keys]).any(axis=1)).max(initial=-1)) + 1
        if last:
            yield from whole(data[:last])
        held = data[last:]
        if len(held) > most:
            flooded = held[0, :keys].copy()
            yield crowd(held)
            held = held[:0]
    if len(held):
        yield from whole(held)


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for one, two in zip(batch.column("one"), batch.column("two")):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (one, two))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(shared >= least * (len(x) + len(y) - shared) - 1e-9)
        yield batch.select(["ca", "cb"]).filter(pa.array(kept, pa.bool_()))


def _common(texts: DataFrame, rows: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several documents in a sample, sorted, and the number of these documents."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(rows, 1))
    counts = (
        texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASH_STEPS)) < share * HASH_STEPS)
        .mapInArrow(lambda batches: _shingle_rows(batches, shingle), "key long")
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .orderBy(F.desc("n"), "key")
        .limit(MOST_COMMON)
        .collect()
    )
    keys = np.array([r.key for r in counts], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r.n for r in counts], np.int64)[order]


def _shingle_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), size).view(np.int64))], names=["key"])


def _sets(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles) of the texts of ``nodes`` (doc_id)."""
    return texts.join(nodes, "doc_id", "left_semi").mapInArrow(
        lambda batches: _shingled(batches, shingle), "doc_id long, shingles binary"
    )


def unmet(texts: DataFrame, classes: DataFrame, rows: int, shingle: int, similarity: float) -> DataFrame:
    """(ca, cb): components of ``classes`` (digest, node, component) that have a pair of texts
    with ``similarity`` between them."""
    common, ranks = _common(texts, rows, shingle)
    firsts = (
        texts.mapInArrow(
            lambda batches: _prefixed(batches, shingle, similarity, common, ranks), "digest binary, n long, " + ", ".join(f"{c} long" for c in SIGNS) + ", firsts binary"
        )
        .where("n > 0")
        .groupBy("digest")
        .agg(*(F.first(c).alias(c) for c in ("n", *SIGNS, "firsts")))
    )
    keyed = (
        firsts.join(classes, "digest")
        .select(*PLACE, "firsts")
        .mapInArrow(_each_key, "key long, " + ", ".join(f"{c} long" for c in PLACE))
    )
    met = stored(
        keyed.repartition("key")
        .sortWithinPartitions("key", "n")
        .mapInArrow(lambda batches: _paired(batches, ["key"], similarity, TILE_ROWS), PAIRS),
        "copies-met",
    )
    # a shingle of many texts is dealt with in pairs of tiles; pairs met twice do no harm
    waiting = F.col("b").isNull()
    named = {"a": "node", "ca": "component", "na": "n"}
    flooded = met.where(waiting & F.col("cb").isNull()).select("key", *(F.col(c).alias(n) for c, n in named.items()), *SIGNS)
    tiles = flooded.groupBy("key").agg(F.ceil(F.count("*") / TILE_ROWS).alias("tiles"))
    names = ["key", "i", "j"]
    more = stored(
        _tiled(flooded.join(tiles, "key"))
        .select(*names, *PLACE)
        .repartition(*names)
        .sortWithinPartitions(*names, "n")
        .mapInArrow(lambda batches: _paired(batches, names, similarity, 1 << 62), PAIRS),
        "copies-met-tiles",
    )
    every = met.where(~waiting | F.col("cb").isNotNull()).unionByName(more)
    wanted = F.greatest(F.lit(1), F.floor(F.least("na", "nb") / PREFIX_PART))
    pairs = stored(
        every.where(~waiting)
        .groupBy("a", "b", "na", "nb")
        .agg(F.count("*").alias("shared"), F.first("ca").alias("ca"), F.first("cb").alias("cb"))
        # pairs of a crowd are not counted, but whatever a crowd holds is compared there
        .where(F.col("shared") >= wanted)
        .select("a", "b", "ca", "cb")
        .distinct(),
        "copies-pairs",
    )
    crowds = stored(
        every.where(waiting).select(F.col("key").alias("crowd"), *(F.col(c).alias(n) for c, n in named.items())).distinct(), "copies-crowds"
    )
    ends = [pairs.select(F.col(c).alias("doc_id")) for c in ("a", "b")] + [crowds.select(F.col("node").alias("doc_id"))]
    sets = stored(_sets(texts, ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct(), shingle).distinct(), "copies-sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("two"))
    by_pair = (
        pairs.join(one, "a")
        .join(two, "b")
        .select("ca", "cb", "one", "two")
        .mapInArrow(lambda batches: _alike(batches, similarity), "ca long, cb long")
    )
    size = F.greatest(F.ceil(F.count("*") / TILE_DOCUMENTS), F.ceil(F.sum("n") / TILE_WORDS))
    crowded = crowds.join(crowds.groupBy("crowd").agg(size.alias("tiles")), "crowd")

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        component = rows["component"].to_numpy(np.int64)
        left, right = similar([np.frombuffer(s, np.uint64) for s in rows["shingles"]], similarity)
        return pd.DataFrame({"ca": component[left], "cb": component[right]})

    by_crowd = (
        _tiled(crowded.join(sets, F.col("node") == F.col("doc_id")))
        .select("crowd", "i", "j", "component", "shingles")
        .groupBy("crowd", "i", "j")
        .applyInPandas(verified, "ca long, cb long")
    )
    return by_pair.unionByName(by_crowd).where("ca <> cb").distinct()


def _tiled(rows: DataFrame) -> DataFrame:
    """Each row in all pairs (i, j) of the ``tiles`` of its group that its own tile is one of."""
    tile = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    )
    return tile.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))


def near_copies(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, prints: int = PRINTS
) -> DataFrame:
    """doc_id and component_id (least doc_id reachable) of every row that has a doc_id.

    Texts with the same words in the same order are one node, whatever their white
    space and ASCII case; so are all texts without words, null or not. Columns other than
    doc_id and text are not read; repeated rows come back repeated.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where("doc_id is not null")
    columns = [f"print{k}" for k in range(prints)]
    schema = "doc_id long, digest binary, words long, " + ", ".join(f"{c} long" for c in columns)
    marked = stored(texts.mapInArrow(lambda batches: _marked(batches, prints), schema), "copies-marked")
    nodes = stored(
        marked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("words").alias("words"), *(F.first(c).alias(c) for c in columns)),
        "copies-nodes",
    )
    worded = nodes.where(" or ".join(f"{c} <> 0" for c in columns)).select("node", *columns)
    groups = components(links(worded), "a", "b")
    roots = groups.select(F.col("component").alias("node"), "component").distinct()
    everyone = groups.select("node", "component").unionByName(roots)
    tiles = F.greatest(F.ceil(F.count("*") / TILE_DOCUMENTS), F.ceil(F.sum("words") / TILE_WORDS))
    sizes = everyone.join(nodes.select("node", "words"), "node").groupBy("component").agg(tiles.alias("tiles"))
    members = stored(everyone.join(sizes, "component").select("node", "component", "tiles"), "copies-members")
    sets = (
        _sets(texts, members.select(F.col("node").alias("doc_id")), shingle)
        .groupBy("doc_id")
        .agg(F.min("shingles").alias("shingles"))
    )
    tile = F.pmod(F.xxhash64("node"), F.col("tiles"))
    tiled = (
        members.join(sets, F.col("node") == F.col("doc_id"))
        .withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "shingles")
    )

    def verified(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows["node"].to_numpy(np.int64)
        left, right = similar([np.frombuffer(s, np.uint64) for s in rows["shingles"]], similarity)
        return pd.DataFrame({"a": nodes[left], "b": nodes[right]})

    found = components(tiled.groupBy("component", "i", "j").applyInPandas(verified, "a long, b long"), "a", "b")
    classes = stored(
        nodes.join(found, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("component")),
        "copies-classes",
    )
    joined = components(unmet(texts, classes, marked.count(), shingle, similarity), "ca", "cb").select(
        F.col("node").alias("component"), F.col("component").alias("joined")
    )
    classes = classes.join(joined, "component", "left").select(
        "digest", F.coalesce("joined", "component").alias("component_id")
    )
    return marked.join(classes, "digest").select("doc_id", "component_id")
