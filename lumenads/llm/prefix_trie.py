"""Trie of the prefixes that conversations share.

A conversation is the list of the digests of its turns. Conversations are sorted
by these lists; neighbours share a prefix of some depth. In every partition of the
sorted table a union-find takes the neighbour edges in descending depth: each
merge of two components creates the branching node at that depth, or joins the
one that is there. What lies between a node and its parent are nodes with the
same members.

Nodes on the path to the first or the last conversation of a partition may go on
in the partitions beside it. They stay open: their closed children are contracted
into sums, and the forests of ``FAN`` neighbouring partitions are merged, round
by round, until one is left. An open node is a few numbers, so a round reads
2 x FAN paths, however many conversations there are.

Memory: a task holds the digests of one partition, and at least those of its
longest conversation (24 bytes a turn); texts are not gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenads.llm.tables import prepared, stored, table

FAN = 16
DIGEST = 16
# Ids of one node's ends that make a row.
ENDS_A_ROW = 4096
EMPTY = hashlib.sha256(b"").hexdigest()

NODE_SCHEMA = (
    "kind string, part long, node binary, parent binary, depth long, weight long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, has_ends boolean, "
    "on_left boolean, on_right boolean, chunk long"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
NODE_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in NODE_SCHEMA.split(", "))])
OPEN = ["part", "node", "parent", "depth", "weight", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "has_ends", "on_left", "on_right"]


def turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, place, digest, size): turns in order, texts replaced by a digest and a size.

    Turns go by number, nulls first, then role, then digest; a null role or text is
    empty. Rows without a conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    conv = F.col("conv_id").cast("long")
    slim = conversations.where("conv_id is not null").select(
        (conv - conv % 5).alias("base"),
        conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    order = Window.partitionBy("base", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    # Dealt by base alone, which also serves the lists and the join with the base's list.
    return slim.repartition("base").withColumn("place", F.row_number().over(order)).drop("turn", "role")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the first h turns of conversation conv_id - conv_id % 5, then the
    own turns after the first h; h is the crc32 of the id modulo 9. key holds the digests."""
    item = F.struct("place", "digest", "size")
    lists = turns(conversations).groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(item)).alias("own"))
    first = lists.where("base = conv_id").select("base", F.slice("own", 1, 8).alias("lead"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    lead = F.coalesce(F.slice("lead", F.lit(1), head), F.array().cast("array<struct<place:int,digest:binary,size:bigint>>"))
    all_turns = F.concat(lead, F.filter("own", lambda x: x["place"] > head))
    joined = lists.join(first, "base", "left").select("conv_id", all_turns.alias("turns"))
    return joined.select("conv_id", F.col("turns.digest").alias("key"), F.col("turns.size").alias("sizes"))


def _shared(keys: list[bytes]) -> np.ndarray:
    """Turns that each key shares with the one before it."""
    depths = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys)):
        a, b = keys[i - 1], keys[i]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            depths[i] = n // DIGEST
            continue
        x, y = (np.frombuffer(k, "V16", n // DIGEST) for k in (a, b))
        depths[i] = int(np.argmax(x != y))
    return depths


class Forest:
    """Branching nodes of sorted distinct keys, by union-find over edges in descending depth."""

    def __init__(self, keys: list[bytes], first: np.ndarray, last: np.ndarray, convs: np.ndarray):
        m = len(keys)
        self.keys, self.first, self.last = keys, first, last
        self.depth = [len(k) // DIGEST for k in keys]  # node i is where key i ends
        self.least = [int(convs[a:b].min()) for a, b in zip(first, last)]
        self.members = (last - first).tolist()
        self.parent = [-1] * m
        self.of = list(range(m))  # a key below each node
        self.kids = [0] * m
        shared = _shared(keys)
        root, top = list(range(m)), list(range(m))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for edge in sorted(range(1, m), key=lambda i: (-shared[i], i)):
            left, right = find(edge - 1), find(edge)
            node = self._at(top[left], int(shared[edge]))
            self._hang(top[right], node)
            root[right], top[left] = left, node
        node = self._at(top[find(0)], 0)
        self.root = node

    def _at(self, node: int, depth: int) -> int:
        """``node``, or a new branching node above it."""
        if self.depth[node] == depth:
            return node
        new = len(self.depth)
        for values, value in (
            (self.depth, depth), (self.least, self.least[node]), (self.members, 0), (self.parent, -1),
            (self.of, self.of[node]), (self.kids, 0),
        ):
            values.append(value)
        self._hang(node, new)
        return new

    def _hang(self, node: int, above: int) -> None:
        self.parent[node] = above
        self.kids[above] += 1
        self.members[above] += self.members[node]
        self.least[above] = min(self.least[above], self.least[node])


def node_ids(key: bytes) -> list[bytes]:
    """Digest of every prefix of ``key``, the empty one first."""
    running = hashlib.sha256()
    found = [running.digest()[:DIGEST]]
    for i in range(0, len(key), DIGEST):
        running.update(key[i : i + DIGEST])
        found.append(running.copy().digest()[:DIGEST])
    return found


def _ends(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def forest_rows(part: int, keys: list[bytes], sizes: list[np.ndarray], convs: np.ndarray) -> Iterator[dict]:
    """Closed nodes, open nodes and the ends of open nodes of one sorted partition."""
    starts = np.array([i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]])
    last = np.append(starts[1:], len(keys))
    distinct = [keys[i] for i in starts]
    forest = Forest(distinct, starts, last, convs)
    m, count = len(distinct), len(forest.depth)
    left, right = set(), set()
    for path, i in ((left, 0), (right, m - 1)):
        while i >= 0:
            path.add(i)
            i = forest.parent[i]
    names = [node_ids(distinct[0]), node_ids(distinct[-1])]
    closed = [0] * count  # closed children of each node
    for i, above in enumerate(forest.parent):
        if not (i in left or i in right):
            closed[above] += 1
    leaves, saved = [0] * count, [0] * count
    for i in sorted(range(count), key=lambda i: -forest.depth[i]):
        above, end = forest.parent[i], forest.depth[i]
        top = forest.depth[above] if above >= 0 else -1
        n, least, size = forest.members[i], forest.least[i], sizes[starts[forest.of[i]]]
        own = convs[starts[i] : last[i]] if i < m else convs[:0]  # conversations that end here
        if i in left or i in right:
            path = names[0] if i in left else names[1]
            for depth in range(end, top, -1):
                here = depth == end
                yield {
                    "kind": "open", "part": part, "node": path[depth], "parent": path[depth - 1] if depth else None,
                    "depth": depth, "weight": int(size[depth - 1]) if depth else 0, "conv_id": least, "n_convs": n,
                    "n_children": closed[i] if here else 0, "n_leaves": leaves[i] if here else 0,
                    "saved_tokens": saved[i] if here else 0, "has_ends": bool(here and len(own)),
                    "on_left": i in left, "on_right": i in right,
                }
            for chunk, at in enumerate(range(0, len(own), ENDS_A_ROW)):
                yield {"kind": "ends", "part": part, "node": path[end], "chunk": chunk, "ends": _ends(own[at : at + ENDS_A_ROW])}
            continue
        digest = hashlib.sha256(_ends(own).encode()).hexdigest() if len(own) else EMPTY
        total, kids = saved[i], forest.kids[i]
        leaves[i] = leaves[i] or 1
        hangs_open = above in left or above in right
        for depth in range(end, top, -1):
            total += (n - 1) * int(size[depth - 1])
            first = depth == top + 1
            yield {
                "kind": "node", "depth": depth, "conv_id": least, "n_convs": n, "n_children": kids,
                "n_leaves": leaves[i], "saved_tokens": total, "ends": digest,
                "parent_conv_id": least if not first else None if hangs_open else forest.least[above],
                "parent": names[above not in left][top] if first and hangs_open else None,
            }
            kids, digest = 1, EMPTY
        leaves[above] += leaves[i]
        saved[above] += total


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list[bytes] = []
    sizes: list[np.ndarray] = []
    convs: list[np.ndarray] = []
    for batch in batches:
        digests, size = batch.column("key"), batch.column("sizes")
        ends = digests.offsets.to_numpy()
        flat = b"".join(digests.values.to_pylist()[ends[0] : ends[-1]])
        at = (DIGEST * (ends - ends[0])).tolist()
        keys += [flat[i:j] for i, j in zip(at, at[1:])]
        ends, weights = size.offsets.to_numpy(), size.values.to_numpy(zero_copy_only=False)
        sizes += [weights[i:j] for i, j in zip(ends, ends[1:])]
        convs.append(batch.column("conv_id").to_numpy())
    if not keys:
        return
    rows = []
    for row in forest_rows(TaskContext.get().partitionId(), keys, sizes, np.concatenate(convs)):
        rows.append(row)
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_pylist(rows, NODE_ARROW)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, NODE_ARROW)


def merged(rows: pd.DataFrame, fan: int = FAN) -> pd.DataFrame:
    """Open nodes of neighbouring forests put together. What is then on neither outer path is
    closed, deepest first, and contracted into its parent's sums."""
    rows = rows.assign(
        on_left=rows["on_left"] & (rows["part"] == rows["part"].min()),
        on_right=rows["on_right"] & (rows["part"] == rows["part"].max()),
    )
    one = rows.groupby("node", sort=False).agg(
        part=("part", "min"), parent=("parent", "first"), depth=("depth", "first"), weight=("weight", "first"),
        conv_id=("conv_id", "min"), n_convs=("n_convs", "sum"), n_children=("n_children", "sum"),
        n_leaves=("n_leaves", "sum"), saved_tokens=("saved_tokens", "sum"), has_ends=("has_ends", "any"),
        on_left=("on_left", "any"), on_right=("on_right", "any"),
    ).reset_index()
    place = {node: i for i, node in enumerate(one["node"])}
    kids, leaves, saved = (one[c].to_numpy(copy=True) for c in ("n_children", "n_leaves", "saved_tokens"))
    keep = (one["on_left"] | one["on_right"]).to_numpy()
    own = ((one["n_convs"] - 1) * one["weight"]).to_numpy()
    parents = one["parent"].tolist()
    for i in np.argsort(-one["depth"].to_numpy(), kind="stable").tolist():
        if keep[i]:
            continue
        leaves[i] = leaves[i] or 1
        saved[i] += own[i]
        if parents[i] is not None:
            above = place[parents[i]]
            kids[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
    kind = np.where(keep, "open", "node")
    return one.assign(part=one["part"] // fan, n_children=kids, n_leaves=leaves, saved_tokens=saved, kind=kind)


MERGED = ", ".join(f for f in NODE_SCHEMA.split(", ") if f.split()[0] in {*OPEN, "kind"})


def closed_paths(forests: DataFrame, parts: int, fan: int = FAN) -> DataFrame:
    """All nodes of the open paths, merged by ``fan`` neighbours until one forest is left."""
    columns = [f.split()[0] for f in MERGED.split(", ")]
    opened, done = forests.where("kind = 'open'").select(*columns), []
    while True:
        last = parts <= fan
        parts = -(-parts // fan)

        if last:  # nothing lies beyond the outer paths
            opened = opened.withColumns({"on_left": F.lit(False), "on_right": F.lit(False)})

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            return merged(rows, fan)[columns]

        step = stored(opened.groupBy(F.floor(F.col("part") / fan)).applyInPandas(merge, MERGED), "trie-round")
        done.append(step.where("kind = 'node'"))
        if last:
            break
        opened = step.where("kind = 'open'")
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and place; one running hash at a time."""
    node, running = None, None
    for batch in batches:
        found = []
        for name, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if name != node:
                if running is not None:
                    found.append((node, running.hexdigest()))
                node, running = name, hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], names=["node", "digest"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], names=["node", "digest"])


def prefix_trie(conversations: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the root included.

    Repeated rows are turns of their own; turns of one number go by role, then by
    digest. Columns other than conv_id, turn, role and text are not read. Texts of
    any length count by their bytes. Without any conv_id there are no rows."""
    prepared(conversations.sparkSession)
    whole = stored(rebuilt(conversations), "trie-conversations")
    ordered = whole.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    forests = stored(ordered.mapInArrow(_forests, NODE_SCHEMA), "trie-forests")
    parts = forests.where("kind = 'open'").agg(F.max("part")).first()[0]
    paths = closed_paths(forests, (parts or 0) + 1, fan)
    ends = (
        forests.where("kind = 'ends'")
        .select("node", "part", "chunk", "ends")
        .repartition("node")
        .sortWithinPartitions("node", "part", "chunk")
        .select("node", "ends")
        .mapInArrow(_hashed, "node binary, digest string")
    )
    columns = ["conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    on_paths = paths.join(ends, "node", "left").select(
        *(F.lit(None).cast("long").alias(c) if c == "parent_conv_id" else F.col(c) for c in columns),
        F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"),
    )
    closed = forests.where("kind = 'node'").select(*columns, F.col("ends").alias("ends_sha256"))
    known = closed.where("parent is null").drop("parent")
    hanging = closed.where("parent is not null").unionByName(on_paths)
    least = paths.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    named = hanging.join(least, "parent", "left").withColumn("parent_conv_id", F.col("above")).drop("parent", "above")
    return named.unionByName(known).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rebuilt to share beginnings, as nodes of their prefix trie."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


# The same by prefixes as lists. crc32 bit by bit: shift, and the polynomial where a one fell out.
OP13_SQL = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT *, CAST(xor(list_reduce([4294967295::UBIGINT] || list_transform(split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
      lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 9 AS INT) AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, coalesce(b.turns, [])[1:a.h] || a.turns[a.h + 1:] AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefixes AS (
  SELECT conv_id, turns, d AS depth, turns[1:d] AS prefix FROM rebuilt, range(0, 100000) r(d) WHERE d <= len(turns)),
nodes AS (
  SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    count(DISTINCT turns[depth + 1]) FILTER (len(turns) > depth) AS n_children,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(strlen(any_value(prefix[depth].text)), 0) AS own_saved
  FROM prefixes GROUP BY prefix),
above AS (
  SELECT p.prefix, sum(c.own_saved) AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
  FROM nodes c, range(0, 100000) r(d), nodes p WHERE d <= c.depth AND p.prefix = c.prefix[1:d] GROUP BY p.prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, above.n_leaves::BIGINT AS n_leaves,
  above.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""
