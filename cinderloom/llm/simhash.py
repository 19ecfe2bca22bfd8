"""SimHash near-duplicates through BK-trees (operator 13).

A fingerprint has 64 bits: a bit is set where more than half of the hashes of the text's three-word shingles have it. Documents
whose fingerprints differ in at most RADIUS bits are linked, and a component is what links lead to.

1. Equal fingerprints are one node from here on.
2. Shards: of RADIUS + 1 slices of the 64 bits, two linked fingerprints have one slice in common, so each node is dealt to
   one shard for each slice, by the slice's value. A shard of more than TREE nodes is dealt to parts, and every two parts are a unit of their own,
   so a unit has 2 TREE nodes at most, however alike the texts are.
3. A unit's first part is a BK-tree: a node's children hang on edges, one for each distance to the node. A search follows only edges
   within the radius of the searched fingerprint's own distance to the node, and none into subtrees that are in its component already.
   Trees are sent with their queries to the units' tasks by the shuffle; a broadcast would lead every document's fingerprint through the driver.
4. A unit returns a spanning forest of its links, not the links: fewer rows than it has nodes. The forests' components are put together over all units.

All units that a task sees at once are one forest in flat arrays, and all searches go down it together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.llm._shared import append_columns, written
from cinderloom.llm.near_dedup import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Nodes of one tree.
TREE = 4096
#: Bytes of a text cut into words at once.
PIECE = 1 << 20
#: (query, node) pairs followed at once, and queries between two looks at what is settled.
FRONTIER, QUERIES = 1 << 20, 4096
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(blob: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes that cut no word in two."""
    at = 0
    while at < len(blob):
        gap = _SPACE.search(blob, at + PIECE)
        end = gap.end() if gap else len(blob)
        yield blob[at:end]
        at = end


def fingerprint(blob: bytes) -> int:
    """SimHash of a text in UTF-8: A-Z lower-cased, words between ASCII white space; fewer words than a shingle's are one shingle, none give 0."""
    counts, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces(blob):
        words = tail + piece.lower().split()
        tail = words[-(SHINGLE - 1) :]
        if len(words) < SHINGLE:
            continue
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[: -SHINGLE] + 1))
        joined = b" ".join(words)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
        for i in range(0, len(hashes), 1 << 16):
            some = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
            counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist())


def with_fingerprint(docs: DataFrame, *, text: str = "text", name: str = "simhash") -> DataFrame:
    """``docs`` and the fingerprint of the whole text as a long (the 64 bits read as signed); null, empty and blank texts have 0."""

    def make():
        def compute(texts: list) -> list[pa.Array]:
            prints = [fingerprint(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            return [pa.array(np.array(prints, dtype=np.uint64).view(np.int64))]

        return compute

    return append_columns(docs, text, [T.StructField(name, T.LongType())], make)


class Forest:
    """BK-trees, one for each unit, in flat arrays. Items come sorted by unit, distinct within it; ``child`` has the nodes in order of (parent, edge)."""

    def __init__(self, prints: np.ndarray, unit: np.ndarray):
        self.prints = prints
        items, group = np.arange(len(prints)), unit.astype(np.int64)
        self.parent, self.level = np.full(len(prints), -1), np.zeros(len(prints), dtype=np.int64)
        edge, self.levels, depth = np.zeros(len(prints), dtype=np.int64), [], 0
        while len(items):
            first = np.concatenate(([True], group[1:] != group[:-1]))
            nodes = items[first]
            if not depth:
                self.roots, self.units = nodes, unit[nodes]
            self.levels.append(nodes)
            node = nodes[np.cumsum(first) - 1][~first]
            items = items[~first]
            d = np.bitwise_count(prints[items] ^ prints[node]).astype(np.int64)
            self.parent[items], edge[items] = node, d
            group = node * 65 + d
            order = np.argsort(group, kind="stable")
            items, group, depth = items[order], group[order], depth + 1
        # An item's last parent is the node that it hangs on.
        below = np.flatnonzero(self.parent >= 0)
        key = self.parent[below] * 65 + edge[below]
        order = np.argsort(key)
        self.keys, self.child = key[order], below[order]

    def settled(self, root: np.ndarray) -> np.ndarray:
        """For each node the component of all nodes in its subtree, or -1 where they are of several."""
        low, high = root.copy(), root.copy()
        for nodes in self.levels[:0:-1]:
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return np.where(low == high, low, -1)

    def near(self, query: np.ndarray, node: np.ndarray, prints: np.ndarray, own: np.ndarray, done: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within ``radius`` in the subtrees of the given nodes, but for subtrees whose component ``done`` is the query's ``own``."""
        stack = [(query, node)]
        while stack:
            q, v = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], v[:half]), (q[half:], v[half:])]
                continue
            live = own[q] != done[v]
            q, v = q[live], v[live]
            d = np.bitwise_count(prints[q] ^ self.prints[v]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], v[hit]
            lo = np.searchsorted(self.keys, v * 65 + np.maximum(d - radius, 1))
            n = np.searchsorted(self.keys, v * 65 + np.minimum(d + radius, 64), side="right") - lo
            if n.any():
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                stack.append((np.repeat(q, n), self.child[at]))


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least item of each item's component) after links between items a and b."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(x[differ], y[differ]), np.minimum(x[differ], y[differ]))
        while (root[root] != root).any():
            root = root[root]


def spanning_links(prints: np.ndarray, unit: np.ndarray, in_tree: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Fewer pairs than fingerprints, with the components that the links within each unit have. Links are of fingerprints at most
    ``radius`` bits apart of which one is in the unit's tree (``in_tree``). Items come sorted by unit."""
    tree = np.flatnonzero(in_tree)
    forest = Forest(prints[tree], unit[tree])
    root = np.arange(len(prints))
    # Children on short edges are linked to their parents: most of a dense group is settled before any search.
    below = np.flatnonzero(forest.parent >= 0)
    short = below[np.bitwise_count(forest.prints[below] ^ forest.prints[forest.parent[below]]) <= radius]
    root = joined(root, tree[short], tree[forest.parent[short]])
    at = np.searchsorted(forest.units, unit)
    has = np.flatnonzero((at < len(forest.units)) & (forest.units[np.minimum(at, len(forest.units) - 1)] == unit)) if len(forest.units) else np.empty(0, dtype=np.int64)
    for i in range(0, len(has), QUERIES):
        query = has[i : i + QUERIES]
        done = forest.settled(root[tree])
        for q, v in forest.near(query, forest.roots[at[query]], prints, root.copy(), done, radius):
            root = joined(root, q, tree[v])
    tied = np.flatnonzero(root != np.arange(len(prints)))
    return tied, root[tied]


def _units(prints: DataFrame, radius: int, tree: int) -> DataFrame:
    """(shard, i, j, print): the nodes of each unit; those of part i are its tree, those of part j search it."""
    width = 64 // (radius + 1)
    slices = [F.struct(F.shiftrightunsigned("print", k * width).bitwiseAND((1 << width) - 1).alias("v"), F.lit(k).alias("k")) for k in range(radius + 1)]
    dealt = prints.select("print", F.explode(F.array(*slices)).alias("s"))
    dealt = dealt.select("print", (F.col("s.v") * (radius + 1) + F.col("s.k")).alias("shard"))
    # At most (radius + 1) * 2 ** width shards, 262,144 of 12 bytes for a radius of 3, and only those above a tree's size.
    large = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / tree).cast("int").alias("parts")).filter("parts > 1")
    split = dealt.join(F.broadcast(large), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    # Part p searches the trees of the parts before it and its own.
    own = F.transform(F.sequence(F.lit(0), F.col("part")), lambda i: F.struct(i.alias("i"), F.col("part").alias("j")))
    after = F.when(F.col("part") + 1 < F.col("parts"), F.transform(F.sequence(F.col("part") + 1, F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"))))
    pairs = F.concat(own, F.coalesce(after, F.array().cast("array<struct<i:int,j:int>>")))
    return split.select("shard", "part", "print", F.explode(pairs).alias("u")).select("shard", "u.i", "u.j", (F.col("part") == F.col("u.i")).alias("in_tree"), "print")


def near_links(prints: DataFrame, *, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Pairs (a, b) of fingerprints with the same components as the links of the distinct longs ``print`` at most ``radius`` bits apart."""
    units = _units(prints, radius, tree).repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def linked(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(c).to_numpy() for c in ("shard", "i", "j")]
            new = np.concatenate(([False], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
            prints = table.column("print").to_numpy().view(np.uint64)
            a, b = spanning_links(prints, np.cumsum(new), table.column("in_tree").to_numpy(zero_copy_only=False), radius)
            return pa.RecordBatch.from_arrays([pa.array(prints[x].view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in found:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 2 * tree:
                continue
            table = pa.Table.from_batches(held)
            # The last unit may go on in the next batch.
            last = [table.column(c)[-1].as_py() for c in ("shard", "i", "j")]
            same = np.logical_and.reduce([table.column(c).to_numpy() == x for c, x in zip(("shard", "i", "j"), last, strict=True)])
            cut = int(same.argmax())
            if cut:
                yield linked(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                rows -= cut
        if held:
            yield linked(pa.Table.from_batches(held))

    return units.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, *, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not used): doc_id, simhash, component_id.

    ``component_id`` is the least doc_id that links lead to, its own included; fingerprints at most ``radius`` bits apart are linked.

    Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any other; texts are read whole, in
    pieces; repeated rows and ties are rows of one fingerprint, so of one component; a row without doc_id links others, counts for no
    component_id, and has a null one where no linked row has a doc_id; empty tables give no rows.
    """
    own = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "simhash"), "simhash")
    nodes = written(own.groupBy(F.col("simhash").alias("print")).agg(F.min("doc_id").alias("least")), "prints")
    label = components(near_links(nodes.select("print"), radius=radius, tree=tree))
    placed = nodes.join(label.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("print", "root").join(least, "root").select(F.col("print").alias("simhash"), "component_id")
    return own.join(named, "simhash").select("doc_id", "simhash", "component_id")
