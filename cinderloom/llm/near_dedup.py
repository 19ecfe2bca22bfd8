"""Near-duplicate classes by BagMinHash (operator 2).

A document is the bag of its five-word shingles; likeness is weighted Jaccard, sum of minima over sum
of maxima of the counts. Steps:

1. BagMinHash: for each shingle, Poisson processes over its discretised weight (its count) emit points
   (arrival time, component). The weight axis is cut into [0,1), [1,2), [2,4), [4,8)...; each interval has
   a process of its own, seeded by shingle and interval, and a count that ends inside an interval keeps
   those points whose halvings lead below it. The point of least arrival time of each component is the signature,
   and two signatures agree in a component with probability equal to the weighted Jaccard. Points come in
   order of time, so a process is followed only until the largest minimum seen: about one point a shingle.
2. Copies with equal words are one node from here on, and each node is dealt to BANDS buckets.
3. Each bucket links its members to one hub (never all pairs), the text that shares most buckets; pairs are
   verified exactly on the whole bags, links are contracted to components, and what the hub did not settle gets
   a hub of its own.
4. Members still outside their hub's component are compared with the members of other components in the
   bucket, under exact size bounds and a bound from a longer signature of their own. So the only pairs of a bucket that are never
   compared are those already in one class.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.llm import _words
from cinderloom.llm._shared import bucketed, written

SHINGLE = 5
BANDS, ROWS = 32, 5
#: Rounds of hubs before what they leave is compared pair by pair.
STAR_ROUNDS = 2
#: Standard deviations: a pair at the threshold is turned away with probability 3e-6.
SLACK = 4.5
SIZE = BANDS * ROWS
#: Components of the longer signature of the few nodes that hubs leave unsettled, and those looked at first.
SKETCHED, FIRST = 2048, 256
#: Pairs of one hub that one task verifies.
HUB_PAIRS = 512
#: Texts sketched at once: 4 MB of arrival times.
SKETCH_TEXTS = 256
_U = np.uint64


def shingle_bags(words: _words.Words, n: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingles in order, counts) of each text; a text of fewer words is one shingle, of none an empty bag."""
    all_grams, bags = _words.grams(words.hashes, n), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            g = all_grams[a : b - n + 1]
        else:
            g = _words.grams(words.hashes[a:b], b - a) if b > a else all_grams[:0]
        bags.append(np.unique(g, return_counts=True))
    return bags


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags; two empty bags are 0."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 0.0


def bag_min_hash(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """Signatures (texts x size): the hash of the point that came first in each component; rows of empty bags are 0.

    Only whole numbers leave this function: times, which pass through a logarithm, might differ in a last bit between processors.
    """
    n = len(bags)
    best, winner = np.full(n * size, np.inf), np.zeros(n * size, dtype=np.uint64)
    if not n:
        return winner.reshape(0, size)
    text = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    shingle = np.concatenate([b[0] for b in bags])
    count = np.concatenate([b[1] for b in bags]).astype(np.int64)
    total = np.zeros(n)
    np.add.at(total, text, count)
    # Interval 0 is [0,1); interval k is [2**(k-1), 2**k).
    parts = [(text, shingle, count, 0)]
    k = 1
    while len(at := np.flatnonzero(count > 1 << (k - 1))):
        parts.append((text[at], shingle[at], count[at], k))
        k += 1
    text, shingle, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
    level = np.concatenate([np.full(len(p[0]), p[3], dtype=np.int64) for p in parts])
    width = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    seed = _words.mix(shingle + level.astype(_U) * _U(0x632BE59BD9B4E019))
    rate, time, point = width * float(size), np.zeros(len(text)), 0
    # Most processes of a large bag have no point below the last component's minimum: follow them no further.
    limit = (np.log(size) + 3.0) / np.maximum(total, 1.0)
    while True:
        live, t, at = np.arange(len(text)), time.copy(), point
        while len(live):
            # Few processes left: many points of each at once. Sums run in the same order either way.
            more = max(1, min(256, 200_000 // len(live)))
            place = np.array([(at + 1 + j) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for j in range(more)], dtype=np.uint64)
            h = _words.mix(seed[live][:, None] + place[None, :])
            gap = -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[live][:, None]
            times = np.cumsum(np.concatenate((t[:, None], gap), axis=1), axis=1)[:, 1:]
            ok = times <= limit[text[live]][:, None]
            own, g = live[np.nonzero(ok)[0]], _words.mix(h[ok] ^ _U(0xA0761D6478BD642F))
            spot = (1 << np.maximum(level[own] - 1, 0)) * (level[own] > 0)  # lower end of the interval
            # The halvings of an interval are the leading bits of one more number.
            spot = spot + ((g >> _U(32)).astype(np.int64) * width[own] >> 32)
            inside = spot < count[own]
            component = ((g & _U(0xFFFFFFFF)) * _U(size) >> _U(32)).astype(np.int64)
            cell, at_time = (text[own] * size + component)[inside], times[ok][inside]
            np.minimum.at(best, cell, at_time)
            first = best[cell] == at_time
            winner[cell[first]] = g[inside][first]
            live, t, at = live[ok[:, -1]], times[ok[:, -1], -1], at + more
        short = np.flatnonzero(np.isinf(best.reshape(n, size)).any(axis=1) & (total > 0))
        if not len(short):
            break
        keep = np.isin(text, short)
        text, seed, level, width, count, rate, time = (x[keep] for x in (text, seed, level, width, count, rate, time))
        limit[short] *= 3.0
    return winner.reshape(n, size)


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band; keys of different bands differ as well."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = _words.mix(key ^ rows[:, :, r]) + _U(r)
    return key.view(np.int64)


def _sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of each component, sixteen to a long: counts of unequal ones bound the likeness."""
    four = _words.mix(signature) & _U(15)
    packed = np.zeros((len(four), SKETCHED // 16), dtype=np.uint64)
    for i in range(16):
        packed |= four[:, i::16] << _U(4 * i)
    return packed.view(np.int64)


_SIGNED = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _longs(rows: np.ndarray, skip: np.ndarray) -> pa.Array:
    """Rows as lists of longs, empty where ``skip`` is set."""
    sizes = np.where(skip, 0, rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(rows[~skip].ravel()))


def _sketches(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, bits) of the nodes' texts."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for first, words in _words.batches(batch.column(1).to_pylist(), SKETCH_TEXTS):
                bags = shingle_bags(words)
                signature = bag_min_hash(bags, SKETCHED)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(bags)), _longs(_sketch(signature), np.array([len(b[0]) == 0 for b in bags]))], names=["node", "bits"])

    made = texts.join(nodes.hint("merge"), "node").select("node", "text").mapInArrow(run, "node long, bits array<long>").filter(F.size("bits") > 0)
    return bucketed(made, "node", "sketches")


def signatures(docs: DataFrame) -> DataFrame:
    """(node, fingerprint, shingles, band keys) of each row of (doc_id, text)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, words in _words.batches(texts):
                bags = shingle_bags(words)
                signature = bag_min_hash(bags)
                size = np.array([int(b[1].sum()) for b in bags], dtype=np.int64)
                f1, f2 = _words.digests(words.blobs)
                empty = size == 0
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(bags)), pa.array(f1), pa.array(f2), pa.array(size), _longs(_band_keys(signature), empty)],
                    names=_SIGNED.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SIGNED)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose bags have a weighted Jaccard of ``threshold`` or more; ``texts`` is (node, text), bucketed by node.

    The text of ``b`` goes to each of its pairs. That of ``a``, a hub with many, goes once to every HUB_PAIRS of them: a hub of
    any fame is dealt to as many tasks as it has work for. Joins are by merging at every size, so plans do not change as tables grow.
    """
    pairs = written(pairs, "pairs")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("salts"))
    own = pairs.join(hubs.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    own = own.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    hubs = hubs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    hubs = hubs.select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = own.join(hubs.hint("merge"), ["a", "salt"]).select("a", "b", "ta", "tb")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[str, tuple] = OrderedDict()  # a hub's pairs come one after the other

        def bag(text: str) -> tuple:
            if text in kept:
                kept.move_to_end(text)
            else:
                kept[text] = shingle_bags(next(_words.batches([text]))[1])[0]
                if len(kept) > 8:
                    kept.popitem(last=False)
            return kept[text]

        for batch in found:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            ok = pa.array([jaccard(bag(x), bag(y)) >= threshold for x, y in zip(ta.to_pylist(), tb.to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node that links lead to.

    Rounds of taking the least label around and then that label's label; each round is written to the
    shared folder. The driver sees only counts.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = step.join(jump, "root").select("node", "old", F.least("root", "further").alias("root"))
        step = written(step, "labels")
        changed = step.filter("old <> root").limit(1).count()
        label = step.select("node", "root")
        if not changed:
            return label


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b): only the components that they tie together are worked on."""
    ends = links.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    ends = ends.join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    between = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    top = components(between)
    known = root.join(top.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
    known = known.select("node", F.coalesce("further", "root").alias("root"))
    return written(known.union(top.join(root.select("node"), "node", "left_anti").select("node", "root")), "labels")


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, node, n, fame) of every node in a bucket with others; fame is how many nodes its buckets hold.

    The text that copies were made from shares more buckets than any copy does, so it is the most famous.
    """
    dealt = reps.select(F.explode("bands").alias("key"), "node", "n")
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = written(dealt.join(sizes.hint("merge"), "key"), "met")
    fame = met.groupBy("node").agg(F.sum("size").alias("fame"))
    return met.select("key", "node", "n").join(fame, "node")


def _placed(met: DataFrame, root: DataFrame | None) -> DataFrame:
    """Buckets with the component ``r`` of each node."""
    if root is None:
        return met.withColumn("r", F.col("node"))
    return met.join(root.withColumnRenamed("root", "r"), "node", "left").withColumn("r", F.coalesce("r", "node"))


def _hubs(placed: DataFrame) -> DataFrame:
    """Each bucket's most famous node (ties: the least)."""
    best = F.max(F.struct("fame", (-F.col("node")).alias("o"), "node", "n", "r")).alias("hub")
    return placed.groupBy("key").agg(best).select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.r").alias("hub_r"))


def _stars(met: DataFrame, root: DataFrame | None, threshold: float) -> DataFrame:
    """Pairs of each bucket's hub and its other nodes; from the second round on the hub is one of those that the
    bucket's first hub did not settle, and the pairs are those with nodes of other components."""
    placed = _placed(met, root)
    hubs = _hubs(placed)
    if root is not None:
        placed = written(placed, "placed")
        left = placed.join(_hubs(placed).select("key", "hub_r"), "key").filter("r <> hub_r").drop("hub_r")
        hubs = _hubs(left)
    pairs = placed.join(hubs, "key").filter((F.col("r") != F.col("hub_r")) & (F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")))
    return pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def _unsettled(met: DataFrame, root: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs that no hub has settled: nodes outside the component of their bucket's hub, with nodes of other components."""
    placed = written(_placed(met, root), "placed")
    hub = _hubs(placed).select("key", "hub_r")
    left = placed.join(hub, "key").filter("r <> hub_r").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"))
    right = placed.join(left.select("key").distinct(), "key", "left_semi").select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    left, right = written(left, "left"), written(right, "right")
    bits = _sketches(right.select(F.col("b").alias("node")).distinct(), texts)

    def sketched(side: DataFrame, node: str, name: str) -> DataFrame:
        return side.join(bits.select(F.col("node").alias(node), F.col("bits").alias(name)).hint("merge"), node)

    def differ(x: Column, y: Column) -> Column:
        """Unequal components in two longs."""
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    def bound(n: int) -> float:
        """Of components that differ, one in 16 agrees by chance; SLACK standard deviations over what the threshold gives."""
        p = (1 - threshold) * 15 / 16
        return n * p + SLACK * (n * p * (1 - p)) ** 0.5

    left, right = sketched(left, "a", "xa"), sketched(right, "b", "xb")
    some = sum((differ(F.col("xa")[i], F.col("xb")[i]) for i in range(FIRST // 16)), F.lit(0))
    all_of = F.aggregate(F.zip_with("xa", "xb", differ), F.lit(0), lambda s, x: s + x)
    close = (F.col("ra") != F.col("rb")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (some <= bound(FIRST)) & (all_of <= bound(SKETCHED))
    rest = left.join(right.hint("merge"), (left["key"] == right["key"]) & close)
    return rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not used): doc_id, class_id, n_shingles.

    ``class_id`` is the least doc_id of the class: documents linked, directly or through others, by a
    weighted Jaccard of at least ``threshold`` over five-word shingles. Equal word sequences are one class.

    Defined cases: a null or empty text, or one without words, is a class of its own, and so is a row
    without doc_id (its class_id is null); a text of one to four words is a single shingle; rows that
    repeat a doc_id are one document, in one class if any of its texts link; empty tables give no rows.
    A pair at the threshold is missed by all 32 bands with probability 3e-6.
    """
    signed = written(signatures(docs), "signatures")
    return _classes(signed, docs, threshold)


def _classes(signed: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    worded = signed.filter("n > 0 and node is not null")
    # One shuffle of band keys: the least node of each word sequence, with its keys.
    first = F.min(F.struct("node", "n", "bands")).alias("rep")
    copies = written(worded.groupBy("f1", "f2").agg(first).select("f1", "f2", "rep.*"), "copies")
    reps = copies.select("node", "n", "bands")
    member = worded.select("node", "f1", "f2").join(copies.select("f1", "f2", F.col("node").alias("rep")), ["f1", "f2"])
    member = written(member.select("node", "rep").distinct(), "members")

    met = written(_buckets(reps), "buckets")
    # Whole texts are shuffled once, here: what follows joins the texts of nodes that share a bucket, and no others.
    # By merging at every size: what meets in buckets grows with the documents.
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(met.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = bucketed(texts, "node", "texts")
    root = None
    for _ in range(STAR_ROUNDS):
        found = written(verified(_stars(met, root, threshold), texts, threshold), "links")
        root = components(found) if root is None else _joined(root, found)
    rest = verified(_unsettled(met, root, texts, threshold), texts, threshold)
    # A document of several texts (rows that share a doc_id) ties their representatives together.
    several = member.groupBy("node").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    ties = member.join(several, "node", "left_semi").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    label = _joined(root, written(rest.union(ties), "links"))
    placed = member.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    least = placed.groupBy(F.col("node").alias("doc_id")).agg(F.min(F.coalesce("root", "rep")).alias("class_id"))
    out = signed.select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles")).join(least, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_shingles")
