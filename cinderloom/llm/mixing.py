"""Mixing sources to target weights by Pareto order sampling (operator 5, DataFrame functions only).

A source with weight w shall give target words. Its ratio target / size is split into whole copies,
which every document gets for certain, and a fraction f. One copy more is a sample of unequal probabilities: a document's inclusion
probability is p = f + min(f, 1 - f) (B - b) / m, where b is the bit length of its size, B the mean of b over the source's words and
m the greatest b. So short documents are repeated rather than long ones, p stays in [0, 1], and since the deviations
sum to 0 over words, the words expected are just those the whole copies leave missing. The copies go to the documents of least Pareto
rank, (U / (1-U)) / (p / (1-p)), where U is a number from a hash of the document: in that order, each where its words still
fit. The sample's size is fixed in words: a source gives at most its target, short of it by less than the words of any document left out.

The order is never gathered: words are summed in BLOCKS x BLOCKS bins of rank for each source, the block and in it the bin where the
sum crosses are found from those sums, and only that bin's documents are put in order. The first document that does not fit
ends the round; the next one does the same with the documents beyond it that fit the smaller gap, until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.llm._shared import written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Bins of a source: BLOCKS blocks of BLOCKS bins.
BLOCKS = 256
#: Per-source rows that a broadcast may have (some 100 bytes each).
BROADCAST_ROWS = 100_000
SEED = "mix-1"


def words(text: str) -> Column:
    """Number of runs of anything but space, tab and the line breaks to carriage return; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): all words are shared by weight, under caps.

    Weights repeat over sources in code point order, null last. In order of cap / weight, the first k
    sources are at their cap; k is the least number for which the rest's equal share stays below theirs (more
    caps would only lower that share, so it is the largest that does). One row a source goes through these windows, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("i", F.row_number().over(by_name) - 1).withColumn("w", w)
    s = s.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    full = Window.orderBy("level", "i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(full), F.lit(0.0))).withColumn("weighed", F.coalesce(F.sum("w").over(full), F.lit(0.0)))
    all_rows = Window.partitionBy()
    s = s.withColumn("water", (F.sum("source_size").over(all_rows) - F.col("capped")) / (F.sum("w").over(all_rows) - F.col("weighed")))
    s = s.withColumn("share", F.max(F.when(F.col("water") <= F.col("level"), F.col("water"))).over(all_rows))
    target = F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("share") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def _unit(key: str, text: str) -> Column:
    """A number in (0, 1) from the md5 of the seed and the document's key, or where that is null its text's md5."""
    own = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    head = F.substring(F.md5(F.concat(F.lit(SEED + ":"), own)), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / 4503599627370496.0


def bits(size: Column) -> Column:
    """Bit length of a size: whole numbers, so that their sums have no order."""
    return F.length(F.bin(size)).cast("long")


def _ranked(slim: DataFrame) -> DataFrame:
    """Whole copies and, where the inclusion probability is not 0, the Pareto rank and its bin.

    Bins are of the rank times the fraction's odds, brought back to (0, 1): about U, so they fill evenly at any fraction.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = slim.withColumn("whole", F.floor(ratio).cast("long")).withColumn("f", ratio - F.floor(ratio))
    tilt = (F.col("bit_words") / F.greatest("source_size", F.lit(1)) - bits(F.col("size"))) / F.col("most_bits")
    s = s.withColumn("p", F.col("f") + F.least(F.col("f"), 1 - F.col("f")) * tilt)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    s = s.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), F.when(F.col("p") < 1, odds).otherwise(0.0)))
    even = F.col("rank") * F.col("f") / (1 - F.col("f"))
    return s.withColumn("bin", F.least(F.floor(even / (1 + even) * BLOCKS * BLOCKS), F.lit(BLOCKS * BLOCKS - 1)).cast("long"))


def plan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(slim documents, sources): sizes of documents; and of each source its target and where its order is cut.

    A document of a source gets ``whole`` copies, and one more if in one of ``rounds`` it is inside the bounds and fits the gap.
    """
    slim = docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), words(text).alias("size"), _unit(key, text).alias("u"))
    slim = written(slim, "sizes")
    b = bits(F.col("size"))
    sums = written(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(b * F.col("size")).alias("bit_words"), F.max(b).alias("most_bits")), "sums")
    sources = targets(sums.select("source", "source_size"), weights).withColumnRenamed("source", "s")
    sources = written(sources.join(sums.drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("source"), "sources")
    few = _few(sources)
    pool = _ranked(_joined(slim, sources, few)).filter("rank is not null").select("source", "doc", "size", "rank", "bin")
    missing = F.when(F.col("source_size") > 0, F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).otherwise(0.0)
    doc = slim.schema["doc"].dataType
    state = sources.select("s", missing.alias("gap"), F.lit(None).cast("double").alias("from_rank"), F.lit(None).cast(doc).alias("from_doc"))
    rounds = written(_round(pool, state, few), "round")
    found = rounds
    while True:
        # No document is shorter than a word.
        state = found.filter("rank is not null and left >= 1").select("s", F.col("left").alias("gap"), F.col("rank").alias("from_rank"), F.col("doc").alias("from_doc"))
        if state.isEmpty():
            break
        pool = written(_beyond(pool, state, few).select("source", "doc", "size", "rank", "bin"), "beyond")
        found = written(_round(pool, state, few), "round")
        rounds = rounds.unionByName(found)
    lists = rounds.groupBy(F.col("s").alias("ls")).agg(F.collect_list(F.struct("gap", "from_rank", "from_doc", "rank", "doc")).alias("rounds"))
    return slim, written(sources.join(lists, F.col("s").eqNullSafe(F.col("ls")), "left").drop("ls"), "cuts")


def _beyond(pool: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """Documents beyond the last that did not fit which fit their source's gap."""
    return _joined(pool, state, few).filter((F.col("size") <= F.col("gap")) & _after(F.col("from_rank"), F.col("from_doc")))


def _crossing(sums: DataFrame, start: DataFrame, few: bool) -> DataFrame:
    """(s, at, before) where words in order of ``at``, on from those of ``start``, first exceed the gap. At most BLOCKS rows a source
    go through the window."""
    some = sums.groupBy("s", "gap", "at").agg(F.sum("words").alias("words")).withColumnRenamed("s", "source")
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    over = _joined(some, start, few).withColumn("upto", upto).filter("upto > gap")
    return over.groupBy("s").agg(F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("before"))).alias("x")).select("s", "x.at", "x.before")


def _round(pool: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """``state`` with the first document (rank, doc) that does not fit, null where all do, and the words ``left`` before it."""
    beyond = _beyond(pool, state, few)
    sums = written(beyond.groupBy("s", "gap", "bin").agg(F.sum("size").alias("words")), "bins")
    zero = state.select("s", F.lit(0).cast("long").alias("before"))
    block = _crossing(sums.withColumn("at", F.floor(F.col("bin") / BLOCKS)), zero, few)
    inside = _joined(sums.withColumnRenamed("s", "source"), block.withColumnRenamed("at", "block"), few)
    crossed = _crossing(inside.filter(F.floor(F.col("bin") / BLOCKS) == F.col("block")).select("s", "gap", F.col("bin").alias("at"), "words"), block.select("s", "before"), few)
    crossed = written(crossed.select(F.col("s").alias("cs"), F.col("at").alias("cb"), "before"), "crossed")
    edge = beyond.join(F.broadcast(crossed) if few else crossed, F.col("s").eqNullSafe(F.col("cs")) & (F.col("bin") == F.col("cb")))
    order = Window.partitionBy("s").orderBy("rank", F.col("doc").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(order))
    fits = F.col("upto") <= F.col("gap")
    stop = edge.groupBy(F.col("s").alias("es")).agg(
        F.min(F.when(~fits, F.struct("rank", "doc"))).alias("stop"),
        F.coalesce(F.max(F.when(fits, F.col("upto"))), F.min("before")).alias("taken"),
    )
    return state.join(stop, F.col("s").eqNullSafe(F.col("es")), "left").select(
        "s", "gap", "from_rank", "from_doc", F.col("stop.rank").alias("rank"), F.col("stop.doc").alias("doc"), (F.col("gap") - F.col("taken")).alias("left")
    )


def _after(rank: Column, doc: Column) -> Column:
    """Whether a document is beyond (rank, doc) in its source's order; a null rank is before all."""
    later = F.col("doc").isNotNull() & (doc.isNull() | (F.col("doc") > doc))
    return rank.isNull() | (F.col("rank") > rank) | ((F.col("rank") == rank) & later)


def _before(rank: Column, doc: Column) -> Column:
    """Whether a document is before (rank, doc) in its source's order; a null rank is beyond all."""
    earlier = doc.isNotNull() & (F.col("doc").isNull() | (F.col("doc") < doc))
    return rank.isNull() | (F.col("rank") < rank) | ((F.col("rank") == rank) & earlier)


def _few(sources: DataFrame) -> bool:
    """Whether there are few enough rows of sources to broadcast."""
    return sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _joined(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Documents with their source's row: broadcast while sources are ``few``, else a join that AQE may split."""
    return docs.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("s")))


def decided(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (doc, source, size, u and others) with their source's row and ``n_copies``."""
    r = _ranked(_joined(rows, cuts, _few(cuts)))
    taken = F.exists("rounds", lambda x: (F.col("size") <= x["gap"]) & _after(x["from_rank"], x["from_doc"]) & _before(x["rank"], x["doc"]))
    more = F.when(F.col("rank").isNotNull() & taken, 1).otherwise(0)
    return r.withColumn("n_copies", F.col("whole") + more)


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target (of its source), taken (size x copies).

    Defined cases: a null text has size 0 and no copies count; a null source is a source, the last; rows
    that repeat a doc_id have one rank, and those that fit the gap are cut together by it; rows without doc_id have a rank by their text; a source without words has target 0; empty tables
    give no rows. The same table gives the same rows at every run.
    """
    slim, cuts = plan(docs, key=key, text=text, source=source, weights=weights)
    return decided(slim, cuts).select(F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted).

    Each row is decided by its own key and its source's cut, so texts are not shuffled. Columns of these names
    in ``docs`` are replaced.
    """
    _, cuts = plan(docs, key=key, text=text, source=source, weights=weights)
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "source_size", "target", "taken")])
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row")
    slim = kept.select(row, F.col(key).alias("doc"), F.col(source).alias("source"), words(text).alias("size"), _unit(key, text).alias("u"))
    return decided(slim, cuts).filter("n_copies > 0 and size > 0").select("row.*", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))

