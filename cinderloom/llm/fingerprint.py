"""Homomorphic multiset fingerprints of documents (operator 6, DataFrame functions only).

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector, a text's
fingerprint is the sum of those vectors, each coordinate modulo a power of two. So equal multisets have equal
fingerprints in any order of paragraphs, and paragraphs are added to or taken from a fingerprint without the text.

The vector has three parts: EXACT words of 32 bits of the paragraph's SHA-256 (equality), the number of the
paragraph's pieces, and LANES coordinates that sum a sign for each piece. The signs
make sums of alike texts alike: squared distances of the last part estimate how many pieces differ. A piece ends where its
last word's own last character says so, so words put in or taken out change the pieces around them and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.llm._shared import written

EXACT = 8
#: Two lanes share a long while they are summed, 31 bits apart: enough for 2**31 pieces a text.
PAIRS = 31
LANES = 2 * PAIRS
_MASK = (1 << 31) | 1
#: Hex digits of a lane and of the number of pieces in the written fingerprint.
LANE_DIGITS, COUNT_DIGITS = 8, 8
#: Up to seven words that end in one of these letters (about half of all words) and one that does not; else a word alone.
PIECE = r"(?:\S++(?<=[adnosty])\s++){0,7}\S++(?<![adnosty])|\S++"


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.hex(x), digits, "0")


def _sums(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the vectors of (keys, paragraph, piece number, piece)."""
    h = F.xxhash64("piece")
    first = (F.col("at") == 0) & F.col("paragraph").isNotNull()
    exact = [F.sum(F.when(first, F.conv(F.substring(F.sha2("paragraph", 256), 8 * i + 1, 8), 16, 10).cast("long"))).alias(f"e{i}") for i in range(EXACT)]
    lanes = [F.sum(F.when(F.col("piece").isNotNull(), F.shiftright("h", j).bitwiseAND(F.lit(_MASK)))).alias(f"l{j}") for j in range(PAIRS)]
    return pieces.withColumn("h", h).groupBy(*keys).agg(*exact, F.count("piece").alias("n"), *lanes)


def _written_form() -> Column:
    """The sums as hex digits: EXACT words, the number of pieces, the lanes modulo 2**32."""
    exact = [_hex(F.coalesce(F.col(f"e{i}"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)), 8) for i in range(EXACT)]
    lanes = []
    for j in range(PAIRS):
        packed = F.coalesce(F.col(f"l{j}"), F.lit(0))
        for half in (packed.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(packed, 31)):
            # Bits 0 and 1 stand for signs -1 and +1.
            lanes.append(_hex((2 * half - F.col("n")).bitwiseAND(F.lit(0xFFFFFFFF)), LANE_DIGITS))
    return F.concat(*exact, _hex(F.col("n").bitwiseAND(F.lit(0xFFFFFFFF)), COUNT_DIGITS), *lanes)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fingerprint) of each row's whole text; ``keys`` must name rows apart. Null counts as empty."""
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph"))
    pieces = paragraphs.select(*keys, "paragraph", F.posexplode_outer(F.regexp_extract_all("paragraph", F.lit(PIECE), F.lit(0))).alias("p0", "piece"))
    pieces = pieces.withColumn("at", F.coalesce("p0", F.lit(0)))
    return _sums(pieces, keys).select(*keys, _written_form().alias("fingerprint"))


def _lanes(fingerprint: Column) -> Column:
    start = 8 * EXACT + COUNT_DIGITS
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.conv(F.substring(fingerprint, F.lit(start + 1) + i * LANE_DIGITS, F.lit(LANE_DIGITS)), 16, 10).cast("long"))


def _signed(x: Column) -> Column:
    """A lane or a difference of lanes as the number in -2**31..2**31 - 1 that it is modulo 2**32."""
    return (F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: 1 - |a-b|^2 / (|a|^2 + |b|^2), estimated from the lanes.

    Equal fingerprints have 1 (two empty texts too); one empty text and one that is not have 0. The standard error
    is about a tenth of the distance from 1. Lanes of a text are read right up to 2**31 pieces.
    """
    pairs = F.arrays_zip(_lanes(a).alias("x"), _lanes(b).alias("y"))
    apart = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + _signed(p["x"] - p["y"]) * _signed(p["x"] - p["y"]))
    sizes = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + _signed(p["x"]) * _signed(p["x"]) + _signed(p["y"]) * _signed(p["y"]))
    return F.when(a == b, 1.0).when(sizes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / sizes)))


def _lane_sum(x: Column, y: Column, sign: int, digits: int) -> Column:
    a, b = F.conv(x, 16, 10).cast("long"), F.conv(y, 16, 10).cast("long")
    return _hex(F.pmod(a + sign * b, F.lit(1 << (4 * digits))), digits)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the multiset with the paragraphs of ``b`` inserted (sign 1) or deleted (sign -1)."""
    cuts = [(8 * i + 1, 8) for i in range(EXACT)] + [(8 * EXACT + 1, COUNT_DIGITS)]
    cuts += [(8 * EXACT + COUNT_DIGITS + LANE_DIGITS * i + 1, LANE_DIGITS) for i in range(LANES)]
    return F.concat(*[_lane_sum(F.substring(a, s, n), F.substring(b, s, n), sign, n) for s, n in cuts])


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, n_chars) with next_id in ascending order, the last one's being the first.

    Ids are dealt out in ranges; each range finds its own successors, and one row a range finds the borders.
    """
    ranged = ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    borders = ranged.groupBy("range").agg(F.min("doc_id").alias("least"))
    borders = borders.select(
        F.col("range"),
        F.coalesce(F.lead("least").over(Window.orderBy("range")), F.min("least").over(Window.partitionBy())).alias("after"),
    )
    inside = F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id"))
    return ranged.withColumn("inside", inside).join(F.broadcast(borders), "range").select("doc_id", "n_chars", F.coalesce("inside", "after").alias("next_id"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document of (doc_id, text) and of its edited text, with likenesses.

    The edited text has the last quarter of the code points (rounded down) replaced by as many first ones, or
    all, of the next document. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Defined cases: a null text is empty; rows that repeat a doc_id are one document, the one with the least text;
    a row without doc_id has no place in the order and is left out; a single document is its own successor; empty
    tables give no rows; other columns are not read.
    """
    t = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = t.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("h"))
    repeated = lengths.groupBy("doc_id").agg(F.min(F.struct("n_chars", "h")).alias("own"), F.count(F.lit(1)).alias("k"))
    ids = repeated.select("doc_id", F.col("own.n_chars").alias("n_chars"))
    again = repeated.filter("k > 1").limit(1).count() > 0
    if again:
        t = t.groupBy("doc_id").agg(F.min(F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h"), "text")).alias("own")).select("doc_id", "own.text")
    order = written(successors(ids), "order")
    need = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before_id"), F.floor(F.col("n_chars") / 4).cast("int").alias("k"))
    heads = t.join(need, "doc_id").select(F.col("before_id").alias("doc_id"), F.expr("substring(text, 1, k)").alias("head"))
    both = t.join(heads, "doc_id").withColumn("n_chars", F.length("text"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - n_chars div 4)"), "head"))
    versions = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("body"), F.lit(None).cast("binary").alias("sha")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("body"), F.unhex(F.sha2("edited", 256)).alias("sha")),
    )
    v = both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.explode(versions).alias("v")).select("doc_id", "n_chars", "v.*")
    prints = fingerprints(v, ["doc_id", "n_chars", "version", "sha"], "body")
    one = prints.groupBy("doc_id", "n_chars").agg(
        F.max("sha").alias("sha"),
        F.max(F.when(F.col("version") == 0, F.unhex("fingerprint"))).alias("own"),
        F.max(F.when(F.col("version") == 1, F.unhex("fingerprint"))).alias("edited"),
    )
    one = written(one, "fingerprints")
    text = lambda c: F.lower(F.hex(c))
    ahead = one.select(F.col("doc_id").alias("next_id"), F.col("own").alias("next"))
    out = one.join(order.select("doc_id", "next_id"), "doc_id").join(ahead, "next_id")
    return out.select(
        "doc_id",
        "n_chars",
        text("sha").alias("edited_sha256"),
        text("own").alias("fingerprint"),
        text("edited").alias("edited_fingerprint"),
        likeness(F.hex("own"), F.hex("edited")).cast(T.DoubleType()).alias("near_edited"),
        likeness(F.hex("own"), F.hex("next")).cast(T.DoubleType()).alias("near_next"),
    )
