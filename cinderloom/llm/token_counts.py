"""Exact token-length histogram (operator 3).

Texts are encoded whole; only the pair (length, number of documents) is kept. From the histogram, sums
from each length upwards give totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.llm._shared import append_columns, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word split of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the pattern's \s takes, and the least run of them that is cut out before the pattern, whose search goes back over it, sees the text.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = 4096
#: Lengths in one block of the two-level suffix sum.
BLOCK = 1024


def _encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(encoding, text: str) -> int:
    """Tokens of the whole text. In a long run of white space all but the last character are one piece, at the end of a text all of them: so the
    pattern cuts, and so they are cut here, before it."""
    total, at = 0, 0
    for run in re.finditer(f"[{SPACE}]{{{LONG_SPACE},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def with_length(docs: DataFrame, *, text: str = "text", name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` and the encoded length of the whole text; null and empty texts have 0 tokens.

    ``vocabulary`` is a file of token ranks that every executor has at that path.
    """

    def make():
        encoding = _encoder(vocabulary)

        def compute(texts: list) -> list[pa.Array]:
            return [pa.array([encoded_length(encoding, t) if t else 0 for t in texts], pa.int64())]

        return compute

    return append_columns(docs, text, [T.StructField(name, T.LongType())], make)


def length_histogram(docs: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    slim = docs.select(F.col(text).alias("text"))
    return with_length(slim, vocabulary=vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as context limit: what is as long or longer, and totals cut at L.

    Columns: n_tokens (L), n_docs, docs_from (documents of L tokens or more), tokens_from (their tokens),
    docs_upto and tokens_upto (documents of at most L), truncated_tokens (total when every document is cut at L),
    share_upto (docs_upto over all documents; the q-quantile of length is the least L whose share is q or more),
    shorter (the next shorter length that occurs, null for the least).

    Sums run in two levels, inside blocks of lengths and over blocks, so no task holds the whole histogram.
    Empty input gives no rows.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    h = histogram.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"), F.max("n_tokens").alias("longest"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.lag("longest").over(Window.orderBy("block")).alias("block_before"),
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("t_after"),
        F.sum("bd").over(everything).alias("all_docs"),
        F.sum("bt").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(blocks, "block")
    s = s.withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("d_after"))
    s = s.withColumn("tokens_from", F.sum("tokens").over(inside) + F.col("t_after"))
    s = s.withColumn("docs_upto", F.col("all_docs") - F.col("docs_from") + F.col("n_docs"))
    s = s.withColumn("tokens_upto", F.col("all_tokens") - F.col("tokens_from") + F.col("tokens"))
    s = s.withColumn("truncated_tokens", F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens"))
    s = s.withColumn("share_upto", F.col("docs_upto") / F.col("all_docs"))
    s = s.withColumn("shorter", F.coalesce(F.lead("n_tokens").over(Window.partitionBy("block").orderBy(F.desc("n_tokens"))), "block_before"))
    return s.select("n_tokens", "n_docs", "docs_from", "tokens_from", "docs_upto", "tokens_upto", "truncated_tokens", "share_upto", "shorter")


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, met or not: limit, docs_over, truncated_tokens. One row for each limit (repeats count once).

    A row of ``sums`` answers all limits from the next shorter length up to its own, less one; it is found by the block of
    the limit, so a limit meets at most BLOCK rows and nothing is summed again. Limits beyond every length cut nothing.
    """
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(x, x // BLOCK) for x in sorted({int(x) for x in limits})], "limit long, block long")
    whole = sums.agg(F.coalesce(F.max("tokens_upto"), F.lit(0)).alias("all_tokens"))
    blocks = F.sequence(F.floor(F.col("shorter") / BLOCK), F.floor((F.col("n_tokens") - 1) / BLOCK))
    rows = sums.withColumn("shorter", F.coalesce(F.col("shorter"), F.lit(-1))).filter("n_tokens > shorter")
    rows = rows.select("n_tokens", "shorter", "docs_from", "tokens_from", F.explode(blocks).alias("block"))
    found = wanted.join(rows, "block").filter("limit >= shorter and limit < n_tokens").drop("block")
    # A limit below zero lets nothing through.
    over, upto = F.coalesce("docs_from", F.lit(0)), F.greatest("limit", F.lit(0))
    out = wanted.select("limit").join(found, "limit", "left").join(F.broadcast(whole))  # one row
    return out.select("limit", over.alias("docs_over"), (F.col("all_tokens") - F.coalesce("tokens_from", F.lit(0)) + over * upto).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least ``share`` of all documents do not exceed, for shares from 0 to 1.

    Each row of ``sums`` holds the shares between its predecessor's and its own, so one look over the histogram finds
    all; an empty one gives no rows.
    """
    before = (F.col("docs_upto") - F.col("n_docs")) / (F.col("docs_upto") / F.col("share_upto"))
    asked = F.array(*[F.lit(float(q)) for q in sorted(set(shares))])
    mine = F.filter(asked, lambda q: ((q > before) | ((q <= 0) & (before == 0))) & (q <= F.col("share_upto")))
    return sums.select(F.explode(mine).alias("share"), "n_tokens")


def token_counts(docs: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Histogram of whole texts' encoded lengths, made once and written, with suffix sums; extra columns of ``docs`` are not read."""
    return suffix_sums(written(length_histogram(docs, text=text, vocabulary=vocabulary), "lengths"))
