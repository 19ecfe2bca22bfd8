"""Quality classifier by compression (operator 7).

Two zstandard dictionaries are trained, from good and from bad labelled texts. A text, in pieces of
PIECE bytes, is compressed with each. How many bytes fewer the good dictionary needs, over the text's bytes, is its
normalised compressed-size difference; SMALL bytes more in the denominator keep very short texts near the middle. A logistic
curve fitted on labelled texts the dictionaries have not seen turns the difference into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderloom.llm._shared import append_columns, written

PIECE = 512
LEVEL = 3
DICTIONARY_BYTES = 112_640
#: Bounds on the sample of labelled rows of each class: rows, and bytes of those that make a dictionary. Rows are used whole or not at all.
FIT_ROWS, FIT_BYTES = 1500, 16 << 20
#: Bytes added to a text's length before it divides the difference.
SMALL = 10
GOOD_FROM = 0.7


class Model(NamedTuple):
    good: bytes
    bad: bytes
    curve: tuple[float, float]  # of the difference and 1


def _pieces(text: str | None) -> list[bytes]:
    blob = text.encode("utf-8", "surrogatepass") if text else b""
    return [blob[i : i + PIECE] for i in range(0, len(blob), PIECE)]


class _Meter:
    """Compressed sizes of a text under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.compress = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            options = {"level": LEVEL, "dict_data": d, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.compress.append(zstandard.ZstdCompressor(**options).compress)

    def difference(self, text: str | None) -> float:
        """Bytes that the good dictionary saves against the bad one, over the whole text's bytes."""
        good, bad = self.compress
        saved = size = 0
        for p in _pieces(text):
            saved += len(bad(p)) - len(good(p))
            size += len(p)
        return saved / (size + SMALL)


def _score(x: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(curve), -30, 30)))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    if not samples:
        return b"\x00" * 8
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\x00")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """The curve by Newton's steps, with a slight pull to 0 that keeps separable classes finite."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    a, w, pull = x / scale, np.zeros(x.shape[1]), 1e-3
    for _ in range(60):
        p = _score(a, tuple(w))
        slope = a.T @ (weight * (y - p)) - pull * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + pull * np.eye(len(w)), slope)
        w += step
        if abs(step).max() < 1e-9:
            break
    return tuple((w / scale).tolist())


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Dictionaries and curve from labelled rows where ``learn`` (an expression of ``key``) holds.

    The sample is bounded by ``fit_rows`` labelled rows of each class, the least by a hash of their key: odd ones in that order make
    the dictionaries, while they have at most ``fit_bytes`` together, even ones the curve, weighted to the classes' shares of all
    labels. Rows are used whole. Only dictionary texts reach the driver; the curve's are measured where they lie.

    Defined cases: labels other than 0 and 1 and null keys are not used; of labels that contradict each other the bad one holds; a key of
    several texts gives each of them; null texts are empty; where a class has too few rows every score is the share of good
    labels (0.5 without any). Keys are of any type.
    """
    spark = docs.sparkSession
    known = labels.filter(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    known = known.groupBy("key").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("key", F.lit(7)))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # A cut by hash leaves about twice the rows wanted of a class, whatever its size; only those are put in order.
    place = F.pmod("h", F.lit(1 << 31)) / float(1 << 31)
    near = known.filter(F.coalesce(*[F.when((F.col("y") == y) & (place < 2.0 * fit_rows / n), True) for y, n in shares.items()], F.lit(False)))
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", F.col("key").cast("string")))).filter(F.col("k") <= fit_rows).select("key", "y", "k")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    rows = written(rows.join(F.broadcast(chosen), "key").select("y", "k", "text"), "labelled")  # fit_rows a class

    size = rows.filter("k % 2 = 1").select("y", "k", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n")).filter(F.col("n") <= fit_bytes)
    upto = F.sum("n").over(Window.partitionBy("y").orderBy("k", "h").rangeBetween(Window.unboundedPreceding, 0))
    used = size.withColumn("upto", upto).filter(F.col("upto") <= fit_bytes).select("y", "k", "h").distinct()
    texts = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(used), ["y", "k", "h"]).select("y", "k", "text").collect()
    own = {c: [p for _, t in sorted((r["k"], r["text"]) for r in texts if r["y"] == c) for p in _pieces(t)] for c in (0, 1)}
    good_share = (shares.get(1, 0) + 1e-6) / (sum(shares.values()) + 2e-6)
    flat = Model(_dictionary([]), _dictionary([]), (0.0, float(np.log(good_share / (1 - good_share)))))
    if not own[0] or not own[1]:
        return flat
    good, bad = _dictionary(own[1]), _dictionary(own[0])
    shared = spark.sparkContext.broadcast((good, bad))  # DICTIONARY_BYTES each

    def measured(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(*shared.value)
        for batch in found:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([meter.difference(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["y", "x"])

    seen = sorted(tuple(r) for r in rows.filter("k % 2 = 0").select("y", "text").mapInArrow(measured, "y int, x double").collect())
    y, x = np.array([r[0] for r in seen], dtype=float), np.array([(r[1], 1.0) for r in seen])
    if len(set(y.tolist())) < 2:
        return flat
    weight = np.where(y == 1, good_share / y.mean(), (1 - good_share) / (1 - y.mean()))
    return Model(good, bad, _logistic(x, y, weight))


def scored(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1, higher is better) of each whole text, all columns kept.

    A null or empty text has no bytes to compare and gets what the curve says of no difference. Very long texts go
    piece by piece. Repeated rows score alike; a ``name`` that is taken gets underscores (free_name); empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES at most

    def make():
        m = shared.value
        meter = _Meter(m.good, m.bad)

        def compute(texts: list) -> list[pa.Array]:
            return [pa.array(_score(np.array([(meter.difference(t), 1.0) for t in texts]), m.curve))]

        return compute

    return append_columns(docs, text, [T.StructField(name, T.DoubleType())], make)
