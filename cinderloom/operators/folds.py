"""Ordered folds over a key's rows, and bounded hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the online learner.
RATE, DECAY, BIAS_LIMIT = 0.08, 0.001, 2.0


def folded(rows: DataFrame, keys: list[str], values: list[str], start: float, step: Callable[..., float], name: str) -> DataFrame:
    """(keys, name, n): ``step(state, *values)`` over each key's rows in order of (ts_ms, event_id).

    Keys are dealt out whole and their rows pass in order as a stream: a task holds one batch and one number, never a
    key's rows. A step needs the one before it, so the rows of one key are one task's.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    dealt = rows.select(*keys, "ts_ms", "event_id", *values).repartition(*keys).sortWithinPartitions(*keys, "ts_ms", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, n = None, start, 0
        for b in batches:
            done = []
            for key, row in zip(zip(*(b[k] for k in keys), strict=True), zip(*(b[v] for v in values), strict=True), strict=True):
                if key != own:
                    if own is not None:
                        done.append((*own, state, n))
                    own, state, n = key, start, 0
                state, n = step(state, *row), n + 1
            yield pd.DataFrame(done, columns=[*keys, name, "n"])
        if own is not None:
            yield pd.DataFrame([(*own, state, n)], columns=[*keys, name, "n"])

    return dealt.select(*keys, *values).mapInPandas(run, f"{kinds}, {name} double, n long")


def item_bias(events: DataFrame, label: Column, key: str = "movie_id") -> DataFrame:
    """(key, bias, n): the learner's steps in order of (ts_ms, event_id), from 0: towards label / 3 by a logistic step."""

    def step(b: float, t: float) -> float:
        return max(-BIAS_LIMIT, min(BIAS_LIMIT, b + RATE * (t - 1.0 / (1.0 + math.exp(-b)) - DECAY * b)))

    return folded(events.withColumn("t", label / 3.0), [key], ["t"], 0.0, step, "bias")


def q_values(steps: DataFrame, rate: float = 0.1, discount: float = 0.9) -> DataFrame:
    """(state, action, q) after the steps (reward, next_max) of each in order of (ts_ms, event_id)."""

    def step(q: float, reward: float, ahead: float) -> float:
        return q + rate * (reward + discount * ahead - q)

    return folded(steps, ["state", "action"], ["reward", "next_max"], 0.0, step, "q").drop("n")


def beta_draw(key: Column, alpha: Column, beta: Column, seed: int = 42) -> Column:
    """A draw of a Beta distribution for each row, the same at every run: each row's generator starts from its key.

    Two gamma draws by Marsaglia and Tsang's method, all rows of a batch at once; shapes must be 1 or more.
    """

    @F.pandas_udf("double")
    def drawn(k: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        def uniform(purpose: int) -> np.ndarray:
            x = k.to_numpy(dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(purpose * 0x632BE59BD9B4E019 + seed & 0xFFFFFFFFFFFFFFFF)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54

        def gamma(shape: np.ndarray, place: int) -> np.ndarray:
            d = shape - 1.0 / 3.0
            c, out, left, turn = 1.0 / np.sqrt(9.0 * d), np.zeros(len(shape)), np.ones(len(shape), dtype=bool), 0
            while left.any():
                u, r, t = (uniform(place + 3 * turn + i) for i in range(3))
                x = np.sqrt(-2.0 * np.log(r)) * np.cos(2.0 * np.pi * t)
                v = (1.0 + c * x) ** 3
                ok = left & (v > 0) & (np.log(u) < 0.5 * x * x + d - d * v + d * np.log(np.where(v > 0, v, 1.0)))
                out[ok], left, turn = (d * v)[ok], left & ~ok, turn + 1
            return out

        x, y = gamma(a.to_numpy(dtype=float), 0), gamma(b.to_numpy(dtype=float), 1 << 20)
        return pd.Series(x / (x + y))

    return drawn(key.cast("long"), alpha.cast("double"), beta.cast("double"))


def fnv1a_mixed(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes with a final mix, as a signed long. The multiplications wrap around, which SQL
    arithmetic forbids, so it runs on Arrow batches; one pass for each byte position, over all rows of the batch."""

    @F.pandas_udf("long")
    def hashed(s: pd.Series) -> pd.Series:
        blobs = [(x or "").encode() for x in s]
        width = max(map(len, blobs), default=0)
        h = np.full(len(blobs), 0xCBF29CE484222325, dtype=np.uint64)
        lengths = np.array([len(b) for b in blobs])
        grid = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in blobs), dtype=np.uint8).reshape(len(blobs), width) if width else None
        for i in range(width):
            on = lengths > i
            h[on] = (h[on] ^ grid[on, i].astype(np.uint64)) * np.uint64(0x100000001B3)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
        return pd.Series((h ^ (h >> np.uint64(33))).view(np.int64))

    return hashed(text)


def ring_shard(df: DataFrame, key: str, shards: int, virtual: int = 150) -> DataFrame:
    """``df`` with the shard whose ring point is the first at or after the key's hash, else the first of all.

    The ring has shards x virtual points (a fixed, small number), found by binary search in a sorted literal.
    """
    spark = df.sparkSession
    points = spark.range(shards * virtual).select((F.col("id") % shards).alias("shard"), F.format_string("v%d:%d", (F.col("id") / shards).cast("long"), F.col("id") % shards).alias("name"))
    ring = sorted((r["h"], r["shard"]) for r in points.select(fnv1a_mixed(F.col("name")).alias("h"), "shard").collect())
    at, own = np.array([h for h, _ in ring], dtype=np.int64), np.array([s for _, s in ring], dtype=np.int64)

    @F.pandas_udf("long")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(own[np.searchsorted(at, h.to_numpy(dtype=np.int64)) % len(at)])

    return df.withColumn("hash", fnv1a_mixed(F.col(key))).withColumn("shard", place("hash"))
