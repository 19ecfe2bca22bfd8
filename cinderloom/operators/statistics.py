"""Quantiles of groups of any size, and bootstrap means by resampling with replacement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderloom.operators.ranking import placed

#: Rows of a block that one task draws from, and draws held at once.
BLOCK, DRAWS = 65_536, 1 << 20


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*by, name...): exact quantiles of the values that are not null, interpolated between the two neighbours.

    Values are ranked over ranges, and of each group only the rows on either side of a quantile are fetched: no task holds a group.
    """
    ranked = placed(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v_")), F.asc("v_"), by=tuple(by), name="at_")
    sizes = ranked.groupBy(*by).agg(F.max("at_").alias("n_"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n_") - 1)).alias("spot")) for name, q in shares.items()]))
    spots = sizes.select(*[F.col(c).alias(f"s_{c}") for c in by], wanted.alias("q_")).select(*[f"s_{c}" for c in by], "q_.*").withColumn("low", F.floor("spot"))
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in by]
    near = ranked.join(spots, [*same, (F.col("at_") - 1 == F.col("low")) | (F.col("at_") - 1 == F.col("low") + 1)])
    share = F.col("spot") - F.col("low")
    # The upper neighbour weighs what the spot is beyond the lower one.
    part = F.when(F.col("at_") - 1 == F.col("low"), F.col("v_") * (1 - share)).otherwise(F.when(share > 0, F.col("v_") * share).otherwise(0.0))
    return near.groupBy(*by).agg(*[F.sum(F.when(F.col("name") == n, part)).alias(n) for n in shares])


def nearest_ranks(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*by, name...): of each group the least value with at least that share of the values at or below it, found over ranges as in quantiles()."""
    ranked = placed(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v_")), F.asc("v_"), by=tuple(by), name="at_")
    sizes = ranked.groupBy(*[F.col(c).alias(f"s_{c}") for c in by]).agg(F.max("at_").alias("n_"))
    rank = lambda q: F.greatest(F.ceil(F.lit(float(q)) * F.col("n_")), F.lit(1))
    near = ranked.join(sizes, [*[F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in by], F.col("at_").isin(*[rank(q) for q in shares.values()])])
    return near.groupBy(*by).agg(*[F.max(F.when(F.col("at_") == rank(q), F.col("v_"))).alias(n) for n, q in shares.items()])


def bootstrap_means(df: DataFrame, by: str, key: list[str], value: str, resamples: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(by, resample, draws, mean): means of ``resamples`` samples of each group's rows, as many as it has, with replacement.

    Rows are dealt to blocks by a hash of ``key``, which must tell a group's rows apart. How many of a resample's draws fall to each block is a
    multinomial draw over the block's sizes, and inside a block each row is as likely: so the draws of every resample sum to the group's size,
    no row is copied, and a group of any size is many tasks' work. Seeds come from the group, the block and ``seed``, and a block's rows are in order
    of ``key``, so reruns agree.
    """
    rows = df.select(by, *key, F.col(value).cast("double").alias("v_"))
    parts = rows.groupBy(F.col(by).alias("of_")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).alias("parts"))
    dealt = rows.join(parts, F.col(by).eqNullSafe(F.col("of_"))).select(by, *key, "v_", F.pmod(F.xxhash64(*key), F.col("parts")).alias("block"))
    sizes = dealt.groupBy(by, "block").agg(F.count(F.lit(1)).alias("m"))

    def shared_out(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        m = f["m"].to_numpy()
        rng = np.random.default_rng([seed, int(f["salt"].iloc[0])])
        found = rng.multinomial(int(m.sum()), m / m.sum(), size=resamples)
        return pd.DataFrame({by: f[by], "block": f["block"], "draws": list(found.T.astype(np.int64))})

    kind = df.schema[by].dataType.simpleString()
    salt = F.pmod(F.xxhash64(F.lit(seed), by), F.lit(1 << 31)).alias("salt")
    # One row a block goes through a group's task.
    draws = sizes.select(by, "block", "m", salt).groupBy(by).applyInPandas(shared_out, f"{by} {kind}, block long, draws array<long>")

    def drawn(own: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key)
        v, times = own["v_"].to_numpy(), np.asarray(n["draws"].iloc[0])
        rng = np.random.default_rng([seed, int(own["salt"].iloc[0]), int(own["block"].iloc[0])])
        sums = np.zeros(resamples)
        for b in range(resamples):
            for at in range(0, int(times[b]), DRAWS):
                sums[b] += v[rng.integers(len(v), size=min(DRAWS, int(times[b]) - at))].sum()
        return pd.DataFrame({by: own[by].iloc[0], "resample": np.arange(resamples), "draws": times, "total": sums})

    left = dealt.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), by), F.lit(1 << 31))).groupBy(by, "block")
    sums = left.cogroup(draws.groupBy(by, "block")).applyInPandas(drawn, f"{by} {kind}, resample long, draws long, total double")
    return sums.groupBy(by, "resample").agg(F.sum("draws").alias("draws"), (F.sum("total") / F.sum("draws")).alias("mean"))
