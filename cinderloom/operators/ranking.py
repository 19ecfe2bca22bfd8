"""Ranking and paging operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.functions import scores
from cinderloom.operators.lineage import cut


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """1-based rank inside each group of ``by``; the order must be total. For groups that one task can hold; others are for placed()."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k of each group; Spark keeps k rows a group and task before it shuffles."""
    return ranked(df, by, *order).filter(F.col("rank") <= k)


def placed(df: DataFrame, *order: Column, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """ranked() for groups of any size, one of all rows included: rows are dealt to ranges of (by, order), numbered in each, and the
    counts of the ranges before are added. No task holds a group; what goes through a window without ranges is one row a range and group."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = "part_"
    dealt = cut(df.repartitionByRange(n, *[F.asc(c) for c in by], *order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part, *by).agg(F.count(F.lit(1)).alias("count_"))
    before = F.sum("count_").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(part, *by, F.coalesce(before, F.lit(0)).alias("before_"))
    own = dealt.withColumn("own_", F.row_number().over(Window.partitionBy(part, *by).orderBy(*order)))
    same = [own[part] == offsets[part], *[own[c].eqNullSafe(offsets[c]) for c in by]]
    return own.join(offsets, same).select(*[own[c] for c in df.columns], (F.col("own_") + F.col("before_")).alias(name))


def diversified(df: DataFrame, by: list[str], group: str, score: str, item: str) -> DataFrame:
    """Scores times the multiplier of the item's place in its diversity group, and the rank by them."""
    d = placed(df, F.desc(score), F.asc(item), by=(*by, group), name="nth")
    d = d.withColumn("place", F.col("nth") - 1).drop("nth").withColumn("final_score", F.col(score) * scores.diversity_multiplier(F.col("place")))
    return placed(d, F.desc("final_score"), F.desc(score), F.asc(item), by=tuple(by))


def keyset_page(df: DataFrame, score: str, key: str, size: int, after: tuple | None = None, before: tuple | None = None) -> DataFrame:
    """The page after (or before) an anchor of (score, key), by score and key descending, and whether more follow.

    One row more than the page is looked at; only size + 1 rows leave each task.
    """
    s, k = F.col(score), F.col(key)
    if after:
        df = df.filter((s < F.lit(after[0])) | ((s == F.lit(after[0])) & (k < F.lit(after[1]))))
    if before:
        df = df.filter((s > F.lit(before[0])) | ((s == F.lit(before[0])) & (k > F.lit(before[1]))))
    order = (F.asc(score), F.asc(key)) if before else (F.desc(score), F.desc(key))
    seen = df.orderBy(*order).limit(size + 1)
    seen = seen.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > size)
    return seen.filter(F.col("place") <= size)


def cursor_page(df: DataFrame, ranked_list: str, anchor: str, size: int) -> DataFrame:
    """``df`` with ``page`` and ``has_more``: of an array of structs (score, item_id, ...) what stands strictly behind the anchor struct.

    A list that is not in order of falling score, then rising id, is an error.
    """
    after = lambda x, a: (x["score"] < a["score"]) | ((x["score"] == a["score"]) & (x["item_id"] > a["item_id"]))
    l, a = F.col(ranked_list), F.col(anchor)
    pairs = F.zip_with(F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0))), F.slice(l, 1, F.greatest(F.size(l) - 1, F.lit(0))), lambda x, y: after(x, y))
    checked = F.when(F.forall(pairs, lambda ok: ok), l).otherwise(F.raise_error(F.lit("the ranked list is out of order")).cast(df.schema[ranked_list].dataType))
    rest = F.filter(checked, lambda x: after(x, a))
    return df.withColumn("rest", rest).withColumn("page", F.slice("rest", 1, size)).withColumn("has_more", F.size("rest") > size).drop("rest")


def deferred_page(df: DataFrame, key: str, order: list[Column], offset: int, size: int) -> DataFrame:
    """An offset page found on the order's columns alone and joined back to the wide rows; the page is at most ``size`` rows."""
    page = df.orderBy(*order).offset(offset).limit(size).select(key)
    return df.join(F.broadcast(page), key)
