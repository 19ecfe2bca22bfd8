"""Logical tables of the recommendation domain over the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """(user_id, item_id, rating 0.5..5, ts epoch seconds), the latest of each user and item; ``by_user`` they lie together by user, for what groups them so next."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    newest = Window.partitionBy("o_custkey", "l_partkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    r = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    r = (r.repartition("o_custkey") if by_user else r).withColumn("rn", F.row_number().over(newest)).filter("rn = 1")
    return r.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.ceil(F.col("l_quantity") / 5.0) / 2.0).alias("rating"),
        F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 1000).cast("long").alias("ts"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title, year, genres array)."""
    p = load(spark, sf_dir, "part")
    genres = F.concat(F.array("p_type"), F.split("p_name", " "))
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), (F.lit(1970) + F.col("p_size")).alias("year"), genres.alias("genres"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, year, genre, score decimal(12,6))."""
    p = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.lit(1970) + F.col("p_size")).alias("year"), F.col("p_type").alias("genre"), F.col("p_retailprice").cast("decimal(12,6)").alias("score"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, movie_id, event_type, watch_ms, ts_ms, session_id)."""
    e = load(spark, sf_dir, "events")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        "user_id",
        F.regexp_extract("props", r'"k": *(\d+)', 1).cast("long").alias("movie_id"),
        "event_type",
        F.floor(F.col("value") * 1000).cast("long").alias("watch_ms"),
        ts.alias("ts_ms"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec array<double>, label)."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, aggregate_id, status, created_ms, attempts, priority)."""
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "IN_FLIGHT").otherwise("DELIVERED")
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("aggregate_id"), status.alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms"), F.col("o_orderpriority").alias("priority"))


#: The same tables as SQL common table expressions for DuckDB.
SQL_TABLES = {
    "ratings": """ratings as (select user_id, item_id, rating, ts from (
        select o_custkey user_id, l_partkey item_id, ceil(l_quantity / 5.0) / 2.0 rating, cast(epoch_ms(l_shipdate) // 1000 as bigint) ts,
               row_number() over (partition by o_custkey, l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) rn
        from lineitem join orders on l_orderkey = o_orderkey) where rn = 1)""",
    "movies": "movies as (select p_partkey item_id, p_name title, 1970 + p_size as year, list_concat([p_type], string_split(p_name, ' ')) genres from part)",
    "catalog": "catalog as (select p_partkey id, p_name title, 1970 + p_size as year, p_type genre, cast(p_retailprice as decimal(12,6)) score from part)",
    "ev": """ev as (select 'evt-' || event_id event_id, user_id, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) movie_id, event_type,
        cast(floor(value * 1000) as bigint) watch_ms, epoch_us(ts) // 1000 ts_ms, user_id || '-' || strftime(ts, '%Y%m%d') session_id from events)""",
    "vectors": "vectors as (select vec_id id, cast(embedding as double[]) vec, label from embeddings)",
    "outbox": """outbox as (select o_orderkey event_id, o_custkey aggregate_id,
        case o_orderstatus when 'O' then 'PENDING' when 'P' then 'IN_FLIGHT' else 'DELIVERED' end status,
        epoch_ms(o_orderdate) created_ms, o_orderpriority priority from orders)""",
}
