"""File and stream sources with fixed schemas: nothing is inferred, malformed rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id string, eventId string, user_id string, userId int, item_id string, movieId int, event_type string, eventType string, watchMs long, dwellMs long, rating int, timestamp_ms long, eventTimeMillis long, session_id string, source string, features map<string,string>"


def movies_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, title, year, genres array from a headed CSV of up to four fields; rows of fewer than three go."""
    line = spark.read.text(path).withColumn("p", F.split("value", ",", 4))
    rows = line.filter((F.size("p") >= 3) & F.expr("try_cast(p[0] as int)").isNotNull())
    genres = F.filter(F.split(F.coalesce(F.get("p", F.lit(3)), F.lit("")), r"\|"), lambda g: F.trim(g) != "")
    return rows.select(F.trim(F.col("p")[0]).cast("int").alias("id"), F.trim(F.col("p")[1]).alias("title"), F.expr("try_cast(trim(p[2]) as int)").alias("year"), genres.alias("genres"))


def users_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id int, name string").option("mode", "DROPMALFORMED").csv(path, header=True)


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id int, item_id int, rating float, ts long").option("mode", "DROPMALFORMED").csv(path, header=True)


def embeddings_text(spark: SparkSession, path: str) -> DataFrame:
    """id and vector: cut at the first comma, then at white space; rows with a number that is not finite go."""
    p = spark.read.text(path).withColumn("p", F.split("value", ",", 2)).filter(F.size("p") == 2)
    vec = F.transform(F.split(F.trim(F.col("p")[1]), r"\s+"), lambda x: x.try_cast("float"))
    rows = p.select(F.expr("try_cast(trim(p[0]) as int)").alias("id"), vec.alias("vec")).filter("id is not null")
    return rows.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def canonical_events(raw: DataFrame) -> DataFrame:
    """Events under one name for each alias; ids are the digits behind the last underscore, else 0."""
    digits = lambda c: F.coalesce(F.regexp_extract(c, r"_(\d{1,9})$", 1).try_cast("int"), F.lit(0))
    return raw.select(
        F.coalesce("event_id", "eventId").alias("event_id"),
        F.coalesce("userId", digits("user_id")).alias("user_id"),
        F.coalesce("movieId", digits("item_id")).alias("movie_id"),
        F.lower(F.trim(F.coalesce("event_type", "eventType"))).alias("event_type"),
        F.coalesce("watchMs", F.lit(0)).alias("watch_ms"),
        F.coalesce("dwellMs", F.lit(0)).alias("dwell_ms"),
        "rating",
        F.coalesce("timestamp_ms", "eventTimeMillis").alias("ts_ms"),
        "session_id",
    )


def events_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return canonical_events(spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path))


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as a stream over the files that arrive in a folder."""
    return canonical_events(spark.readStream.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path))


def kafka_events(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """Event values of a topic (the Kafka connector must be on the class path); malformed values go."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    row = F.from_json(F.col("value").cast("string"), EVENT_SCHEMA)
    return canonical_events(raw.select(row.alias("e")).filter("e is not null").select("e.*"))


def merged_catalog(base: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """``base`` overlaid with ``more``: rows of ``more`` win whole."""
    return more.unionByName(base.join(more.select(key), key, "left_anti"), allowMissingColumns=True)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """One CSV of id and the vector with eight decimals, sorted by id."""
    text = F.array_join(F.transform("vec", lambda x: F.format_string("%.8f", x.cast("double"))), " ")
    vectors.select("id", text.alias("vector")).orderBy("id").coalesce(1).write.mode("overwrite").csv(path, header=True)
