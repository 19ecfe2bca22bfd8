"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where the session names none (tests); a cluster without
    that setting is an error, since executors could not see the driver's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by ``key``: joins on it shuffle the other side only."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{what}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", new_path(spark, what)).saveAsTable(name)
    return spark.table(name)


def crc_mod(spark_column: str, n: int) -> str:
    """SQL for crc32 of an id as text, modulo n; a null id counts as the text ''."""
    return f"crc32(cast(coalesce(cast({spark_column} as string), '') as binary)) % {n}"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


Compute = Callable[..., list[pa.Array]]


def append_columns(df: DataFrame, source: str, fields: list[T.StructField], make: Callable[[], Compute], also: list[str] | tuple = ()) -> DataFrame:
    """All columns of ``df`` and ``fields``, computed from the values of the column ``source`` (and of those in ``also``) by Arrow batch.

    ``make`` runs once a task and returns the function of a list of values for each of these columns. Arrow carries the other
    columns through untouched, so nothing is joined back and no row is shuffled. A new column whose name
    ``df`` has already gets underscores until it has not (free_name).
    """
    fields = [T.StructField(free_name(df, f.name), f.dataType) for f in fields]
    schema = T.StructType([*df.schema.fields, *fields])
    arrow = to_arrow_schema(schema)
    at = [df.columns.index(c) for c in (source, *also)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows:
                new = compute(*[batch.column(i).to_pylist() for i in at])
                arrays = [*batch.columns, *new]
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.mapInArrow(run, schema)
