"""A keyed table that streams write: the newest versions of each key stand, whatever comes again, late or twice.

Each micro-batch is reduced to the newest versions of its keys and added as a delta, so a write is as large as the batch, not as the
table. Reading takes the newest over base and deltas; after MOST_DELTAS the deltas and the base become a new base. What counts is the
manifest of greatest number: it names the folders of a snapshot and the last batch of each writer, and is put in place by a rename that fails
where its number is taken. So readers see whole snapshots, a batch that is written again changes nothing, and writers that meet
repeat their commit on what the other has left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_DELTAS, TRIES = 8, 20


class VersionedTable:
    """Rows of (key columns, version columns, others) in a folder; ``keep`` versions of each key stay, newest first by the version columns in order.

    Rows of equal key and version are one row, the greatest by its other columns. A null in a version column is older than any value; keys may be null.
    """

    def __init__(self, spark: SparkSession, path: str, key: Iterable[str], version: Iterable[str] = ("ts_ms", "event_id"), keep: int = 1, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.key, self.version, self.keep, self.most_deltas = spark, path.rstrip("/"), [*key], [*version], keep, most_deltas
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._jvm, self._fs = jvm, self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def _numbers(self) -> list[int]:
        log = self._at(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))

    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "base": None, "deltas": [], "batches": {}, "schema": None}
        stream = self._fs.open(self._at(f"{self.path}/log/{numbers[-1]:020d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _put(self, manifest: dict) -> bool:
        """Whether the manifest is in place; False where its number was taken meanwhile."""
        draft, final = self._at(f"{self.path}/log/.{uuid.uuid4().hex}"), self._at(f"{self.path}/log/{manifest['number']:020d}.json")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        try:
            options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False

    def _commit(self, change: Callable[[dict], dict | None]) -> bool:
        for _ in range(TRIES):
            now = self.manifest()
            new = change(now)
            if new is None:
                return False
            if self._put({**now, **new, "number": now["number"] + 1}):
                return True
        raise RuntimeError(f"{self.path}: {TRIES} commits in a row met others")

    # Rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key + self.version]
        one = rows.groupBy(*self.key, *self.version).agg(F.max(F.struct(*rest)).alias("row")) if rest else rows.distinct()
        order = Window.partitionBy(*self.key).orderBy(*[F.col(c).desc_nulls_last() for c in self.version])
        top = one.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= self.keep)
        return top.select(*self.key, *self.version, *([F.col("row." + c) for c in rest] if rest else []))

    def _all(self, manifest: dict) -> DataFrame | None:
        folders = [f for f in (manifest["base"], *manifest["deltas"]) if f]
        return self.spark.read.schema(manifest["schema"]).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else None

    def read(self, *, alive_at_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame | None:
        """The newest rows of each key, None before the first write; with both arguments without those whose first version column is ``ttl_ms`` old."""
        rows = self._all(self.manifest())
        if rows is None:
            return None
        found = self._newest(rows)
        return found if ttl_ms is None else found.filter(F.col(self.version[0]) + ttl_ms > alive_at_ms)

    def write(self, rows: DataFrame, batch: int, writer: str = "stream") -> bool:
        """Adds a batch; False, and nothing done, where that writer's batch of this number or a later one is in."""
        if self.manifest()["batches"].get(writer, -1) >= batch:
            return False
        folder = f"delta-{uuid.uuid4().hex}"
        new = self._newest(rows)
        new.write.parquet(f"{self.path}/data/{folder}")

        def change(now: dict) -> dict | None:
            if now["batches"].get(writer, -1) >= batch:
                return None
            return {"deltas": [*now["deltas"], folder], "batches": {**now["batches"], writer: batch}, "schema": now["schema"] or new._jdf.schema().toDDL()}

        done = self._commit(change)
        if len(self.manifest()["deltas"]) > self.most_deltas:
            self.compact()
        return done

    def compact(self) -> None:
        """Base and deltas become one base; deltas that came meanwhile stay."""
        seen = self.manifest()
        rows = self._all(seen)
        if rows is None:
            return
        folder = f"base-{uuid.uuid4().hex}"
        self._newest(rows).write.parquet(f"{self.path}/data/{folder}")

        def change(now: dict) -> dict | None:
            if now["base"] != seen["base"] or now["deltas"][: len(seen["deltas"])] != seen["deltas"]:
                return None
            return {"base": folder, "deltas": now["deltas"][len(seen["deltas"]) :]}

        self._commit(change)

    def vacuum(self, snapshots: int = 2) -> int:
        """Removes manifests before the last ``snapshots`` and the folders that only they name; returns how many folders went. Not while others write."""
        numbers = self._numbers()
        kept: set[str] = set()
        for n in numbers[-snapshots:]:
            stream = self._fs.open(self._at(f"{self.path}/log/{n:020d}.json"))
            found = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            kept |= {f for f in (found["base"], *found["deltas"]) if f}
        for n in numbers[:-snapshots]:
            self._fs.delete(self._at(f"{self.path}/log/{n:020d}.json"), False)
        gone = [s.getPath() for s in self._fs.listStatus(self._at(f"{self.path}/data")) if s.getPath().getName() not in kept]
        for folder in gone:
            self._fs.delete(folder, True)
        return len(gone)

    def stream(self, rows: DataFrame, checkpoint: str, writer: str = "stream"):
        """Starts the query that writes each micro-batch of ``rows``."""
        return rows.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(lambda b, n: self.write(b, n, writer) and None).start()


def lineage(table: VersionedTable, value: str = "value") -> DataFrame:
    """(key, value, last_event, event_history) of a table that keeps several versions: the newest value, its event, and the events oldest first, as one text."""
    versions = F.sort_array(F.collect_list(F.struct(*table.version, value)))
    rows = table.read().groupBy(*table.key).agg(versions.alias("v"))
    event = table.version[-1]
    return rows.select(*table.key, F.element_at("v", -1)[value].alias(value), F.element_at("v", -1)[event].alias("last_event"), F.array_join(F.transform("v", lambda x: x[event]), ",").alias("event_history"))


def event_keys(rows: DataFrame, key: str = "key") -> DataFrame:
    """(event_id, keys): the reverse index, every key that an event was written to, in order, as one text."""
    return rows.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("keys"))
