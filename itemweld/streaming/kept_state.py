"""A keyed state that lasts: the latest row per key of an append-only log, kept in one folder.

    checkpoint/             which log files were read; a later run reads only newer ones
    rejects/batch_no=N/     rows of batch N that break the log's rule, written in the same pass
    changes/batch_no=N/     the rows of batch N that count, one per key, by bucket
    state/version=V/        the rows of the buckets that version V touched, merged with their older ones

A batch rewrites only the hash buckets its keys fall into; the newest finished version of each bucket is
current. Batch N writes version 2N and reads older ones only, so a batch repeated after a failure replaces what it left
half done. The order of rows decides, not their arrival, so late rows can't undo newer ones; deletes stay as tombstones
until ``compact`` drops them.
"""

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class Folder:
    """Listing and deleting through Hadoop's file systems, so that any shared storage works."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._conf, self._jvm = root.rstrip("/"), spark._jsc.hadoopConfiguration(), spark._jvm
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name) -> list:
        path = self._path(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def numbers(self, name, prefix, finished=True) -> list:
        """The numbers of the folders prefix=number, those whose write was finished."""
        found = [int(n.split("=")[1]) for n in self.names(name) if n.startswith(prefix + "=")]
        return sorted(n for n in found if not finished or self.exists(f"{name}/{prefix}={n}/_SUCCESS"))

    def exists(self, name) -> bool:
        return self._fs.exists(self._path(name))

    def drop(self, name) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old, new) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{self.root}: could not rename {old} to {new}")

    def read_text(self, name) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name, text) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


@dataclass
class Sync:
    """What a run did: batches, rows it read from the log, buckets it rewrote."""
    batches: int = 0
    input_rows: int = 0
    buckets: int = 0


class KeptState:
    """``schema`` is the log's; ``order`` the columns by which the latest row of a key is found, ``columns`` what
    is kept. ``accept`` gives a log's rows that count (it may mend them), ``rejected`` those that don't. The number of
    buckets is fixed when the folder is made: a bucket is what one task rewrites."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, order, columns, *,
                 accept=None, rejected=None, buckets=64):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.order, self.columns = key, [order] if isinstance(order, str) else list(order), list(columns)
        self.accept, self.rejected, self.folder = accept or (lambda df: df), rejected, Folder(spark, root)
        if self.folder.exists("state.json"):
            buckets = json.loads(self.folder.read_text("state.json"))["buckets"]
        else:
            self.folder.write_text("state.json", json.dumps({"buckets": buckets}))
        self.buckets = buckets

    @cached_property
    def kept_schema(self) -> StructType:
        empty = self.accept(self.spark.createDataFrame([], self.schema))
        return empty.select(*self.columns).schema

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Latest row per key and bucket; an aggregate, so that a hot key is combined before it moves."""
        rest = [c for c in self.columns if c not in [self.key] + self.order]
        return (rows.groupBy("bucket", self.key).agg(F.max(F.struct(*self.order, *rest)).alias("r"))
                .select("bucket", self.key, *[F.col(f"r.{c}").alias(c) for c in self.columns if c != self.key]))

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket"))

    def _current(self, before=None) -> dict:
        """bucket -> its newest finished version (below ``before``)."""
        found = {}
        for version in self.folder.numbers("state", "version"):
            if before is None or version < before:
                found.update({int(n.split("=")[1]): version for n in self.folder.names(f"state/version={version}") if n.startswith("bucket=")})
        return found

    def _read(self, current: dict) -> DataFrame:
        paths = [f"{self.root}/state/version={v}/bucket={b}" for b, v in sorted(current.items())]
        schema = self.kept_schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/state/version={version}")

    def _merge(self, batch_no: int) -> int:
        """Merge the changes of a batch into the buckets they touch; returns how many these are."""
        changed = f"changes/batch_no={batch_no}"
        touched = [int(n.split("=")[1]) for n in self.folder.names(changed) if n.startswith("bucket=")]
        if not touched:
            return 0
        version, current = 2 * batch_no, self._current(before=2 * batch_no)
        new = self.spark.read.schema(StructType([*self.kept_schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.root}/{changed}")
        old = self._with_bucket(self._read({b: v for b, v in current.items() if b in set(touched)}))
        both = new.select(*old.columns).unionByName(old).repartition(min(len(touched), self.buckets), "bucket")
        self._write(self._latest(both), version)      # aggregated on the buckets' partitioning, so state rows move once
        return len(touched)

    def _vacuum(self, keep_from: int) -> None:
        """Drop what newer finished versions replaced, but for the latest version's predecessors: a reader that
        listed the folder before the last batch still finds its files."""
        held = set(self._current(before=keep_from).values()) | set(self._current().values())
        for version in self.folder.numbers("state", "version", finished=False):
            if version < keep_from and version not in held:
                self.folder.drop(f"state/version={version}")
        for n in self.folder.numbers("changes", "batch_no", finished=False):
            if 2 * n < keep_from - 1:
                self.folder.drop(f"changes/batch_no={n}")

    def sync(self, log: str, max_bytes=1 << 30) -> Sync:
        """Work off the log files that no earlier run has read. At most ``max_bytes`` go into a batch; a log that
        doesn't exist yet is empty."""
        done = Sync()
        if not Folder(self.spark, log).exists(""):
            return done
        source = (self.spark.readStream.schema(self.schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(log))

        def take(batch: DataFrame, batch_no: int):
            held = batch.persist(StorageLevel.DISK_ONLY) if self.rejected is not None else batch     # the log is read once
            rows = self._latest(self._with_bucket(self.accept(held)))
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/changes/batch_no={batch_no}")
            if self.rejected is not None:
                self.rejected(held).write.mode("overwrite").parquet(f"{self.root}/rejects/batch_no={batch_no}")
                held.unpersist()
            done.buckets += self._merge(batch_no)
            done.batches += 1
            self._vacuum(2 * batch_no)

        query = (source.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.root}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        done.input_rows = sum(p.numInputRows for p in query.recentProgress)
        return done

    def read(self) -> DataFrame:
        """The latest row of every key, tombstones included."""
        return self._read(self._current())

    def read_rejects(self) -> DataFrame:
        numbers = self.folder.numbers("rejects", "batch_no")
        schema = self.rejected(self.spark.createDataFrame([], self.schema)).schema
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/rejects/batch_no={n}" for n in numbers])

    def read_changes(self, after: int = -1) -> DataFrame:
        """The rows that batches later than ``after`` took in, as far as they weren't dropped."""
        numbers = [n for n in self.folder.numbers("changes", "batch_no") if n > after]
        paths = [f"{self.root}/changes/batch_no={n}/{b}" for n in numbers for b in self.folder.names(f"changes/batch_no={n}") if b.startswith("bucket=")]
        return self.spark.read.schema(self.kept_schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.kept_schema)

    def compact(self, settled: str) -> None:
        """Rewrite the state as one version without the rows for which the SQL condition ``settled`` holds: tombstones
        so old that no row from before them can still arrive. Not while a ``sync`` runs."""
        versions = self.folder.numbers("state", "version")
        if not versions:
            return
        version = versions[-1] + 1 if versions[-1] % 2 == 0 else versions[-1]
        current = self._current(before=version)
        if version in versions:      # compacted already and nothing came since
            return
        kept = self._with_bucket(self._read(current).where(f"NOT coalesce({settled}, false)"))
        self._write(kept.repartition(len(current), "bucket"), version)
        for old in self.folder.numbers("state", "version", finished=False):
            if old != version:
                self.folder.drop(f"state/version={old}")
