"""Stage tables: results written once to shared storage and read back.

A stage cuts the lineage (a lost executor costs at most the running stage) and,
being a file relation, carries its size, so the optimizer itself decides from
the real bytes whether a later join may broadcast it.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots = {}


def stage_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="itemweld-")
    return _local_roots[context.applicationId]


class Stages:
    """Names stage tables inside one folder of the shared root. ``lean``: the shuffle files behind a
    table go as soon as it is written, not when the driver next collects its garbage."""

    def __init__(self, spark: SparkSession, label="run", lean=False):
        self.spark, self.lean = spark, lean
        self.folder = (f"{stage_root(spark)}/itemweld/{spark.sparkContext.applicationId}"
                       f"/{label}-{uuid.uuid4().hex[:8]}")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.drop()

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(CLEANUP, "false")
        if self.lean:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**options).parquet(path)
        finally:
            if self.lean:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def location(saved: DataFrame) -> str:
        """The folder of a table that ``save`` gave."""
        folders = {f.rsplit("/", 1)[0] for f in saved.inputFiles()}
        if len(folders) != 1:
            raise ValueError("not one stored table")
        return folders.pop()

    def forget(self, *saved: DataFrame) -> None:
        """Delete stage tables of this run that nothing reads any more; other tables are left alone."""
        for df in saved:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if folder.rsplit("/", 2)[-2] == self.folder.rsplit("/", 1)[-1]:
                    self._delete(folder)

    def drop(self) -> None:
        """Delete this run's stage tables once its results are stored."""
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
