"""A stored index of vectors, so that a search for a few parts reads a few files.

    bands/version=V/      the cell dimensions of every category, chosen when the index was built
    data/version=V/       vectors sorted by block and along a Z-order curve of cells, so that a file covers a small box of few blocks
    manifest/version=V/   per file and block: number of rows, least and largest value of every cell dimension

A search first reads, for each probe, the files nearest to it that hold enough rows: the k-th distance found there
bounds the true one. Then it reads what else the ball of that radius touches. The files come from the manifest,
which has a row per file and block, not per part. ``refresh`` takes in changed vectors: only files that hold an
old version of a changed part are rewritten, new vectors go to files of their own, and readers see the newest finished manifest.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from itemweld.operators import neighbors as N
from itemweld.sources.staging import Stages
from itemweld.streaming.kept_state import Folder

UNIT = 0.25                    # cells for sorting are twice as wide
ROWS_PER_FILE = 250_000
SCHEMA = "part_id string, part_category string, material string, feature_vector array<double>"
KEYS = [f"c{i}" for i in range(N.MAX_BANDS)]
PLACES = [f"_x{i}" for i in range(N.MAX_BANDS)]
SLACK = 1e-9                   # widens boxes, so that rounding can't lose a part at the radius


def curve(cells, bits=12):
    """The place of a cell on a Z-order curve, along which neighbouring cells mostly lie together: bits interleaved.
    Cells further out than the bits reach share the outermost place; that costs only file skipping."""
    half = 1 << (bits - 1)
    whole = [F.least(F.greatest(c + half, F.lit(0)), F.lit(2 * half - 1)).cast("bigint") for c in cells]
    spread = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("bigint")), len(cells) * b + i)
              for b in range(bits) for i, c in enumerate(whole)]
    return reduce(lambda x, y: x.bitwiseOR(y), spread)


class NeighborIndex:
    """Vectors of one length in a folder. ``read_files`` holds the names of the files that the last search read."""

    def __init__(self, spark: SparkSession, root: str, rows_per_file=ROWS_PER_FILE):
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file
        self.folder, self.read_files = Folder(spark, root), []

    # writing
    def build(self, vectors: DataFrame) -> None:
        """Replace the index by ``vectors`` (part_id, part_category, material, feature_vector)."""
        version = self._next()
        N.plan_bands(vectors.select(*N.BLOCK, "feature_vector"), UNIT, partners=0.0).write.mode("overwrite").parquet(f"{self.root}/bands/version={version}")
        self._publish(version, self._write(vectors, version, version), None)

    def refresh(self, changes: DataFrame) -> dict:
        """Take in ``changes``: one row per part with op (insert, update or delete) and its vector. Returns how many files
        were written and how many dropped out."""
        version, old = self._next(), self.manifest()
        with Stages(self.spark, "index") as stages:
            changes = stages.save(changes.select("part_id", "op", *N.BLOCK, "feature_vector"), "changes")
            ids = changes.select("part_id")
            held = self._table(self._names(old))
            touched = [r.file for r in held.select("part_id", self._file()).join(ids, "part_id", "left_semi").select("file").distinct().collect()]
            kept = self._table(touched).join(ids, "part_id", "left_anti")
            new = changes.where("op <> 'delete'").select(*kept.columns)
            written = self._write(kept.unionByName(new), version, self._bands_version())
            self._publish(version, written, old.where(~F.col("file").isin(touched)) if touched else old)
        return {"written": len(self._names(self.manifest(version).where(F.col("file").startswith(f"version={version}/")))), "replaced": len(touched)}

    def _write(self, vectors: DataFrame, version: int, bands_version: int) -> DataFrame:
        path, bands = f"{self.root}/data/version={version}", self._bands(bands_version)
        celled = N.home_cells(vectors.select("part_id", *N.BLOCK, "feature_vector"), bands, UNIT)
        files = max(1, -(-vectors.count() // self.rows_per_file))
        salt = F.xxhash64("part_id")         # copies of one vector may fill many files
        order = [*N.BLOCK, curve([F.col(c) for c in KEYS])]
        (celled.repartitionByRange(files, *order, salt).sortWithinPartitions(*order, salt)
         .drop(*KEYS).write.mode("overwrite").parquet(path))
        if not [n for n in self.folder.names(f"data/version={version}") if n.endswith(".parquet")]:
            return self._manifest_of(None, bands, bands_version)
        return self._manifest_of(self.spark.read.schema(SCHEMA).parquet(path), bands, bands_version)

    def _manifest_of(self, stored, bands: DataFrame, bands_version: int) -> DataFrame:
        rows = self.spark.createDataFrame([], SCHEMA).withColumn("file", F.lit("")) if stored is None else stored.withColumn("file", self._file())
        boxes = [f for c in PLACES for f in (F.min(c).alias(f"low{c}"), F.max(c).alias(f"high{c}"))]
        return (N._banded(rows, bands, N.MAX_BANDS).groupBy("file", *N.BLOCK).agg(F.count(F.lit(1)).alias("rows"), *boxes)
                .withColumn("bands_version", F.lit(bands_version).cast("bigint")))

    def _publish(self, version: int, new: DataFrame, old) -> None:
        """The manifest is written last: until it is finished readers stay with the one before. Files that neither
        this manifest nor the one before names are deleted."""
        (new if old is None else new.unionByName(old)).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        done = self.folder.numbers("manifest", "version")[-2:]
        named = {n for v in done for n in self._names(self.manifest(v))}
        for v in self.folder.numbers("data", "version", finished=False):
            stale = [n for n in self.folder.names(f"data/version={v}") if n.endswith(".parquet") and f"version={v}/{n}" not in named]
            for n in stale:
                self.folder.drop(f"data/version={v}/{n}")
        for v in self.folder.numbers("manifest", "version", finished=False):
            if v < done[0]:
                self.folder.drop(f"manifest/version={v}")

    # reading
    def _next(self) -> int:
        return max([0, *self.folder.numbers("manifest", "version", finished=False), *self.folder.numbers("data", "version", finished=False)]) + 1

    def _bands_version(self) -> int:
        """Those the newest manifest's boxes were measured on; a build that ended early may have left newer ones."""
        return self.manifest().agg(F.max("bands_version")).first()[0] or self.folder.numbers("bands", "version")[-1]

    def _bands(self, version: int) -> DataFrame:
        return self.spark.read.schema("part_category string, bands array<int>").parquet(f"{self.root}/bands/version={version}")

    def exists(self) -> bool:
        return bool(self.folder.numbers("manifest", "version"))

    def vectors(self) -> DataFrame:
        """All stored vectors."""
        return self._table(self._names(self.manifest()))

    def manifest(self, version=None) -> DataFrame:
        done = self.folder.numbers("manifest", "version")
        if not done:
            raise ValueError(f"no index in {self.root}")
        boxes = ", ".join(f"low{c} double, high{c} double" for c in PLACES)
        return (self.spark.read.schema(f"file string, part_category string, material string, rows long, {boxes}, bands_version long")
                .parquet(f"{self.root}/manifest/version={version or done[-1]}"))

    @staticmethod
    def _file():
        return F.regexp_extract(F.input_file_name(), "(version=[0-9]+/[^/]+)$", 1).alias("file")

    @staticmethod
    def _names(manifest: DataFrame) -> list:
        return sorted(r.file for r in manifest.select("file").distinct().collect())      # names of files, as any listing gives

    def _table(self, names: list) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/data/{n}" for n in names])

    def similar(self, probes: DataFrame, k: int, size: int, stages: Stages, part_category=None, material=None) -> DataFrame:
        """The k nearest stored parts of each probe in its block: (part_id, neighbor_id, dist, rank), exact, ordered by
        (dist, neighbor_id), without the probe itself. ``probes`` has the columns of the index; its parts need not be
        in it. With ``part_category`` or ``material`` only probes of these blocks are searched. Probes in a block that holds
        nothing else give no rows."""
        self.read_files = []
        chosen = [(c, v) for c, v in zip(N.BLOCK, (part_category, material)) if v is not None]
        narrow = lambda df: reduce(lambda d, cv: d.where(F.col(cv[0]) == cv[1]), chosen, df)     # noqa: E731
        bands = self._bands(self._bands_version())
        files = stages.save(narrow(self.manifest()), "files")
        probes = stages.save(narrow(probes.select("part_id", *N.BLOCK, "feature_vector")), "probes")

        def places(df, *more):
            """One row per occupied cell of the probes with the box they cover."""
            boxes = [f for c in PLACES for f in (F.min(c).alias(f"from{c}"), F.max(c).alias(f"to{c}"))]
            celled = N._banded(N.home_cells(df, bands, UNIT), bands, N.MAX_BANDS)
            return celled.groupBy(*N.BLOCK, *KEYS).agg(*boxes, *more)

        # The files nearest to each place that hold k parts besides a probe; of several around it the most compact.
        extent = reduce(lambda a, b: a + b, [F.coalesce((F.col(f"high{c}") - F.col(f"low{c}")) ** 2, F.lit(0.0)) for c in PLACES])
        gap = reduce(lambda a, b: a + b, [g * g for g in [F.coalesce(F.greatest(F.col(f"low{c}") - F.col(f"to{c}"), F.col(f"from{c}") - F.col(f"high{c}"), F.lit(0.0)), F.lit(0.0)) for c in PLACES]])
        nearest_first = W.partitionBy(*N.BLOCK, *KEYS).orderBy("gap", "extent", "file").rowsBetween(W.unboundedPreceding, -1)
        first = self._names(places(probes).join(files, N.BLOCK)
                            .withColumn("gap", gap).withColumn("extent", extent)
                            .withColumn("before", F.coalesce(F.sum("rows").over(nearest_first), F.lit(0))).where(F.col("before") <= k))
        self.read_files = first
        near = stages.save(N.nearest(probes, narrow(self._table(first)), k, size, stages), "near") if first else None
        if near is None:
            return self.spark.createDataFrame([], "part_id string, neighbor_id string, dist double, rank int")

        # What else the balls of the distances found touch; a probe with fewer than k looks at its whole block.
        known = near.groupBy("part_id").agg(F.when(F.count(F.lit(1)) == k, F.max("dist")).alias("reach"))
        bounded = stages.save(probes.join(known, "part_id", "left"), "bounded")
        wide = stages.save(places(bounded, F.max("reach").alias("reach"), F.max(F.col("reach").isNull()).alias("whole")), "places")
        reach = F.col("reach") * (1 + SLACK) + SLACK
        met = stages.save(wide.join(files, N.BLOCK).where(F.col("whole") | (gap <= reach * reach))
                          .select(*N.BLOCK, *KEYS, "file", F.col("file").isin(first).alias("read")), "met")
        open_places = met.where("NOT read").select(*N.BLOCK, *KEYS).distinct()
        again = N.home_cells(probes, bands, UNIT).join(open_places, [*N.BLOCK, *KEYS], "left_semi").select(*probes.columns)
        second = self._names(met.join(open_places, [*N.BLOCK, *KEYS], "left_semi"))
        if not second:
            return near
        again = stages.save(again, "again")
        self.read_files = sorted({*first, *second})
        later = N.nearest(again, narrow(self._table(second)), k, size, stages)
        return near.join(again.select("part_id"), "part_id", "left_anti").unionByName(later)
