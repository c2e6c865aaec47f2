"""Reading and writing tables, with the storage format as a parameter."""

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from itemweld.schema import FOREIGN_KEYS, PRIMARY_KEYS, TABLES, conform
from itemweld.streaming.kept_state import Folder


def read_table(spark: SparkSession, location=None, *, format="parquet", columns=None,
               schema=None, **options) -> DataFrame:
    """Scan a table; ``columns`` is the pick that reaches the reader.

    ``format="jdbc"`` with url/dbtable/user/password options reads a relational
    table (give partitionColumn/lowerBound/upperBound/numPartitions for a large
    one, or it arrives in one task).
    """
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(location) if location is not None else reader.load()
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, location=None, *, table=None, format="parquet",
                mode="overwrite", partition_by=(), **options) -> None:
    """Overwrite a table. With ``table`` the frame is first cast, by column
    name, to that declared schema; without it the schema is replaced."""
    if table is not None:
        df = conform(df, table)
    writer = df.write.format(format).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(location) if location is not None else writer.save()


class BrokenConstraint(ValueError):
    """Rows that break what the schema declares; the stored table is as it was."""


def broken(stored: DataFrame, nulls: dict, table: str, parents: dict, unique=True) -> list:
    """What ``stored`` breaks of the table's declarations, as sentences. ``nulls`` are null rows per column."""
    found = [f"{table}.{c}: {n} null rows" for c, n in nulls.items() if n]
    keys = PRIMARY_KEYS.get(table) if unique else None
    if keys:
        n = stored.groupBy(*keys).count().where("count > 1").count()
        found += [f"{table}({', '.join(keys)}): {n} repeated keys"] if n else []
    for child, column, parent, key in FOREIGN_KEYS:
        if child == table and parent in parents:
            orphans = stored.where(F.col(column).isNotNull()).join(
                parents[parent].select(F.col(key).alias(column)), column, "left_anti").count()
            found += [f"{table}.{column}: {orphans} rows without their row in {parent}"] if orphans else []
    return found


def write_checked(df: DataFrame, location: str, table: str, *, parents=None, unique=True, format="parquet", **options) -> None:
    """Replace a declared table only by rows that keep its declarations.

    The rows go to a folder beside it; nulls in columns that allow none are counted in that same pass, repeated keys and
    rows without their row in one of ``parents`` (name -> table) over the key columns of what was written. If
    anything is broken the new folder goes, the old table stays, and `BrokenConstraint` says what. Else the folders
    change places by renaming; a run that ended between the two renames is put right by the next. ``df`` may
    read the table it replaces. ``unique=False`` lets repeated keys through.
    """
    spark, name = df.sparkSession, location.rstrip("/").rsplit("/", 1)[1]
    folder = Folder(spark, location.rstrip("/").rsplit("/", 1)[0])
    new, old = f"_{name}-new-{uuid.uuid4().hex[:8]}", f"_{name}-old"
    if folder.exists(old) and not folder.exists(name):
        folder.rename(old, name)
    rows, strict = conform(df, table), [f.name for f in TABLES[table].fields if not f.nullable]
    seen = Observation()
    if strict:
        rows = rows.observe(seen, *[F.count_if(F.col(c).isNull()).alias(c) for c in strict])
    rows.write.format(format).mode("overwrite").options(**options).save(f"{folder.root}/{new}")
    stored = spark.read.format(format).schema(rows.schema).load(f"{folder.root}/{new}")
    found = broken(stored, seen.get if strict else {}, table, parents or {}, unique)
    if found:
        folder.drop(new)
        raise BrokenConstraint("; ".join(found))
    folder.drop(old)
    if folder.exists(name):
        folder.rename(name, old)
    folder.rename(new, name)
    folder.drop(old)


def write_bucketed(df: DataFrame, name: str, keys, buckets: int, *, format="parquet") -> None:
    """Overwrite a catalogue table bucketed and sorted on ``keys``, so that later
    joins and roll-ups on them read co-located rows without a shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    (df.write.format(format).mode("overwrite")
       .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
