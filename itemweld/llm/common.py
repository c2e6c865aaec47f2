"""What the operators share: tables, hashed words, mixing of 64-bit keys."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

U64 = np.uint64
WORDS_KEPT = 400_000   # entries of a task's word cache before it starts anew; results don't depend on it


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered within a task."""

    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def ascii_words(text: bytes) -> list:
    """Words between ASCII white space, A-Z in lower case: bytes.lower and
    bytes.split touch exactly A-Z and x20, x09-x0D."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def starts_of(lengths) -> np.ndarray:
    """Offsets of consecutive runs: n lengths give n + 1 bounds."""
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return bounds


def binary_runs(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose i-th value is the bytes of flat[bounds[i]:bounds[i+1]]."""
    raw = np.ascontiguousarray(flat)
    offsets = bounds.astype(np.int64) * raw.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())


def rows_of(batch):
    """The rows of a batch one by one."""
    for i in range(batch.num_rows):
        yield {name: c[i].as_py() for name, c in zip(batch.schema.names, batch.columns)}


def text_blocks(batches, weight="text", limit=8_000_000):
    """Cuts Arrow batches into runs of rows of about ``limit`` bytes of text, so
    that a task's working arrays stay bounded however long the texts are."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(weight))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, per_class: int, *, key="doc_id",
                    columns=("text",), max_chars=200_000) -> DataFrame:
    """(key, label 0/1, columns...) of at most ``per_class`` rows of either class.

    The rows of lowest key hash are taken, so the sample doesn't depend on the partitioning;
    of repeated label rows the largest value counts; rows with a null key, another
    label, or a text of over ``max_chars`` characters don't teach.
    """
    flat = (labels.select(F.col(key).alias("k"), F.col(value).cast("int").alias("y"))
            .where("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.max("y").alias("label")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("k"), "k"))
    picked = flat.withColumn("r", rank).where(F.col("r") <= per_class).select("k", "label")
    rows = docs.select(F.col(key).alias("k"), *columns)
    if "text" in columns:
        rows = rows.where(F.length("text") <= max_chars)
    return (rows.join(F.broadcast(picked), "k").withColumn("h", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(*columns))))
            .where("h = 1").drop("h"))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
