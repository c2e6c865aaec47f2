"""Packing along a space-filling curve.

Each document is tokenised once and its hashed token vector projected to four
dimensions; the documents are range-sorted by the Hilbert key of that point, so
that neighbours on the curve are alike, and each range is cut into sequences.
"""

import functools

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from itemweld.llm.common import U64, binary_runs, mix, starts_of, text_blocks
from itemweld.sources.staging import Stages

SEQUENCE = 2048
END = 1            # id that closes every document
DIMENSIONS, BITS = 4, 12
TOGETHER = 2000    # pieces handed on at once
VOCABULARY_FILE, RANKS_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str):
    """text -> uint32 ids, as the vocabulary file's own library gives them without
    added special tokens. Texts that spell out a special token go through that library;
    the rest through the same vocabulary as ranks, three times as fast."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text):
        if any(s in text for s in special):
            return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of points with integer coordinates of ``bits``
    bits (Skilling, 2004): Gray-code untangling from the top bit down."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@functools.lru_cache(maxsize=1)
def directions(size: int) -> np.ndarray:
    """One fixed random direction in the small space per token id."""
    k = np.arange(size * DIMENSIONS, dtype=U64) + U64(0x9E3779B97F4A7C15)
    unit = (mix(k) >> U64(11)).astype(np.float64) / 2.0**53
    return ((unit - 0.5) * np.sqrt(12)).astype(np.float32).reshape(size, DIMENSIONS)


def curve_keys(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as runs of ids (no run is empty)."""
    points = np.add.reduceat(directions(1 << 16)[ids], bounds[:-1], axis=0)
    points /= np.sqrt(np.diff(bounds))[:, None]
    unit = 1 / (1 + np.exp(-np.clip(points, -30, 30)))   # squashed: even long tails keep a cell
    cells = np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert(cells, BITS)


def tokenised(docs: DataFrame, doc_id: str, text: str, vocabulary: str, ranks: str) -> DataFrame:
    """(doc_id, curve long, n int, ids binary of uint16, or uint32 if wider)."""

    def run(batches):
        encode = encoder(vocabulary, ranks)
        end = np.array([END], np.uint32)
        for block in text_blocks(batches):
            seen, parts = {}, []
            for t in block.column(1).to_pylist():
                t = t or ""
                if t not in seen:
                    seen[t] = np.concatenate([encode(t), end])
                parts.append(seen[t])
            bounds, flat = starts_of([len(p) for p in parts]), np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(curve_keys(flat, bounds)), pa.array(np.diff(bounds).astype(np.int32)),
                 binary_runs(flat.astype(np.uint16), bounds)], names=["doc_id", "curve", "n", "ids"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
                .mapInArrow(run, "doc_id long, curve long, n int, ids binary"))


def pieces(batches, sequence=SEQUENCE):
    """Lays the documents of one range end to end and cuts every ``sequence`` ids.
    What is left at the end is dealt to sequences of falling powers of two, which
    need no padding."""
    base, number, filled, tail, ready = TaskContext.get().partitionId() << 33, 0, 0, [], []

    def emit(rows):
        ids = [r[3] for r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([len(i) for i in ids], pa.int64()),
             binary_runs(np.concatenate(ids).astype("<u4"), starts_of([len(i) for i in ids])),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([base + r[4] for r in rows], pa.int64()),
             pa.array([r[5] for r in rows], pa.int64())],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, start = np.frombuffer(raw, np.uint16), 0
            while start < len(ids):
                part = ids[start:start + sequence - filled]
                tail.append((doc, start, len(ids), part, number, filled))
                start, filled = start + len(part), filled + len(part)
                if filled == sequence:
                    number, filled = number + 1, 0
                    ready += tail
                    tail = []
                    if len(ready) >= TOGETHER:
                        yield emit(ready)
                        ready = []
    rest, size = [], sequence
    room, filled = 0, 0
    left = sum(len(r[3]) for r in tail)
    for doc, start, total, part, _, _ in tail:
        while len(part):
            if not room:
                while size > left:
                    size //= 2
                room, filled, number = size, 0, number + bool(rest)
                left -= size
            cut = part[:room]
            rest.append((doc, start, total, cut, number, filled))
            start, part, room, filled = start + len(cut), part[len(cut):], room - len(cut), filled + len(cut)
    if ready or rest:
        yield emit(ready + rest)


def pack(docs: DataFrame, *, doc_id="doc_id", text="text", vocabulary=None, ranks=None,
         range_bytes=8 << 20, stages=None) -> DataFrame:
    """(doc_id, start, length, ids binary of little-endian uint32, doc_tokens,
    sequence_id, offset): every id of every document in exactly one piece.

    A document is its ids and the closing id; a null or empty text is that id alone. A
    null doc_id stays null; repeated rows are packed each. An empty table gives no
    rows. Rows are sorted by (curve key, doc_id, ids), so a group of copies with one key is
    split over ranges, and the number of ranges follows the stored bytes.
    """
    spark = docs.sparkSession
    stages = stages or Stages(spark, "packing")
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY_FILE)
    ranks = ranks or public_tokenizers.path(RANKS_FILE)
    made = tokenised(docs, doc_id, text, vocabulary, ranks)
    stored = stages.save(made, "tokens", compression="zstd")
    total = stored.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(2 * total // range_bytes))
    ordered = (stored.withColumn("tie", F.xxhash64("ids"))
               .repartitionByRange(ranges, "curve", "doc_id", "tie")
               .sortWithinPartitions("curve", "doc_id", "tie").select("doc_id", "ids"))
    return ordered.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, "
                                      "sequence_id long, offset long")
