"""Hard negatives by vertical scans of column blocks (branch and bound on decomposed vectors).

Rows lie in blocks of one label, each stored dimension by dimension with the least and largest value of every
dimension. An anchor reads the dimensions in descending order of its own magnitudes; what the unread ones can still
add lies between the sums of their least and largest contributions, so a bitmap of candidates
shrinks until the scores of those left are exact. Two scans: the best rows of the anchor's
label, then, for the score windows these give, the best rows of other labels inside each.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from itemweld.sources.staging import Stages

SCALE, EVERY = 256, 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95          # a negative's score in percent of the positive's
BLOCK = 16384               # rows of a block, about
ANCHORS = 1024              # anchors that meet a block in one task
STEP = 8                    # dimensions read between two looks at the bitmap
EXACT = float(1 << 53)      # sums of products below it are exact in doubles


def whole(values, scale):
    """floor(scale * x) as doubles, or None where the vector takes no part."""
    if values is None or not len(values):
        return None
    a = np.floor(np.array(values, np.float64) * scale)       # None becomes nan
    return a if np.isfinite(a).all() else None


def components(vectors: DataFrame, vec_id, embedding, label, scale) -> DataFrame:
    """(vec_id, label, dim, x binary of doubles) of the rows that take part."""

    def run(parts):
        for frame in parts:
            x = [whole(v, scale) for v in frame["v"]]
            ok = [v is not None for v in x]
            x = [v for v in x if v is not None]
            yield pd.DataFrame({"vec_id": frame["vec_id"][ok].to_numpy(np.int64), "label": frame["label"][ok].to_numpy(np.int64),
                                "dim": np.array([len(v) for v in x], np.int32), "x": [v.astype("<f8").tobytes() for v in x]})

    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                            F.col(embedding).alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return source.mapInPandas(run, "vec_id long, label long, dim int, x binary")


def matrix(raws, dim) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<f8").reshape(-1, dim)


def integers(a: np.ndarray) -> np.ndarray:
    """The same whole numbers without a bound on their products."""
    out = np.empty(a.shape, object)
    out[...] = [[int(x) for x in row] for row in a] if a.ndim == 2 else [int(x) for x in a]
    return out


class Columns:
    """A block dimension by dimension, rows in ascending order of their ids."""

    def __init__(self, ids, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = np.asarray(ids)[order]
        self.columns = np.ascontiguousarray(x[order].T)
        self.least, self.most = self.columns.min(1), self.columns.max(1)
        self.size = float(np.abs(self.columns).max())
        self.read = 0           # values read, for the tests

    def scan(self, q: np.ndarray, own: int, windows, want: int) -> list:
        """For each window (low, high) the ``want`` best (score, vec_id) with low <= score <= high, without
        rows of the id ``own``. Either end may be None."""
        columns, least, most = self.columns, self.least, self.most
        if float(np.abs(q).max()) * self.size * len(q) >= EXACT:
            columns, least, most, q = integers(columns), integers(least), integers(most), integers(q)
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q[order] * least[order], q[order] * most[order]])
        rest_low = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0)       # what the unread dimensions add at least
        rest_high = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0)
        lows = [w[0] for w in windows]
        floor = None if None in lows else min(lows)
        highs = [w[1] for w in windows]
        ceiling = None if None in highs else max(highs)
        alive = np.flatnonzero(self.ids != own)
        score = np.zeros(len(alive), columns.dtype)
        every = len(alive) == len(self.ids)
        for at in range(0, len(order), STEP):
            read = order[at:at + STEP]
            part = columns[read] if every else columns[np.ix_(read, alive)]
            score = score + q[read] @ part
            self.read += part.size
            to = at + len(read)
            bitmap = np.ones(len(alive), bool)
            if floor is not None:
                bitmap &= score + rest_high[to] >= floor
            if ceiling is not None:
                bitmap &= score + rest_low[to] <= ceiling
            if len(windows) == 1 and ceiling is None and len(alive) > want:
                # The want-th best of the scores surely reached: who can't pass it leaves.
                sure = np.partition(score, len(score) - want)[len(score) - want] + rest_low[to]
                bitmap &= score + rest_high[to] >= sure
            if not bitmap.all():
                alive, score, every = alive[bitmap], score[bitmap], False
            if not len(alive):
                break
        found = []
        for low, high in windows:
            inside = np.ones(len(alive), bool)
            if low is not None:
                inside &= score >= low
            if high is not None:
                inside &= score <= high
            s, at = score[inside], alive[inside]
            best = np.argsort(-s, kind="stable")[:want]        # stable: ties stay in the order of ids
            found.append([(int(s[i]), int(self.ids[at[i]])) for i in best])
        return found


def long_or_raise(score: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"the score {score} of two rows is no 64-bit integer")
    return score


def window(positive: int):
    """The scores allowed for the negatives of a positive score, both ends included."""
    return -((-LOW * positive) // 100), (HIGH * positive) // 100


def hard_negatives(vectors: DataFrame, *, vec_id="vec_id", embedding="embedding", label="label", every=EVERY, scale=SCALE,
                   positives=POSITIVES, negatives=NEGATIVES, stages=None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by ``every``
    and each of its ``positives`` best rows of the same label the ``negatives`` best rows of other labels whose score
    lies between LOW and HIGH percent of the positive's. Scores are integer inner products of floor(scale * x), higher
    ones first, ties by smaller id.

    Rows with a null id or label, an empty or null vector or a null or non-finite component take no part. Vectors of different
    lengths aren't compared. Repeated rows each count as candidates; rows that share the anchor's id count as its own, and of several
    anchors of one id that of the smallest label asks, then that of the smallest stored components. A returned score that is no long raises.
    An empty table gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    stages = stages or Stages(spark, "hardneg")
    rows = stages.save(components(vectors, vec_id, embedding, label, scale), "rows")
    sizes = rows.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slots"))
    sizes = stages.save(sizes, "sizes")
    slot = F.pmod(F.xxhash64("vec_id", "x", F.rand(5)), F.col("slots"))
    dealt = stages.save(rows.join(sizes, ["label", "dim"]).withColumn("slot", slot)
                        .select("label", "dim", "slot", "vec_id", "x"), "dealt")

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        return pd.DataFrame({"label": [head["label"]], "dim": [head["dim"]], "slot": [head["slot"]],
                             "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "rows": [b"".join(frame["x"])]})

    blocks = stages.save(dealt.groupBy("label", "dim", "slot").applyInPandas(
        gather, "label long, dim int, slot long, ids binary, rows binary"), "blocks")

    asking = (rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "x")).alias("r"))
              .select("vec_id", "r.*"))
    asking = stages.save(asking.withColumn("windows", F.lit(None).cast("array<long>")), "asking")

    def scanned(anchors: DataFrame, keys, same: bool, want: int, name: str) -> DataFrame:
        """(anchor_id, window, vec_id, score): every block is met by the anchors that agree in ``keys``, of its own label or
        of others, ANCHORS at a time in a task of their own."""
        chunks = stages.save(anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("chunks")), "chunks")
        asked = (anchors.join(chunks, keys).withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("chunks")))
                 .select(*keys, "chunk", F.col("label").alias("own"), "vec_id", "x", "windows"))
        pairs = stages.save(blocks.select("label", "dim", "slot").join(chunks, keys).select(
            "label", "dim", "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk")), "pairs")
        by = ["label", "dim", "slot", "chunk"]
        met = pairs.join(asked, [*keys, "chunk"]).where("label = own" if same else "label <> own")

        def run(block, questions):
            out = []
            if len(block) and len(questions):
                head = block.iloc[0]
                held = Columns(np.frombuffer(head["ids"], "<i8"), matrix([head["rows"]], head["dim"]))
                for own, x, positive in zip(questions["vec_id"], questions["x"], questions["windows"]):
                    windows = [(None, None)] if same else [window(int(p)) for p in positive]
                    for n, found in enumerate(held.scan(np.frombuffer(x, "<f8"), own, windows, want)):
                        out += [(own, n, v, long_or_raise(s)) for s, v in found]
            return pd.DataFrame(out, columns=["anchor_id", "window", "vec_id", "score"]).astype("int64")

        left = blocks.join(pairs, ["label", "dim", "slot"]).select(*by, "ids", "rows").groupBy(*by)
        right = stages.save(met.select(*by, "vec_id", "x", "windows"), "met").groupBy(*by)
        return stages.save(left.cogroup(right).applyInPandas(run, "anchor_id long, window long, vec_id long, score long"), name)

    found = scanned(asking, ["label", "dim"], True, positives, "same")

    def best(frame, keys, want):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        return frame.withColumn("rank", rank).where(F.col("rank") <= want)

    held = stages.save(best(found, ["anchor_id"], positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window")), "positives")
    listed = (held.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("w"))
              .select(F.col("anchor_id").alias("vec_id"), F.col("w.positive_score").alias("windows")))
    found = scanned(stages.save(asking.drop("windows").join(listed, "vec_id"), "windows"), ["dim"], False, negatives, "others")
    return (best(found, ["anchor_id", "window"], negatives).join(held, ["anchor_id", "window"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
