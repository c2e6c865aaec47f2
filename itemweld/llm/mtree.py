"""Exact top-k by integer inner product with M-trees.

Vectors are turned into whole numbers, held in doubles, and measured in a unit in which no vector of a length is longer
than 1. One more coordinate makes all lengths 1: the largest inner product is then the smallest Euclidean distance.
Rows belong to the nearest of a fixed number of pivots; each pivot's rows are dealt into blocks of
bounded size and every block is stored as the pages of an M-tree. A query looks first into one block, which
bounds its k-th score, and then only into the blocks whose pivot allows a better one. The queries that meet a block
go through its pages together. Distances only choose pages and entries, with room for their rounding; scores are
computed from the whole numbers themselves, in doubles, longs or unbounded integers, whichever holds them.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from itemweld.sources.staging import Stages

SCALE, TOP, EVERY = 256, 5, 50
PIVOTS = 64              # rows drawn by lowest hash, so their table has a fixed size
BLOCK, PAGE = 4096, 64   # rows of a block, about; entries of a page
QUERIES_AT_ONCE = 8192   # queries that meet a block in one task
SMALL = 2.0 ** -64       # factor that keeps lengths of the largest doubles finite
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1

PAGE_SCHEMA = ("block string, page int, parent int, leaf boolean, ids binary, vectors binary, "
               "radius double, center binary, parent_distance double, entry_distance binary")


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int, k: int) -> DataFrame:
    """(vec_id, dim, x binary of doubles, norm double) of the vectors that take part, equal rows at most k times:
    no more of them can be among k."""

    def run(parts):
        for frame in parts:
            keep, dims, raws, norms = [], [], [], []
            for v in frame["v"]:
                ok = v is not None and len(v) > 0
                if ok:
                    a = np.floor(np.array(v, np.float64) * scale)      # None becomes nan
                    ok = bool(np.isfinite(a).all())
                keep.append(ok)
                if ok:
                    size = np.abs(a).max() or 1.0
                    dims.append(len(a))
                    raws.append((a + 0.0).astype("<f8").tobytes())
                    norms.append(float(size * SMALL * np.sqrt(((a / size) ** 2).sum())))
            yield pd.DataFrame({"vec_id": frame["vec_id"][keep].to_numpy(), "dim": np.array(dims, np.int32), "x": raws,
                                "norm": np.array(norms, float)})

    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where("vec_id IS NOT NULL")
    counted = (source.mapInPandas(run, "vec_id long, dim int, x binary, norm double")
               .groupBy("vec_id", "x").agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.count(F.lit(1)).alias("n")))
    return (counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
            .select("vec_id", "dim", "x", "norm"))


def rows_of(raws, dim) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<f8").reshape(-1, dim)


def measured(x: np.ndarray, unit: float) -> np.ndarray:
    """The points in the unit of their length, which is the largest norm: none is longer than 1."""
    return x * SMALL / (unit or 1.0)


def lifted(x: np.ndarray, unit: float) -> np.ndarray:
    """The measured points with the coordinate that brings every length to 1."""
    a = measured(x, unit)
    return np.concatenate([a, np.sqrt(np.maximum(1 - (a * a).sum(1), 0))[:, None]], 1)


def distances(points, center):
    return np.sqrt(((points - center) ** 2).sum(1))


def between(points, centers):
    """Distances of all points to all centres by one matrix product."""
    d2 = (points ** 2).sum(1)[:, None] - 2 * points @ centers.T + (centers ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0))


def room(q2, dim):
    """How far rounding may put a distance off: the root of what sums of dim products can lose."""
    return np.sqrt((dim + 8) * 2.0 ** -49) * np.sqrt(q2 + 1)


def reach(q2, score, dim):
    """The distance beyond which no row can hold a score (in units); ``q2`` are squared lengths of queries."""
    return np.sqrt(np.maximum(q2 + 1 - 2 * score, 0)) + room(q2, dim)


def clustered(points: np.ndarray, size: int, rng) -> list:
    """Index groups of at most ``size`` near points: seeds drawn, nearest seed joined, large groups split again."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        group = todo.pop()
        if len(group) <= size:
            done.append(group)
            continue
        seeds = points[rng.choice(group, min(-(-2 * len(group) // size), size), replace=False)]
        own = points[group]
        d = (own ** 2).sum(1)[:, None] - 2 * own @ seeds.T + (seeds ** 2).sum(1)
        near = d.argmin(1)
        parts = [group[near == i] for i in range(len(seeds))]
        if max(map(len, parts)) == len(group):          # copies: cut by position
            parts = [group[i:i + size] for i in range(0, len(group), size)]
        todo += [p for p in parts if len(p)]
    return done


def build(block: str, ids, x: np.ndarray, unit: float) -> pd.DataFrame:
    """The pages of one block's M-tree. Page 0 is the root. A page knows its centre, its
    covering radius, its parent and its distance to the parent's centre; a leaf's entries their
    distances to the leaf's centre."""
    points, rng = lifted(x, unit), np.random.default_rng(len(ids))
    pages = []

    def page(leaf, members, center):
        pages.append({"leaf": leaf, "center": center, "members": members, "parent": -1, "pd": 0.0, "under": None})
        return len(pages) - 1

    page(False, [], points.mean(0))
    level = []
    for group in clustered(points, PAGE, rng):
        n = page(True, group, points[group].mean(0))
        pages[n]["under"] = group
        level.append(n)
    while len(level) > PAGE:
        centers, above = np.stack([pages[n]["center"] for n in level]), []
        for group in clustered(centers, PAGE, rng):
            n = page(False, [], centers[group].mean(0))
            for i in group:
                pages[level[i]]["parent"] = n
            pages[n]["under"] = np.concatenate([pages[level[i]]["under"] for i in group])
            above.append(n)
        level = above
    for n in level:
        pages[n]["parent"] = 0
    pages[0]["under"] = np.arange(len(ids))
    out = []
    for n, p in enumerate(pages):
        m = p["members"] if p["leaf"] else np.zeros(0, int)
        far = distances(points[p["under"]], p["center"])
        if p["parent"] >= 0:
            p["pd"] = float(np.linalg.norm(p["center"] - pages[p["parent"]]["center"]))
        out.append((block, n, p["parent"], p["leaf"], ids[m].astype("<i8").tobytes(), x[m].astype("<f8").tobytes(),
                    float(far.max()) if len(far) else 0.0, p["center"].tobytes(), p["pd"],
                    distances(points[m], p["center"]).tobytes() if p["leaf"] else b""))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])


class Tree:
    """A block's pages in memory, for the best-first search of many queries at once."""

    def __init__(self, frame: pd.DataFrame, dim: int, unit: float):
        rows = frame.sort_values("page").to_dict("records")
        self.dim, self.unit = dim, unit
        self.leaf = [r["leaf"] for r in rows]
        self.center = np.stack([np.frombuffer(r["center"]) for r in rows])
        self.radius = np.array([r["radius"] for r in rows])
        self.children = [[] for _ in rows]
        for r in rows:
            if r["parent"] >= 0:
                self.children[r["parent"]].append(r["page"])
        self.children = [np.array(c, int) for c in self.children]
        self.pd = np.array([r["parent_distance"] for r in rows])
        self.ids = [np.frombuffer(r["ids"], "<i8") for r in rows]
        self.x = [np.frombuffer(r["vectors"], "<f8").reshape(-1, dim) for r in rows]
        self.ed = [np.frombuffer(r["entry_distance"]) for r in rows]
        self.top = max((float(np.abs(v).max()) for v in self.x if v.size), default=0.0)
        self._typed = {float: self.x}
        self.computed = 0       # distances and products that the stored bounds didn't save, for the tests

    def vectors(self, kind) -> list:
        """The pages' vectors as doubles, longs or unbounded integers."""
        if kind not in self._typed:
            self._typed[kind] = [typed(v, kind) for v in self.x]
        return self._typed[kind]

    def search(self, own: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray) -> list:
        """For each query the k best (score, vec_id) of the block, best first, without rows of its own id; ``floors``
        are scores known to be reached k times elsewhere, or nan."""
        with np.errstate(over="ignore"):
            size = np.abs(q).max(1) * self.top * self.dim
        kinds = np.where(size < 2.0 ** 53, 0, np.where(size < 2.0 ** 62, 1, 2))
        out = [None] * len(q)
        for n, kind in enumerate((float, np.int64, object)):
            rows = np.flatnonzero(kinds == n)
            if len(rows):
                for row, found in zip(rows, self._together(own[rows], q[rows], k, floors[rows], kind)):
                    out[row] = found
        return out

    def _leaves(self, points, q2, limit):
        """(pages, their least possible distances, distances of their centres) for all queries, inf where a bound
        excludes the page."""
        m = len(points)
        todo, pages, lows, dists = [(0, between(points, self.center[:1])[:, 0], np.ones(m, bool))], [], [], []
        while todo:
            page, d, open_ = todo.pop()
            kids = self.children[page]
            if not len(kids):
                continue
            # the stored distance to the parent's centre saves the distance to the page's own
            passed = open_[:, None] & (np.abs(d[:, None] - self.pd[kids]) - self.radius[kids] <= limit[:, None])
            kids, passed = kids[passed.any(0)], passed[:, passed.any(0)]
            if not len(kids):
                continue
            self.computed += int(passed.sum())
            far = between(points, self.center[kids])
            low = np.where(passed, np.maximum(far - self.radius[kids], 0), np.inf)
            for i, kid in enumerate(kids.tolist()):
                if self.leaf[kid]:
                    pages.append(kid)
                    lows.append(low[:, i])
                    dists.append(far[:, i])
                else:
                    todo.append((kid, far[:, i], low[:, i] <= limit))
        return pages, lows, dists

    def _together(self, own, q, k, floors, kind):
        scaled = measured(q, self.unit)
        points, q2 = np.concatenate([scaled, np.zeros((len(q), 1))], 1), (scaled ** 2).sum(1)
        factor = SMALL / (self.unit or 1.0)
        limit = np.where(np.isnan(floors), np.inf, reach(q2, np.nan_to_num(floors) * factor * factor, self.dim))
        typed_q, vectors = typed(q, kind), self.vectors(kind)
        best = [[] for _ in range(len(q))]
        kth = np.full(len(q), None, object) if kind is object else np.full(len(q), least(kind), kind)
        pages, lows, dists = self._leaves(points, q2, limit)
        if not pages:
            return best
        low, dist = np.stack(lows, 1), np.stack(dists, 1)
        place = np.empty(low.shape, int)             # how early a query wants the page
        np.put_along_axis(place, np.argsort(low, 1, kind="stable"), np.arange(low.shape[1])[None, :], 1)
        first, count = 0, 1
        while first < len(pages):                    # nearest page first, then in bunches that double
            wanted = (place >= first) & (place < first + count) & (low <= limit[:, None])
            for i in np.flatnonzero(wanted.any(0)).tolist():
                rows = np.flatnonzero(wanted[:, i] & (low[:, i] <= limit))
                if len(rows):
                    self._read(pages[i], rows, dist[rows, i], own, typed_q, vectors, scaled, q2, limit, kth, best, k, kind)
            first, count = first + count, 2 * count
        return [[(-s, v) for s, v in b] for b in best]

    def _read(self, page, rows, d, own, typed_q, vectors, scaled, q2, limit, kth, best, k, kind):
        """Score a leaf's entries for the queries ``rows`` and keep their k best."""
        ids = self.ids[page]
        near = np.abs(d[:, None] - self.ed[page]) <= limit[rows][:, None]      # the stored distance saves the product
        near &= ids[None, :] != own[rows][:, None]
        self.computed += int(near.sum())
        used = near.any(0)
        if not used.any():
            return
        near, ids = near[:, used], ids[used]
        scores = typed_q[rows] @ vectors[page][used].T
        short = np.array([len(best[r]) < k for r in rows])
        better = near & ((scores >= kth[rows][:, None]) | short[:, None]) if kind is not object else near
        for j in np.flatnonzero(better.any(1)).tolist():
            r, hit = rows[j], np.flatnonzero(better[j])
            merged = sorted(best[r] + [(-int(s), v) for s, v in zip(scores[j, hit].tolist(), ids[hit].tolist())])[:k]
            best[r] = merged
            if len(merged) == k:      # entries of the same score and a smaller id still count, so equal distances stay open
                kth[r] = -merged[-1][0]
                last = float(scaled_score(kth[r], self.unit))
                limit[r] = min(limit[r], reach(q2[r], last, self.dim))


def least(kind):
    return -np.inf if kind is float else np.iinfo(np.int64).min


def typed(a: np.ndarray, kind) -> np.ndarray:
    """Whole numbers held in doubles as ``kind``; object means integers without a bound."""
    if kind is not object:
        return a.astype(kind)
    return np.array([int(v) for v in a.ravel()], object).reshape(a.shape)


def scaled_score(score: int, unit: float) -> float:
    """A score in squared units; integers of any size, so that nothing overflows on the way."""
    shift = max(abs(score).bit_length() - 60, 0) if isinstance(score, int) else 0
    factor = SMALL / (unit or 1.0)
    mantissa = float(score >> shift if shift else score)
    return mantissa * np.ldexp(factor, shift // 2) * np.ldexp(factor, shift - shift // 2)


def top_k(vectors: DataFrame, *, vec_id="vec_id", embedding="embedding", every=EVERY, k=TOP, scale=SCALE,
          stages=None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k
    rows of largest integer inner product of floor(scale * x), ties to the smaller vec_id.

    Vectors that are null, empty, or hold null or non-finite components (after scaling) take no part, nor do null ids.
    Components may have any size; the job fails if a score to be returned doesn't fit a long. Vectors of
    different lengths aren't compared. Rows that repeat an id or a vector each count as a candidate; rows that share a
    query's id count as its own, and of several queries of one id the one of lowest hash asks. With fewer
    than k candidates all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    stages = stages or Stages(spark, "mtree")
    points = stages.save(integers(vectors, vec_id, embedding, scale, k), "points")
    units = {r.dim: r.m for r in points.groupBy("dim").agg(F.max("norm").alias("m")).collect()}    # a row per vector length
    drawn = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = {d: lifted(rows_of([r.x for r in drawn if r.dim == d], d), units[d]) for d in {r.dim for r in drawn}}

    def place(parts):
        for frame in parts:
            frame = frame.reset_index(drop=True)
            region, gap = np.zeros(len(frame), np.int32), np.zeros(len(frame))
            for dim, rows in frame.groupby("dim"):
                if dim in pivots:
                    d = between(lifted(rows_of(rows["x"], dim), units[dim]), pivots[dim])
                    region[rows.index] = d.argmin(1)
                    gap[rows.index] = d.min(1)
            yield frame.assign(region=region, gap=gap)

    placed = stages.save(points.mapInPandas(place, "vec_id long, dim int, x binary, norm double, region int, gap double"), "placed")
    sizes = stages.save(placed.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
                        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "regions")
    name = F.concat_ws("/", "dim", "region", "slot")
    dealt = (placed.join(sizes, ["dim", "region"]).withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
             .select(name.alias("block"), "dim", "vec_id", "x"))

    def plant(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        return build(frame["block"].iloc[0], frame["vec_id"].to_numpy(), rows_of(frame["x"], dim), units[dim])

    pages = stages.save(dealt.groupBy("block").applyInPandas(plant, PAGE_SCHEMA), "pages")

    one = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.xxhash64("x"), "x"))
    asking = (placed.where(F.col("vec_id") % every == 0).withColumn("r", one).where("r = 1")
              .select("vec_id", "dim", "x", "region", "gap"))
    chunks = max(1, -(-asking.count() // QUERIES_AT_ONCE))
    asking = asking.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)).cast("int"))

    def searched(routed: DataFrame, label: str) -> DataFrame:
        """routed: (block, chunk, vec_id, dim, x, floor)."""

        def run(key, tree, queries):
            out = []
            if len(tree) and len(queries):
                dim = int(queries["dim"].iloc[0])
                asks = queries["vec_id"].to_numpy(np.int64)
                found = Tree(tree, dim, units[dim]).search(asks, rows_of(queries["x"], dim), k, queries["floor"].to_numpy(float))
                out = [(q, v, s) for q, rows in zip(asks.tolist(), found) for s, v in rows]
                if any(s > MOST_LONG for _, _, s in out):      # then one of the k best of all is such a score
                    raise OverflowError("a score does not fit a long")
            scores = pd.array([s if s >= LEAST_LONG else None for _, _, s in out], "Int64")
            return pd.DataFrame({"query_id": np.array([o[0] for o in out], np.int64), "vec_id": np.array([o[1] for o in out], np.int64),
                                 "score": scores})

        met = stages.save(routed.select("block", "chunk").distinct(), "met")
        left = pages.join(met, "block").groupBy("block", "chunk")
        return stages.save(left.cogroup(routed.groupBy("block", "chunk")).applyInPandas(
            run, "query_id long, vec_id long, score long"), label)

    def best(found):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    home = asking.join(sizes.select("dim", "region", "blocks"), ["dim", "region"]).withColumn(
        "slot", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).select(
        name.alias("block"), "chunk", "vec_id", "dim", "x", F.lit(None).cast("double").alias("floor"))
    home = stages.save(home, "home")
    first = searched(home, "first")
    floors = (best(first).groupBy("query_id").agg(F.count("score").alias("have"), F.min("score").alias("low"))
              .select(F.col("query_id").alias("vec_id"), F.when(F.col("have") == k, F.col("low").cast("double")).alias("floor")))

    table = [(r.dim, r.region, r.radius, r.blocks) for r in sizes.collect()]   # at most PIVOTS rows per length

    def route(parts):
        for frame in parts:
            for dim, rows in frame.groupby("dim"):
                x = measured(rows_of(rows["x"], dim), units[dim])
                q2, floor = (x * x).sum(1), rows["floor"].to_numpy(float)
                factor = SMALL / (units[dim] or 1.0)
                limit = np.where(np.isnan(floor), np.inf, reach(q2, np.nan_to_num(floor) * factor * factor, dim))
                far = between(np.concatenate([x, np.zeros((len(x), 1))], 1), pivots[dim]) if dim in pivots else None
                for of, region, radius, blocks in table:
                    if of == dim:
                        near = rows if far is None else rows[far[:, region] - radius <= limit]
                        for slot in range(blocks):
                            yield near.assign(block=f"{dim}/{region}/{slot}")[columns]

    schema = "block string, chunk int, vec_id long, dim int, x binary, floor double"
    columns = [c.split()[0] for c in schema.split(", ")]
    routed = asking.join(floors, "vec_id", "left").select("chunk", "vec_id", "dim", "x", "floor").mapInPandas(route, schema)
    elsewhere = (routed.join(home.select("block", "vec_id"), ["block", "vec_id"], "left_anti")
                 .select(*columns))
    elsewhere = stages.save(elsewhere, "routed")
    found = first.unionByName(searched(elsewhere, "second"))
    score = F.coalesce("score", F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
