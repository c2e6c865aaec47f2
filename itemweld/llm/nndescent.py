"""Near-duplicate embeddings by NN-descent.

Vectors within half the linking angle of a leader form a bundle: all of a bundle are linked with
each other, so dense groups need no pair lists. NN-descent runs over the leaders: lists start
from hyperplane-hash blocks and are refined by joining the neighbours of each node with each
other; a list that is full of links is doubled; recall is audited against brute force on a
sample, and too low a recall adds further start blocks. Where that doesn't settle it, or the sample
holds too few links to tell, all leaders are compared in blocks inside tasks. Links between bundles are then counted
whole where distances to the leader decide them, and vector by vector where they don't.
"""

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from itemweld.llm.common import mix, rows_of
from itemweld.operators.components import connected_components
from itemweld.sources.staging import Stages

COSINE = 0.95
THETA = float(np.arccos(COSINE))
HALF = THETA / 2 - 1e-6         # radius of a bundle: any two of it are then linked
SLACK = 1e-7                    # angles this near a bound are decided by the cosine itself
SLICE = 3 << 27                 # bytes of vectors on their way at once, or as many as the leaders have
K = 8                           # length of a neighbour list before enlargement
BLOCK, DEALT = 1024, 4096       # rows a hash block is meant to have; above the second it is dealt out
TABLES = 4                      # hash tables that start the lists
ROUNDS, PASSES = 8, 3           # descent rounds in a pass, passes with fresh tables; what they leave open is compared whole
AUDIT, RECALL = (256, 4096), 0.98       # leaders of the audit sample, the second if the first shows too few edges; recall asked for
SHOWN = 100                     # true edges from which a sample tells the recall


def stored_as(vectors: DataFrame, embedding: str) -> str:
    """How vectors are kept until they are used: floats as they are, anything else as doubles."""
    kind = vectors.select(F.col(embedding)).schema[0].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def unit_rows(vectors: DataFrame, vec_id: str, embedding: str, kind: str) -> DataFrame:
    """(vec_id, node long, u binary of the vector's components); node and u null for vectors that
    can't link. Equal and parallel vectors have the same node."""

    def run(batches):
        for batch in batches:
            nodes, units = [], []
            for v in batch.column(1).to_pylist():
                raw = np.array(v if v is not None else [], np.float64)       # None becomes nan
                top = np.abs(raw).max(initial=0)
                if len(raw) and np.isfinite(top) and top > 0:
                    a = raw / top
                    units.append(raw.astype(kind).tobytes())
                    nodes.append(xxhash.xxh3_64_intdigest((a / np.sqrt(a @ a) + 0.0).astype("<f8").tobytes()) - (1 << 63))
                else:
                    units.append(None)
                    nodes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())],
                                             names=["vec_id", "node", "u"])

    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
            .mapInArrow(run, "vec_id long, node long, u binary"))


def matrix(column, kind: str) -> np.ndarray:
    """The unit vectors of stored ones of equal length."""
    a = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    a /= np.abs(a).max(1)[:, None]
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def cosines(x: pd.Series, y: pd.Series, kind: str) -> np.ndarray:
    """Cosine of each stored vector of x with that of y beside it; -1 for vectors of different lengths."""
    x, y, out = x.to_numpy(), y.to_numpy(), np.full(len(x), -1.0)
    sizes = np.array([len(v) if len(v) == len(w) else 0 for v, w in zip(x, y)])
    for size in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == size)
        out[at] = np.einsum("ij,ij->i", matrix(x[at], kind), matrix(y[at], kind))
    return out


def codes(u: np.ndarray, table: int, bits: int) -> np.ndarray:
    """Signs along seeded random directions, as one integer per row."""
    d = u.shape[1]
    draw = mix(np.arange(bits * d * 2, dtype=np.uint64) + np.uint64((table + 1) * 1_000_003))
    a, b = ((draw >> np.uint64(11)) + np.uint64(1)).astype(float).reshape(2, bits, d) / 2.0**53
    planes = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
    return ((u @ planes.T > 0) << np.arange(bits)).sum(1)


def blocks(points: DataFrame, table: int, bits: int, kind: str, stages: Stages) -> DataFrame:
    """``points`` with a column block; codes of very many rows are dealt into slots. The codes are counted
    first, apart from the vectors, which then move once."""

    def coded(rows: DataFrame, kept: list) -> DataFrame:
        def run(parts):
            for frame in parts:
                frame = frame.reset_index(drop=True)
                code = pd.Series("", index=frame.index)
                for size, rows in frame.groupby(frame["u"].str.len()):
                    code[rows.index] = [f"{size}/{c}" for c in codes(matrix(rows["u"], kind), table, bits)]
                yield frame[kept].assign(code=code)

        return rows.mapInPandas(run, ", ".join([f"{n} {t}" for n, t in rows.dtypes if n in kept] + ["code string"]))

    sizes = stages.save(coded(points.select("u"), []).groupBy("code").agg(F.count(F.lit(1)).alias("rows")), "codes")
    slot = F.pmod(F.xxhash64("node", F.lit(table)), F.ceil(F.col("rows") / DEALT).cast("int"))
    return coded(points, points.columns).join(sizes, "code").select(*points.columns, F.concat_ws("/", "code", slot).alias("block"))


def leaders_of(node, u):
    """Greedy leaders of one block whose rows are in order of node: the number of each row's leader and the cosine with it."""
    leader, with_it, near = np.full(len(node), -1), np.ones(len(node)), np.cos(HALF)
    for a in range(0, len(node), 512):
        c = u[a:a + 512] @ u.T
        rows, cols = np.nonzero(c >= near)
        ends = np.searchsorted(rows, np.arange(min(512, len(node) - a) + 1))
        for i in range(a, min(a + 512, len(node))):
            if leader[i] < 0:
                mine = cols[ends[i - a]:ends[i - a + 1]]
                mine = mine[leader[mine] < 0]
                leader[mine], with_it[mine] = i, c[i - a, mine]
                leader[i] = i
    return leader, with_it


def bundling(kind: str):
    def bundle(frame: pd.DataFrame) -> pd.DataFrame:
        """The rows of one block with their leader and the angle to it."""
        frame = frame.sort_values("node")
        node = frame["node"].to_numpy()
        leader, with_it = leaders_of(node, matrix(frame["u"], kind))
        turn = np.where(leader == np.arange(len(node)), 0.0, angle(with_it) + SLACK)
        return frame[["node", "u", "copies", "low"]].assign(leader=node[leader], turn=turn)

    return bundle


def heading(kind: str):
    def head(frame: pd.DataFrame) -> pd.DataFrame:
        """The leaders of one block that are near another one, and that one with its vector."""
        frame = frame.sort_values("node")
        node, u = frame["node"].to_numpy(), frame["u"].to_numpy()
        leader, _ = leaders_of(node, matrix(u, kind))
        moved = leader != np.arange(len(node))
        return pd.DataFrame({"leader": node[moved], "head": node[leader[moved]], "uh": u[leader[moved]]})

    return head


def angle(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


def nearest_in(node, u, r, quota):
    """Pairs (a, b, gap) in which b is among a's nearest ``quota`` of these rows. gap is the angle
    less both radii: what decides whether any of the two bundles can be linked."""
    gap = angle(u @ u.T) - r[:, None] - r[None, :]
    np.fill_diagonal(gap, np.inf)
    take = min(quota, len(node) - 1)
    if take < 1:
        return np.zeros((0, 2), np.int64), np.zeros(0)
    order = np.argpartition(gap, take - 1, 1)[:, :take] if take < len(node) - 1 else np.argsort(gap, 1)[:, :take]
    a, b = np.repeat(np.arange(len(node)), take), order.ravel()
    g = gap[a, b]
    good = np.isfinite(g) & (a != b)
    return np.stack([node[a[good]], node[b[good]]], 1), g[good]


def starting(kind: str):
    def start(frame: pd.DataFrame) -> pd.DataFrame:
        pairs, g = nearest_in(frame["node"].to_numpy(), matrix(frame["u"], kind), frame["r"].to_numpy(), K)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "gap": g})

    return start


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct("a", "b", "gap"), F.struct(
        F.col("b").alias("a"), F.col("a").alias("b"), "gap"))).alias("e")).select("e.*")


def shortest(pairs: DataFrame, quota: DataFrame, factor=1) -> DataFrame:
    """Each node's nearest neighbours, as many as its quota."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy("gap", "b"))
    limited = pairs.repartition("a").groupBy("a", "b").agg(F.min("gap").alias("gap")).withColumn("rank", rank)
    return (limited.join(quota.select(F.col("node").alias("a"), "quota"), "a", "left")
            .where(F.col("rank") <= factor * F.coalesce("quota", F.lit(K))).select("a", "b", "gap"))


def worst_of(graph: DataFrame, quota: DataFrame) -> DataFrame:
    """(b, worst): gap that a neighbour has to beat to enter the list of b, for lists that are full."""
    return (graph.groupBy("a").agg(F.max("gap").alias("worst"), F.count(F.lit(1)).alias("have"))
            .join(quota.withColumnRenamed("node", "a"), "a", "left").where(F.col("have") >= F.coalesce("quota", F.lit(K)))
            .select(F.col("a").alias("b"), "worst"))


def met(b, u, r, worst, starts, kind):
    """Pairs (a, b, gap) of the rows between each two starts that better a's list or may be linked."""
    sizes, length = np.array([len(x) for x in u]), np.diff(starts)
    pairs, gaps = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    for m in np.unique(length[length > 1]).tolist():
        of_m = starts[:-1][length == m]
        for size in np.unique(sizes[of_m]).tolist():
            lists = of_m[sizes[of_m] == size]
            once = max(1, 1_000_000 // (m * (m + size // 8)))
            for x in range(0, len(lists), once):
                at = lists[x:x + once, None] + np.arange(m)
                at = at[(sizes[at] == size).all(1)]
                v = matrix(u[at.ravel()], kind).reshape(len(at), m, -1) if len(at) else np.zeros((0, m, 1))
                gap = angle(v @ v.transpose(0, 2, 1)) - r[at][:, :, None] - r[at][:, None, :]
                good = (gap < worst[at][:, :, None]) | (gap <= THETA + SLACK)
                good &= ~np.eye(m, dtype=bool)
                k, i, j = np.nonzero(good)
                pairs.append(np.stack([b[at[k, i]], b[at[k, j]]], 1))
                gaps.append(gap[k, i, j])
    return np.concatenate(pairs), np.concatenate(gaps)


def joined_neighbours(graph: DataFrame, leaders: DataFrame, worst: DataFrame, quota: DataFrame, kind: str, slices=1, part=0) -> DataFrame:
    """NN-descent's local join: the neighbours of each node, in both directions, meet each other. Only
    around the nodes of one slice, since each neighbour's vector is sent to every node it lies at."""
    known = leaders.select(F.col("node").alias("b"), "u", "r").join(worst, "b", "left").withColumn("worst", F.coalesce("worst", F.lit(9.0)))
    mine = both_ways(graph).where(F.pmod(F.xxhash64("a", F.lit(5)), F.lit(slices)) == part)
    around = shortest(mine, quota, 2).join(known, "b")
    lists = around.groupBy("a").agg(F.collect_list(F.struct("b", "u", "r", "worst")).alias("near"))

    def run(batches):
        for batch in batches:
            near = batch.column(0)
            starts = near.offsets.to_numpy() - near.offsets[0].as_py()
            flat = near.flatten()
            u = np.empty(len(flat), object)
            u[:] = flat.field("u").to_pylist()
            p, g = met(*(c if isinstance(c, np.ndarray) else c.to_numpy() for c in (flat.field("b"), u, flat.field("r"), flat.field("worst"))), starts, kind)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(g)], names=["a", "b", "gap"])

    return lists.select("near").mapInArrow(run, "a long, b long, gap double")


def audit(leaders: DataFrame, edges: DataFrame, sample: int, kind: str):
    """(found, true): the bundle edges of a bounded sample of leaders that ``edges`` has, and those there are."""
    drawn = leaders.orderBy(F.xxhash64("node"), "node").limit(sample).select("node", "u", "r").toPandas()
    groups = {size: (rows["node"].to_numpy(), matrix(rows["u"], kind), rows["r"].to_numpy()) for size, rows in drawn.groupby(drawn["u"].str.len())}

    def run(parts):
        for frame in parts:
            count = 0
            for size, rows in frame.groupby(frame["u"].str.len()):
                if size in groups:
                    node, u, r = groups[size]
                    i, j, _ = gaps_within(matrix(rows["u"], kind), rows["r"].to_numpy(), u, r, THETA)
                    count += int((rows["node"].to_numpy()[i] != node[j]).sum())
            yield pd.DataFrame({"n": [count]})

    true = leaders.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
    if not true:
        return 0, 0
    ids = F.broadcast(edges.sparkSession.createDataFrame(drawn[["node"]].rename(columns={"node": "a"})))
    return edges.where(F.col("gap") <= THETA).join(ids, "a", "left_semi").count(), true


def recall_of(leaders: DataFrame, edges: DataFrame, kind: str):
    """Share of the true edges that ``edges`` has; None if no sample shows enough of them to tell."""
    total = leaders.count()
    for sample in AUDIT:
        found, true = audit(leaders, edges, sample, kind)
        if true >= SHOWN or sample >= total:
            return found / true if true else 1.0
    return None


def gaps_within(u, r, v, s, bound):
    """(i, j, gap) of the rows of u and v whose gap is at most ``bound``, a few rows of u at a time."""
    least = np.cos(min(np.pi, bound + r.max(initial=0) + s.max(initial=0))) - 1e-9      # spares most angles
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(u), 512):
        c = u[a:a + 512] @ v.T
        i, j = np.nonzero(c >= least)
        gap = angle(c[i, j]) - r[a + i] - s[j]
        ok = gap <= bound
        out.append((a + i[ok], j[ok], gap[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def packed(leaders: DataFrame, kind: str) -> DataFrame:
    """(no, nodes, u, r): rows of at most 2 * BLOCK leaders with vectors of one length, as unit vectors in single precision."""

    def run(batches):
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            frame = batch.to_pandas()
            for _, same in frame.groupby(frame["u"].str.len()):
                for x in range(0, len(same), 2 * BLOCK):
                    rows, no = same.iloc[x:x + 2 * BLOCK], no + 1
                    yield pa.RecordBatch.from_pylist([{
                        "no": no, "nodes": rows["node"].to_numpy().astype("<i8").tobytes(),
                        "u": matrix(rows["u"], kind).astype("<f4").tobytes(), "r": rows["r"].to_numpy().astype("<f8").tobytes()}])

    return leaders.select("node", "u", "r").mapInArrow(run, "no long, nodes binary, u binary, r binary")


def whole_edges(leaders: DataFrame, kind: str, stages: Stages) -> DataFrame:
    """(a, b, gap) both ways: every pair of leaders whose bundles may hold linked vectors, and perhaps a few beyond
    by rounding. Each two packed rows meet in one task that reads both from storage, so nothing is shuffled."""
    rows = stages.save(packed(leaders, kind), "packed")

    def meet(batches):
        for batch in batches:
            for row in rows_of(batch):
                (x, u, r), (y, v, s) = ((np.frombuffer(row["nodes" + k], "<i8"), np.frombuffer(row["u" + k], "<f4").reshape(len(row["r" + k]) // 8, -1),
                                         np.frombuffer(row["r" + k], "<f8")) for k in "12")
                if u.shape[1] != v.shape[1]:
                    continue
                off = (u.shape[1] + 8) * 2.0 ** -23       # what rounding can take off a cosine
                bound = THETA + SLACK
                least = np.cos(min(np.pi, bound + r.max() + s.max())) - off
                for at in range(0, len(x), 256):
                    c = u[at:at + 256] @ v.T
                    i, j = np.divmod(np.flatnonzero(c >= np.float32(least - 1e-7)), len(y))
                    gap = angle(c[i, j].astype(float) + off) - r[at + i] - s[j]
                    ok = gap <= bound
                    if row["no1"] == row["no2"]:
                        ok &= at + i < j
                    yield pa.RecordBatch.from_arrays([pa.array(x[at + i[ok]]), pa.array(y[j[ok]]), pa.array(gap[ok])], names=["a", "b", "gap"])

    one, two = (rows.select(*(F.col(c).alias(c + k) for c in rows.columns)) for k in "12")
    pairs = one.crossJoin(two).where("no1 <= no2").mapInArrow(meet, "a long, b long, gap double")
    edges = stages.save(both_ways(pairs), "edges")
    stages.forget(rows)
    return edges


def weight_of(leaders: DataFrame):
    """Number of leaders and bytes of their vectors."""
    return leaders.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("u")), F.lit(0))).first()


def slices_for(sizes: int, each: int, held: int) -> int:
    """In how many slices ``sizes`` rows of ``each`` bytes move, so that none takes much more than SLICE or what is held anyway."""
    return max(1, -(-sizes * each // max(SLICE, held)))


def bundle_edges(leaders: DataFrame, kind: str, stages: Stages) -> DataFrame:
    """(a, b, gap) both ways: pairs of leaders whose bundles may hold linked vectors, by NN-descent."""
    spark = leaders.sparkSession
    total, bytes_ = weight_of(leaders)
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / BLOCK))))
    quota = spark.createDataFrame([], "node long, quota int")
    graph = edges = spark.createDataFrame([], "a long, b long, gap double")

    def near(pairs):
        return both_ways(pairs.where(F.col("gap") <= THETA + SLACK))

    def replaced(old, new, name):
        saved = stages.save(new, name)
        stages.forget(old)
        return saved

    for step in range(PASSES):
        count = -1
        for t in range(TABLES):
            fresh = stages.save(blocks(leaders, 10 + step * TABLES + t, bits, kind, stages).groupBy("block")
                                .applyInPandas(starting(kind), "a long, b long, gap double"), "seeds")
            edges = replaced(edges, edges.unionByName(near(fresh)).distinct(), "edges")
            graph = replaced(graph, shortest(graph.unionByName(fresh), quota), "graph")
            stages.forget(fresh)
        for _ in range(ROUNDS):
            # A list in which every neighbour may be linked can hide more of them: it is doubled.
            full = (graph.groupBy("a").agg(F.max("gap").alias("worst"), F.count(F.lit(1)).alias("have"))
                    .join(quota.withColumnRenamed("node", "a"), "a", "left")
                    .withColumn("quota", F.coalesce("quota", F.lit(K))).where((F.col("worst") <= THETA + SLACK) & (F.col("have") >= F.col("quota")))
                    .select(F.col("a").alias("node"), (F.col("quota") * 2).cast("int").alias("quota")))
            grown = stages.save(full.unionByName(quota).groupBy("node").agg(F.max("quota").alias("quota")), "quota")
            saturated = grown.exceptAll(quota).count() if step or count >= 0 else grown.count()
            worst = stages.save(worst_of(graph, quota), "worst")
            slices = slices_for(2 * graph.count(), 64 + bytes_ // max(total, 1), bytes_)
            merged, waiting = graph, []
            for part in range(slices):
                waiting.append(stages.save(joined_neighbours(graph, leaders, worst, quota, kind, slices, part), "joined"))
                last = part + 1 == slices
                if last or sum(w.count() for w in waiting) * 24 > max(SLICE, bytes_) // 2:
                    fresh = functools.reduce(DataFrame.unionByName, waiting)
                    edges = replaced(edges, edges.unionByName(near(fresh)).distinct(), "edges")
                    more = merged.unionByName(fresh).unionByName(edges) if last else merged.unionByName(fresh)
                    later = stages.save(shortest(more, grown), "graph")
                    stages.forget(*waiting, *[merged] * (merged is not graph))
                    merged, waiting = later, []
            stages.forget(graph, worst, quota)
            graph, quota = merged, grown
            now = edges.count()
            settled = now == count and not saturated
            if settled:
                break
            count = now
        recall = recall_of(leaders, edges, kind)
        if recall is None:
            break
        if settled and recall >= RECALL:
            stages.forget(graph)
            return edges
    stages.forget(graph, edges)
    return whole_edges(leaders, kind, stages)


def near_links(vectors: DataFrame, *, vec_id="vec_id", embedding="embedding", stages=None) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept), links having cosine >= 0.95.

    Equal or parallel vectors are linked like any others; repeated rows count as vectors of their own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing
    (0 links, component_id = vec_id, kept), nor do vectors of different lengths. A null
    vec_id counts in its neighbours' links, but gets component_id null and kept true if it names no
    group. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    stages = stages or Stages(spark, "nndescent", lean=True)
    kind = stored_as(vectors, embedding)
    # Vectors are stored once, and each table goes as soon as nothing reads it any more.
    given = stages.save(unit_rows(vectors, vec_id, embedding, kind), "given")
    rows = stages.save(given.select("vec_id", "node"), "rows")
    points = stages.save(given.where("node IS NOT NULL").groupBy("node").agg(
        F.first("u").alias("u"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low")), "points")
    stages.forget(given)
    bits = max(0, int(np.ceil(np.log2(max(points.count(), 1) / BLOCK))))

    member = "node long, u binary, copies long, low long, leader long, turn double"
    one = stages.save(blocks(points, 0, bits, kind, stages).groupBy("block").applyInPandas(bundling(kind), member), "bundles")
    stages.forget(points)
    two = stages.save(blocks(one.where("node = leader").select("node", "u"), 1, bits, kind, stages).groupBy("block").applyInPandas(
        heading(kind), "leader long, head long, uh binary"), "heads")

    # Members follow their leader to its own leader if that one is near enough for them.
    def follow(parts):
        for frame in parts:
            moved = frame["uh"].notna().to_numpy()
            c = np.full(len(frame), -1.0)
            c[moved] = cosines(frame["u"][moved], frame["uh"][moved], kind)
            near = c >= np.cos(HALF)
            frame["leader"] = np.where(near, frame["head"], frame["leader"])
            frame["turn"] = np.where(near, angle(c) + SLACK, frame["turn"])
            yield frame[["node", "u", "copies", "low", "leader", "turn"]]

    placed = stages.save(one.join(two, "leader", "left").select("node", "u", "copies", "low", "leader", "turn", F.coalesce("head", "leader").alias("head"), "uh")
                         .mapInPandas(follow, member), "placed")
    stages.forget(one, two)
    bundles = placed.groupBy("leader").agg(F.max("turn").alias("r"), F.sum("copies").alias("weight")).withColumnRenamed("leader", "node")
    leaders = stages.save(bundles.join(placed.select("node", "u"), "node").select("node", "u", "r", "weight"), "leaders")
    # A leader's own vector stays with the leaders only.
    members = stages.save(placed.withColumn("u", F.expr("CASE WHEN node <> leader THEN u END")), "members")
    stages.forget(placed)

    def with_vectors(some: DataFrame) -> DataFrame:
        """``some`` (node, leader, ...) with the vectors u of the nodes."""
        own = leaders.select("node", "u")
        return (some.where("node <> leader").join(members.where("node <> leader").select("node", "u"), "node")
                .unionByName(some.where("node = leader").join(own, "node")))

    edges = stages.save(bundle_edges(leaders, kind, stages).select("a", "b").where("a <> b").distinct(), "pairs")

    def decide(parts):
        for frame in parts:
            if len(frame):
                c = cosines(frame["u"], frame["uo"], kind)
                turn, r = angle(c), frame["ro"].to_numpy()
                lone = r == 0
                yes = np.where(lone, c >= COSINE, turn + r <= THETA - SLACK)
                no = np.where(lone, ~yes, turn - r > THETA + SLACK)
                state = np.where(yes, 1, np.where(no, 0, 2))
                some = state > 0
                yield pd.DataFrame({"node": frame["node"], "a": frame["a"], "b": frame["b"], "weight": frame["weight"], "state": state})[some]

    total, bytes_ = weight_of(leaders)

    def sliced(rows: DataFrame, moved: int, step, name):
        """``step`` of some (node, leader, b) at a time; of all of them it moves ``moved`` pairs of vectors."""
        slices = slices_for(moved, 64 + 2 * bytes_ // max(total, 1), bytes_)
        slot = F.pmod(F.xxhash64("node", "b", F.lit(6)), F.lit(slices))
        return functools.reduce(DataFrame.unionByName, [stages.save(step(rows.where(slot == part)), name) for part in range(slices)])

    other = leaders.select(F.col("node").alias("b"), F.col("u").alias("uo"), F.col("r").alias("ro"), "weight")
    asked = edges.withColumnRenamed("a", "leader").join(members.select("node", "leader"), "leader")
    tried = sliced(asked, asked.count(), lambda some: with_vectors(some).join(other, "b").withColumnRenamed("leader", "a")
                   .select("node", "a", "b", "u", "uo", "ro", "weight")
                   .mapInPandas(decide, "node long, a long, b long, weight long, state int"), "tried")

    def one_by_one(parts):
        for frame in parts:
            if len(frame):
                yield frame[["node", "a", "b", "weight"]][cosines(frame["u"], frame["um"], kind) >= COSINE]

    unsure = tried.where("state = 2").select("node", F.col("a").alias("leader"), "b")
    single = with_vectors(members.drop("u")).select(F.col("leader").alias("b"), F.col("u").alias("um"), F.col("copies").alias("weight"))
    loads = members.groupBy(F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("rows"))
    close = sliced(unsure, unsure.join(loads, "b").agg(F.sum("rows")).first()[0] or 0, lambda some: with_vectors(some).join(single, "b")
                   .withColumnRenamed("leader", "a").select("node", "a", "b", "u", "um", "weight")
                   .mapInPandas(one_by_one, "node long, a long, b long, weight long"), "close")
    links = tried.where("state = 1").select("node", "a", "b", "weight").unionByName(close)
    outside = links.groupBy("node").agg(F.sum("weight").alias("outside"))
    parts_ = stages.save(connected_components(links.select("a", "b").distinct(), stages), "parts")
    named = (members.drop("u").join(parts_.withColumnRenamed("id", "leader"), "leader", "left")
             .select("node", "leader", "low", F.coalesce("comp", "leader").alias("comp")))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    facts = (named.join(lowest, "comp").join(leaders.select(F.col("node").alias("leader"), "weight"), "leader")
             .join(outside, "node", "left")
             .select("node", "component_id", (F.col("weight") - 1 + F.coalesce("outside", F.lit(0))).alias("links")))
    return (rows.select("vec_id", "node").join(facts, "node", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
