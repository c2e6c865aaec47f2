"""The registered queries: name -> (spark, folder of sales tables) -> DataFrame.

Row-level values stay as computed; sums and averages of doubles are rounded here,
at the edge, because their last digits depend on the order of summation.
"""

from pyspark.sql import functions as F

from itemweld.functions.vectors import similarity
from itemweld.operators import economics as E, evaluation as EV, neighbors as N, quality as Q, review as R
from itemweld.operators.neighbor_index import NeighborIndex
from itemweld.operators.ranking import with_percent_rank
from itemweld.plans import matching, reports, serving
from itemweld.plans.workspace import STATE_BUCKETS, WIDE_DISTANCE, workspace
from itemweld.schema import ATTRIBUTES, FEATURES
from itemweld.sources import generator as G, ingest
from itemweld.streaming import feature_sync

QUERIES = {}

MACHINE, SUPPLIER, NEIGHBOURS, SIMILAR = "Harvester", "Supplier#000000001", 3, 5
MATERIAL, MODEL, PLANT = "M1", "5", "0"
FILTERED = dict(part_category="LARGE", spans_models=True, spans_plants=True, machine_type="Tractor",
                min_savings=1000.0, min_similarity=0.9, min_group_size=2, normalized="no")


def query(fn):
    QUERIES[fn.__name__] = lambda spark, folder: fn(workspace(spark, folder))
    return fn


def rounded(df, digits, *columns):
    """Rounds in two steps: the first drops the noise of summation order, so that
    a decimal tie is one for the second, half-up, step whatever that order was."""
    return df.withColumns({c: F.round(F.round(c, digits + 5), digits) + F.lit(0.0) for c in columns})


def group_rows(df):
    return rounded(rounded(df, 6, "avg_similarity"), 4, "total_current_spend", "savings_potential")


def micros(df, *columns):
    """Timestamps as microseconds, so that no time zone enters a comparison."""
    for c in columns:
        df = df.withColumn(c.replace("_at", "_us"), F.unix_micros(c)).drop(c)
    return df


# --- sources ------------------------------------------------------------------
@query
def scan_parts(ws):
    return ws.parts.select("part_id", "model_id", "part_number", "part_category", "material", "description",
                           "length", "weight", "width", "thickness", "hole_count", "conductor_count",
                           "annual_volume")


@query
def ingest_catalogs(ws):
    return ingest.ingest(ingest.brand_feeds(ws.src)).select(
        "part_id", "part_number", "part_category", "length", "weight", "width")


@query
def incremental_features(ws):
    """Three nights: vectors not filled in yet, the filled ones, then without the near misses; the last two runs
    read only what was appended since the run before."""
    state, feed = feature_sync.served(ws.spark, ws.stages.path("served"), STATE_BUCKETS), ws.stages.path("feed")
    near_misses = ws.truth.where("relationship = 'near_miss'").select(F.col("variant_part_id").alias("part_id"))
    empty = ws.vectors.withColumn("feature_vector", F.transform("feature_vector", lambda x: F.lit(0.0)))
    for night in (empty, ws.vectors, ws.vectors.join(near_misses, "part_id", "left_anti")):
        feature_sync.publish(night, feed, state)
        state.sync(feed)
    return feature_sync.live(state).select("part_id", "version", "part_category", "material",
                                           *[F.get("feature_vector", F.lit(i)).alias(f"z_{f}") for i, f in enumerate(FEATURES)])


# --- generator ------------------------------------------------------------------
def _generated_base(ws):
    if not hasattr(ws, "_generated_base"):
        ids = ws.src.scan("part", "p_partkey").withColumnRenamed("p_partkey", "id")
        ws._generated_base = ws.stages.save(G.base_parts(ids, round_once=True), "g_base")
    return ws._generated_base


def _generated(ws):
    if not hasattr(ws, "_generated"):
        ws._generated = ws.stages.save(G.with_seeds(_generated_base(ws)), "g_parts")
    return ws._generated


_VARIANT_COLUMNS = ["part_id", "model_id", "part_number", "part_category", "material", "material_density",
                    "weight", *ATTRIBUTES]


@query
def gen_range_suppliers(ws):
    return G.suppliers(ws.src.scan("supplier", "s_suppkey").withColumnRenamed("s_suppkey", "id"))


@query
def gen_base_parts(ws):
    return _generated_base(ws).select(*_VARIANT_COLUMNS)


@query
def seed_duplicates(ws):
    return G.duplicates(_generated_base(ws)).select(*_VARIANT_COLUMNS)


@query
def seed_hard_negatives(ws):
    return G.hard_negatives(_generated_base(ws)).select(*_VARIANT_COLUMNS)


@query
def seed_near_misses(ws):
    return G.near_misses(_generated_base(ws)).select(*_VARIANT_COLUMNS)


@query
def gen_description(ws):
    return _generated(ws).select("part_id", "description")


@query
def gen_annual_volume(ws):
    return _generated(ws).select("part_id", "annual_volume")


@query
def gen_supplier_offers(ws):
    return G.offers(_generated(ws), ws.stages)


@query
def gen_ground_truth(ws):
    return EV.ground_truth(_generated(ws), G.LABEL_OF_SUFFIX)


@query
def gen_match_groups(ws):
    """The whole match build over the generated catalogue, with all features."""
    every = _generated(ws)
    offers = ws.stages.save(G.offers(every, ws.stages), "g_offers")
    built = matching.build(every, G.models(G.plants(ws.spark)), offers, ws.stages)
    return group_rows(built.groups)


# --- features and neighbours -------------------------------------------------------
@query
def feature_stats(ws):
    return rounded(ws.stats, 6, "mean", "std")


@query
def feature_vectors(ws):
    return ws.vectors.select("part_id", F.posexplode("feature_vector").alias("position", "z"))


@query
def size_percentile(ws):
    return with_percent_rank(ws.parts.select("part_id", "part_category", "weight"),
                             "part_category", "weight", "size_pct", ws.stages)


@query
def near_pairs_exact(ws):
    return ws.pairs.select("a", "b", "part_category", "material", "dist", "sim")


@query
def near_pairs_grid(ws):
    found = N.folded_pairs_grid(ws.folded, ws.size, ws.stages, WIDE_DISTANCE)
    return N.unfold_pairs(found, ws.copies, ws.stages).select("a", "b", "part_category", "material", "dist", "sim")


@query
def near_pairs_lsh(ws):
    found = N.folded_pairs_lsh(ws.folded, ws.size, ws.stages, WIDE_DISTANCE)
    return N.unfold_pairs(found, ws.copies, ws.stages).select("a", "b", "part_category", "material", "dist", "sim")


@query
def knn_topk(ws):
    return N.nearest(ws.points, ws.points, NEIGHBOURS, ws.size, ws.stages)


@query
def find_similar(ws):
    probes = ws.points.join(ws.truth.select(F.col("variant_part_id").alias("part_id")), "part_id", "left_semi")
    return (N.nearest(probes, ws.points, SIMILAR, ws.size, ws.stages)
            .select("part_id", "neighbor_id", "rank", similarity(F.col("dist")).alias("sim")))


@query
def find_similar_indexed(ws):
    """Every part of one material asks the stored index, which was built before the near misses came and took them in since."""
    late = ws.truth.where("relationship = 'near_miss'").select(F.col("variant_part_id").alias("part_id"))
    index = NeighborIndex(ws.spark, ws.stages.path("index"))
    index.build(ws.points.join(late, "part_id", "left_anti"))
    index.refresh(ws.points.join(late, "part_id", "left_semi").withColumn("op", F.lit("insert")))
    return (index.similar(ws.points, SIMILAR, ws.size, ws.stages, material=MATERIAL)
            .select("part_id", "neighbor_id", "rank", similarity(F.col("dist")).alias("sim")))


@query
def similarity_percentile(ws):
    """Every near pair of parts; ranks are found per pair of distinct vectors, weighted by the pairs of parts it stands for."""
    weighed = ws.stages.save(N.counted_pairs(ws.wide_folded_pairs, ws.folded), "weighed")
    ranked = with_percent_rank(weighed, "part_category", "dist", "sim_pct", ws.stages, descending=True, weight="pairs")
    return N.unfold_counted(ranked, ws.copies, ws.stages).select("a", "b", "part_category", "sim_pct")


@query
def flag_bands(ws):
    cut = EV.category_cutoffs(ws.truth, ws.points, ws.size, ws.stages)
    nearest = N.nearest(ws.points, ws.points, NEIGHBOURS, ws.size, ws.stages)
    return EV.flag_bands(EV.candidates(ws.wide_pairs, nearest, ws.points), cut)


@query
def threshold_calibration(ws):
    out = EV.threshold_calibration(ws.truth, ws.points, ws.size, ws.stages)
    return rounded(out, 6, "min_dist", "max_dist", "p50_dist", "p99_dist")


# --- groups ---------------------------------------------------------------------
@query
def connected_components(ws):
    return ws.labels.select("part_id", "comp")


@query
def crowd_members(ws):
    """The same members by the path that lists no pairs, whatever the catalogue's crowding."""
    labels = matching.label_parts(ws.points, ws.folded, None, ws.size, ws.stages)
    return matching.build_members(labels, ws.parts, ws.models, ws.stages).select("group_id", "part_id", "similarity")


@query
def gen_best_offers(ws):
    return E.best_offers(G.offers(_generated(ws), ws.stages))


@query
def group_ids(ws):
    return ws.members.select("group_id", "part_id")


@query
def member_similarity(ws):
    return ws.labels.select("part_id", "similarity")


@query
def group_members(ws):
    return ws.members


@query
def member_best_price(ws):
    return E.member_best_price(ws.offers)


@query
def group_savings(ws):
    return rounded(E.group_savings(ws.priced), 4, "total_current_spend", "savings_potential")


@query
def group_spans(ws):
    return rounded(E.group_spans(ws.members, ws.parts), 6, "avg_similarity")


@query
def match_groups(ws):
    return group_rows(ws.groups)


@query
def offer_price_gap(ws):
    return E.offer_price_gap(ws.members, ws.offers)


@query
def group_price_leadtime_gap(ws):
    return E.group_price_leadtime_gap(ws.members, ws.offers)


@query
def savings_by_plant(ws):
    return rounded(E.savings_by_plant(ws.priced, ws.groups), 4, "savings_potential")


@query
def rationalization_progress(ws):
    now = R.apply_normalized_ids(ws.parts, ws.members, ws.assignments)
    return rounded(E.rationalization_progress(ws.parts, ws.members, now), 6, "grouped_pct", "normalized_pct")


@query
def sku_supplier_reduction(ws):
    return E.sku_supplier_reduction(ws.members, ws.offers)


# --- evaluation -------------------------------------------------------------------
@query
def ground_truth_labels(ws):
    return ws.truth


@query
def eval_pair_verdicts(ws):
    return EV.pair_verdicts(ws.truth, ws.members)


@query
def eval_metrics(ws):
    return rounded(ws.eval_metrics, 9, "recall", "precision", "f1")


@query
def eval_coincidental(ws):
    return EV.coincidental(ws.truth, ws.members, ws.parts)


@query
def eval_violations(ws):
    return EV.violations(ws.truth, ws.members)


@query
def eval_gate(ws):
    return rounded(EV.gate(ws.eval_metrics), 9, "recall", "precision", "f1")


# --- data quality -------------------------------------------------------------------
def _tables(ws):
    return {"plants": ws.plants, "models": ws.models, "suppliers": ws.suppliers, "parts": ws.parts,
            "supplier_catalogs": ws.offers, "ground_truth": ws.truth}


@query
def dq_row_counts(ws):
    return Q.row_counts(_tables(ws))


@query
def dq_attr_collisions(ws):
    return Q.attribute_collisions(ws.parts)


@query
def dq_fk_integrity(ws):
    numbered = R.apply_normalized_ids(ws.parts, ws.members, ws.assignments)
    return Q.fk_integrity({**_tables(ws), "parts": numbered, "normalized_parts": ws.normalized})


@query
def dq_primary_keys(ws):
    return Q.primary_keys(_tables(ws))


@query
def dq_not_null(ws):
    return Q.not_null(_tables(ws))


@query
def dq_part_number_within_model(ws):
    return Q.part_number_within_model(ws.parts)


@query
def dq_blocking_keys(ws):
    return Q.blocking_keys(ws.parts)


@query
def dq_labels_complete(ws):
    return Q.labels_complete(ws.parts, ws.truth)


@query
def dq_block_purity(ws):
    return Q.block_purity(ws.members, ws.parts)


@query
def dq_currencies(ws):
    return Q.currencies(ws.offers)


@query
def dq_review_roundtrip(ws):
    return Q.review_roundtrip(R.valid_reviews(ws.review_log), ws.reviews)


# --- review state -------------------------------------------------------------------
@query
def review_state_latest(ws):
    return micros(ws.reviews, "updated_at")


@query
def review_rejects(ws):
    return micros(ws.review_state.read_rejects().select("seq", "group_id", "status", "updated_at"), "updated_at")


@query
def assignment_state_latest(ws):
    return micros(ws.assignments, "assigned_at")


@query
def normalized_parts(ws):
    return micros(ws.normalized, "assigned_at")


@query
def apply_normalized_ids(ws):
    return (R.apply_normalized_ids(ws.parts, ws.members, ws.assignments)
            .select("part_id", "normalized_part_id"))


@query
def suppress_reviewed(ws):
    return R.suppress_reviewed(ws.groups, ws.reviews).select("group_id", "part_category", "material", "member_count")


@query
def orphaned_reviews(ws):
    return micros(R.orphaned_reviews(ws.reviews, ws.groups).select("group_id", "status", "updated_at"), "updated_at")


# --- serving and queue ----------------------------------------------------------------
@query
def serve_match_groups(ws):
    return group_rows(serving.serve_match_groups(ws.groups))


@query
def serve_members(ws):
    return ws.serving_members


@query
def serve_supplier_offers(ws):
    return ws.serving_offers


@query
def queue_default(ws):
    rows = serving.default_queue(ws.groups, ws.serving_members, ws.serving_offers, ws.reviews, ws.assignments)
    return group_rows(serving.queue_page(rows))


@query
def queue_page(ws):
    return group_rows(serving.queue_page(ws.queue(), sort="avg_similarity", direction="asc", limit=20, offset=10))


@query
def queue_total(ws):
    return serving.queue_total(ws.queue(status="new", spans_models=True))


@query
def queue_filtered(ws):
    return group_rows(ws.queue(**FILTERED))


@query
def queue_by_machine_type(ws):
    return group_rows(ws.queue(machine_type=MACHINE))


@query
def queue_by_supplier(ws):
    return group_rows(ws.queue(supplier=SUPPLIER))


@query
def queue_unnormalized(ws):
    return group_rows(ws.queue(normalized="no"))


@query
def queue_normalized(ws):
    return group_rows(ws.queue(normalized="yes"))


@query
def queue_by_material(ws):
    return group_rows(ws.queue(material=MATERIAL))


@query
def queue_spanning_types(ws):
    return group_rows(ws.queue(spans_machine_types=True))


@query
def queue_by_model(ws):
    return group_rows(ws.queue(model=MODEL))


@query
def queue_by_plant(ws):
    return group_rows(ws.queue(plant=PLANT))


@query
def group_detail_header(ws):
    head = serving.group_header(ws.groups, ws.reviews, ws.assignments)
    return micros(group_rows(head), "updated_at", "assigned_at")


@query
def group_detail_members(ws):
    return serving.group_members_view(ws.serving_members)


@query
def group_detail_offers(ws):
    return serving.group_offers_view(ws.serving_members, ws.serving_offers)


@query
def filter_options(ws):
    return serving.filter_options(ws.groups, ws.serving_members, ws.serving_offers)


# --- reports ------------------------------------------------------------------------
@query
def dash_kpi(ws):
    return reports.kpi(ws.groups, ws.members, ws.normalized)


@query
def dash_engine_overall(ws):
    return reports.engine_overall(ws.eval_metrics)


@query
def dash_by_category(ws):
    return reports.by_category(ws.groups)


@query
def dash_by_span(ws):
    return reports.by_span(ws.groups)


@query
def dash_status(ws):
    return reports.by_status(ws.groups, ws.reviews)


@query
def dash_eval(ws):
    return reports.eval_table(ws.eval_metrics)


@query
def similarity_histogram(ws):
    return reports.similarity_histogram(ws.folded, ws.size, ws.stages, WIDE_DISTANCE)


@query
def concentration_by_machine_type(ws):
    return reports.concentration_by_machine_type(ws.members)


@query
def cross_type_groups(ws):
    return group_rows(reports.cross_type_groups(ws.groups))


@query
def parts_dup_other_plant(ws):
    return reports.parts_dup_other_plant(ws.members)


@query
def similar_cross_type_faster(ws):
    return reports.similar_cross_type_faster(ws.folded, ws.copies, ws.size, ws.stages, ws.parts, ws.models, ws.offers)
