"""Review state: the rules that must never break silently."""

import datetime as dt

from pyspark.sql import functions as F

from itemweld.operators import quality as Q, review as R
from itemweld.plans import serving
from itemweld.plans.workspace import workspace

T0 = dt.datetime(2024, 1, 1)
LOG = "group_id string, status string, reviewer string, notes string, updated_at timestamp, seq bigint"


def log(spark, rows):
    return spark.createDataFrame(
        [(g, s, "r", f"n{i}", T0 + dt.timedelta(hours=h), i) for i, (g, s, h) in enumerate(rows)], LOG)


def appended(rows, folder):
    rows.write.mode("append").parquet(folder)
    return folder


def test_latest_wins_by_time_then_sequence(spark, stages):
    df = log(spark, [("a", "reviewed", 5), ("a", "new", 1), ("b", "dismissed", 2), ("b", "consolidated", 2), ("c", "archived", 9)])
    state = R.review_state(spark, stages.path("state"), df.schema, 4)
    state.sync(appended(df, stages.path("log")))
    assert {r.group_id: r.status for r in state.read().collect()} == {"a": "reviewed", "b": "consolidated"}
    assert [r.status for r in state.read_rejects().collect()] == ["archived"]


def test_stream_restart_keeps_newer_state_against_late_rows(spark, stages):
    source, folder, schema = stages.path("in"), stages.path("state"), log(spark, []).schema

    def run():      # a new object each time, as a new process would have
        state = R.review_state(spark, folder, schema, 4)
        did = state.sync(source)
        return {r.group_id: r.status for r in state.read().collect()}, did.input_rows, state

    appended(log(spark, [("a", "reviewed", 5), ("b", "new", 1)]), source)
    assert run()[:2] == ({"a": "reviewed", "b": "new"}, 2)
    appended(log(spark, [("a", "new", 3), ("b", "dismissed", 2), ("c", "archived", 1), (None, None, 1)]), source)
    assert run()[:2] == ({"a": "reviewed", "b": "dismissed"}, 4)     # the row of hour 3 came late
    got, rows, state = run()
    assert (got, rows) == ({"a": "reviewed", "b": "dismissed"}, 0)     # nothing new, nothing read
    assert sorted((r.group_id, r.status) for r in state.read_rejects().where("group_id IS NOT NULL").collect()) == [("c", "archived")]
    assert state.read_rejects().count() == 2 and state.buckets == 4
    assert R.review_state(spark, folder, schema, 99).buckets == 4


def test_only_touched_buckets_are_rewritten_and_broken_batches_replaced(spark, stages):
    source, folder, schema = stages.path("in"), stages.path("state"), log(spark, []).schema
    state = R.review_state(spark, folder, schema, 8)
    state.sync(appended(log(spark, [(f"g{i}", "new", 1) for i in range(200)]), source))
    assert set(state._current().values()) == {0} and len(state._current()) == 8
    log(spark, [("x", "reviewed", 1)]).write.parquet(f"{folder}/state/version=2/bucket=3")      # left by a batch that broke off
    assert state.read().count() == 200
    did = state.sync(appended(log(spark, [("g7", "reviewed", 2)]), source))
    assert (did.input_rows, did.buckets) == (1, 1) and sorted(state._current().values()) == [0] * 7 + [2]
    assert state.read().count() == 200 and state.read().where("status = 'reviewed'").count() == 1
    state.compact("status = 'reviewed'")
    assert state.read().count() == 199 and set(state._current().values()) == {3}
    state.compact("true")       # nothing came since
    assert state.read().count() == 199
    state.sync(appended(log(spark, [("g8", "dismissed", 2)]), source))
    assert state.read().count() == 199 and state.read().where("status = 'dismissed'").count() == 1


def test_feature_sync_reads_new_files_only_and_deletes(spark, stages):
    from itemweld.streaming import feature_sync

    def vectors(rows):
        return spark.createDataFrame([(i, "c", "m", v) for i, v in rows], "part_id string, part_category string, material string, feature_vector array<double>")

    feed, folder = stages.path("feed"), stages.path("served")

    def night(rows):
        state = feature_sync.served(spark, folder, 4)
        version = feature_sync.publish(vectors(rows), feed, state)
        did = state.sync(feed)
        return version, did.input_rows, {r.part_id: r.feature_vector for r in feature_sync.live(state).collect()}

    first = [(f"p{i}", [float(i), 0.0]) for i in range(50)]
    assert night(first) == (1, 50, dict(first))
    second = [("p0", [9.0, 9.0])] + first[2:] + [("q", [1.0, None])]
    assert night(second) == (2, 3, dict(second))        # one changed, one gone, one new
    assert night(second) == (3, 0, dict(second))
    state = feature_sync.served(spark, folder, 4)
    late = spark.createDataFrame([("p1", 1, "insert", "c", "m", [1.0, 0.0])],
                                 "part_id string, version bigint, op string, part_category string, material string, feature_vector array<double>")
    state.sync(appended(late, feed))
    assert "p1" not in {r.part_id for r in feature_sync.live(state).collect()}     # the tombstone holds
    assert state.read().where("op = 'delete'").count() == 1
    state.compact("op = 'delete' AND version < 3")
    assert state.read().where("op = 'delete'").count() == 0 and night(second)[1:] == (0, dict(second))


def test_assignments_are_trimmed_and_not_empty(spark, stages):
    rows = [("a", "  X-1 ", "u", T0, "n", 1), ("a", "   ", "u", T0 + dt.timedelta(days=1), "n", 2), ("b", None, "u", T0, "n", 3)]
    df = spark.createDataFrame(rows, "group_id string, enterprise_part_number string, assigned_by string, "
                                     "assigned_at timestamp, notes string, seq bigint")
    state = R.assignment_state(spark, stages.path("state"), df.schema, 4)
    state.sync(appended(df, stages.path("log")))
    assert [r.enterprise_part_number for r in state.read().collect()] == ["X-1"]
    assert sorted(r.seq for r in state.read_rejects().collect()) == [2, 3]


def test_handled_groups_do_not_resurface(spark):
    ws = workspace(spark, "/root/testdata/sf0.001")
    handled = {r.group_id for r in ws.reviews.where("status <> 'new'").collect()}
    assert handled
    left = {r.group_id for r in R.suppress_reviewed(ws.groups, ws.reviews).collect()}
    queue = {r.group_id for r in serving.default_queue(
        ws.groups, ws.serving_members, ws.serving_offers, ws.reviews, ws.assignments).collect()}
    assert not handled & left and not handled & queue
    assert left | handled >= {r.group_id for r in ws.groups.collect()}


def test_round_trip_keeps_every_review(spark):
    ws = workspace(spark, "/root/testdata/sf0.001")
    r = Q.review_roundtrip(R.valid_reviews(ws.review_log), ws.reviews).first()
    assert r.groups > 0 and (r.lost, r.invented, r.stale) == (0, 0, 0)


def test_no_group_mixes_blocks_and_part_numbers_repeat(spark):
    ws = workspace(spark, "/root/testdata/sf0.01")
    assert Q.block_purity(ws.members, ws.parts).first().mixed_groups == 0
    # The same number on different parts, which matching never joins on.
    assert ws.parts.groupBy("part_number").agg(F.count_distinct("model_id").alias("m")).where("m > 1").count() > 0


def test_withdrawn_assignment_clears_the_back_reference(spark):
    parts = spark.createDataFrame([("p", "old"), ("q", None)], "part_id string, normalized_part_id string")
    members = spark.createDataFrame([("g", "p"), ("h", "q")], "group_id string, part_id string")
    now = spark.createDataFrame([("h",)], "group_id string")
    got = {r.part_id: r.normalized_part_id for r in R.apply_normalized_ids(parts, members, now).collect()}
    assert got == {"p": None, "q": "h"}


def test_page_bounds(spark):
    rows = spark.range(600).select(F.col("id").cast("string").alias("group_id"), F.lit(1.0).alias("savings_potential"))
    assert serving.queue_page(rows, limit=10_000).count() == 500
    assert serving.queue_page(rows, limit=-3).count() == 1
    assert serving.queue_page(rows, sort="no such column", limit=5, offset=598).count() == 2


def test_round_trip_sees_altered_columns(spark):
    import datetime

    from itemweld.operators import quality as Q
    t = datetime.datetime(2024, 1, 1)
    schema = "group_id string, status string, reviewer string, notes string, updated_at timestamp"
    log = spark.createDataFrame([("a", "reviewed", "r", "n", t), ("b", "new", "r", None, t)], schema)
    state = spark.createDataFrame([("a", "dismissed", "r", "n", t), ("b", "new", "r", None, t)], schema)
    assert tuple(Q.review_roundtrip(log, log).first()) == (2, 0, 0, 0, 0)
    assert tuple(Q.review_roundtrip(log, state).first()) == (2, 0, 0, 0, 1)


def test_categories_without_labels_stay_and_fail_the_gate(spark):
    from itemweld.operators import evaluation as EV
    parts = spark.createDataFrame([("p", "A"), ("p-D", "A"), ("q", "B")], "part_id string, part_category string")
    truth = spark.createDataFrame([("p", "p-D", "duplicate", "A")], "base_part_id string, variant_part_id string, relationship string, part_category string")
    members = spark.createDataFrame([("g", "p"), ("g", "p-D")], "group_id string, part_id string")
    got = {r.part_category: r for r in EV.metrics(truth, members, parts).collect()}
    assert got["A"].recall == 1.0 and got["B"].recall is None and got["B"].dup_total == 0
    assert {r.part_category: r.passed for r in EV.gate(EV.metrics(truth, members, parts)).collect()} == {"A": True, "B": False}
