"""The stored-table jobs end to end, on generated parts."""

import datetime as dt

import pytest

from itemweld.operators import economics as E
from itemweld.plans import jobs
from itemweld.schema import TABLES


def test_nightly_cycle(spark, stages):
    store, side = jobs.Store(spark, stages.path("facts")), jobs.Store(spark, stages.path("serving"))
    jobs.generate(store, spark.range(3000))
    jobs.match(store)
    jobs.evaluate(store)
    jobs.sync_facts(store, side)
    groups = store.read("match_groups")
    first = {r.group_id: r.member_count for r in groups.collect()}
    assert first and side.read("match_groups").count() == len(first)
    assert store.read("match_groups").columns == TABLES["match_groups"].names
    assert min(r.recall for r in store.read("eval_metrics").collect()) == 1.0

    target, now = sorted(first)[0], dt.datetime(2024, 5, 1)
    side.write(spark.createDataFrame([(target, "reviewed", "u", "n", now)], TABLES["review_dispositions"]),
               "review_dispositions")
    side.write(spark.createDataFrame([(target, "EPN-1", "u", now, "n"), ("gone", "EPN-2", "u", now, "n")],
                                     TABLES["normalized_assignments"]), "normalized_assignments")
    jobs.sync_reviews(side, store)
    assert [r.status for r in store.read("review_dispositions").collect()] == ["reviewed"]
    assert [r.normalized_part_id for r in store.read("normalized_parts").collect()] == [target]
    marked = jobs.numbered_parts(store).where("normalized_part_id IS NOT NULL")
    assert marked.count() == first[target]

    jobs.sync_facts(store, side)
    assert {r.group_id for r in side.read("open_match_groups").collect()} == set(first) - {target}

    # A second night gives the same ids and leaves the review alone.
    jobs.match(store, crowd_work=0)     # this time by the path for crowded catalogues
    assert {r.group_id: r.member_count for r in store.read("match_groups").collect()} == first
    assert [r.group_id for r in store.read("review_dispositions").collect()] == [target]


def test_features_and_review_logs_go_on_where_they_stopped(spark, stages):
    store, side = jobs.Store(spark, stages.path("facts")), jobs.Store(spark, stages.path("serving"))
    vectors = [(f"p{i}", "A", "m", [float(i)]) for i in range(30)]
    store.write(spark.createDataFrame(vectors, TABLES["part_features"]), "part_features", "part_features")
    assert jobs.sync_features(store, side, 4).input_rows == 30
    store.write(spark.createDataFrame(vectors[1:] + [("q", "A", "m", [1.0])], TABLES["part_features"]), "part_features", "part_features")
    assert jobs.index_features(side) == {"written": 1, "replaced": 0}
    did = jobs.sync_features(store, side, 4)
    assert did.input_rows == 2 and did.buckets <= 2
    assert {tuple(r) for r in jobs.served_features(side).select("part_id", "version").collect()} == {(v[0], 1) for v in vectors[1:]} | {("q", 2)}
    assert jobs.sync_features(store, side, forget=2).input_rows == 0 and jobs.served_features(side).count() == 30
    assert jobs.index_features(side)["replaced"] == 1 and jobs.index_features(side) == {"written": 0, "replaced": 0}
    asked = side.spark.createDataFrame([("q", "A", "m", [1.0])], TABLES["part_features"])
    near = jobs.feature_index(side).similar(asked, 2, 1, stages).collect()
    assert [(r.neighbor_id, r.dist) for r in near] == [("p1", 0.0), ("p2", 1.0)]

    def act(rows):
        spark.createDataFrame(rows, "group_id string, status string, reviewer string, notes string, updated_at timestamp, seq bigint").write.mode("append").parquet(f"{side.root}/review_log")

    t = dt.datetime(2024, 5, 1)
    act([("g", "reviewed", "u", "n", t, 1), ("h", "archived", "u", "n", t, 2)])
    assert jobs.fold_reviews(side, 4)["review_log"].input_rows == 2
    act([("g", "dismissed", "u", "n", t, 3)])
    did = jobs.fold_reviews(side, 4)
    assert did["review_log"].input_rows == 1 and did["assignment_log"].input_rows == 0
    assert [(r.group_id, r.status) for r in side.read("review_dispositions").collect()] == [("g", "dismissed")]
    assert [r.group_id for r in side.read("review_log_rejects").collect()] == ["h"]


def test_options_per_table(spark):
    store = jobs.Store(spark, format="jdbc", options={"url": "u"}, read_options={"parts": {"numPartitions": "8", "partitionColumn": "n"}},
                       write_options={"parts": {"truncate": "true"}})
    assert store.where("parts", store.read_options) == (None, {"url": "u", "numPartitions": "8", "partitionColumn": "n", "dbtable": "parts"})
    assert store.where("parts", store.write_options)[1]["truncate"] == "true"
    assert store.where("models", store.read_options)[1] == {"url": "u", "dbtable": "models"}


def test_prices_of_one_currency_only(spark):
    offers = spark.createDataFrame([("s", "p", 10.0, "USD"), ("t", "p", 2.0, "EUR")], "supplier_id string, part_id string, price_per_unit double, currency string")
    with pytest.raises(ValueError):
        E.one_currency(offers)
    assert [r.price_per_unit for r in E.one_currency(offers, "USD").collect()] == [10.0]
    assert E.one_currency(offers.where("currency = 'EUR'")).count() == 1
