"""Headline timings: prints one JSON line.

The match build is timed stage by stage, each stage from the stored result of the
one before; the report queries are timed on the stored facts, as in production.
``published_build`` builds the 185,000-part generated catalogue end to end.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from itemweld import registry  # noqa: E402
from itemweld.plans import matching  # noqa: E402
from itemweld.plans.workspace import workspace  # noqa: E402
from itemweld.session import local_session  # noqa: E402
from itemweld.sources import generator as G  # noqa: E402
from itemweld.sources.staging import Stages  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
STAGES = ["parts", "offers", "vectors", "points", "folded", "folded_pairs", "labels", "members", "groups",
          "eval_metrics", "serving_members", "serving_offers", "reviews", "assignments"]
REPORTS = ["near_pairs_exact", "near_pairs_grid", "knn_topk", "find_similar", "size_percentile",
           "group_savings", "match_groups", "eval_violations", "queue_default", "queue_by_supplier",
           "offer_price_gap", "dash_kpi", "dash_by_span", "parts_dup_other_plant", "gen_supplier_offers"]


def run(frame):
    frame.write.format("noop").mode("overwrite").save()


def published(spark):
    stages = Stages(spark, "published")
    t0 = time.time()
    models = stages.save(G.models(G.plants(spark)), "models")
    parts = stages.save(G.parts(spark.range(185_000), stages), "parts")
    offers = stages.save(G.offers(parts, stages), "offers")
    t1 = time.time()
    grid = matching.build(parts, models, offers, stages, method="grid", digits=None)
    t2 = time.time()
    exact = matching.build(parts, models, offers, stages)
    t3 = time.time()
    facts = {"groups": grid.groups.count(), "grouped_parts": grid.members.count(),
             "savings": grid.groups.selectExpr("round(sum(savings_potential), 2)").first()[0],
             "exact_groups": exact.groups.count()}
    return {"published_generate": t1 - t0, "published_match_grid": t2 - t1, "published_match_exact": t3 - t2}, facts


def main():
    spark = local_session(CPUS, shuffle_partitions=max(8, int(CPUS) if CPUS.isdigit() else 8), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    ws, took = workspace(spark, FOLDER), {}
    for name in STAGES:
        t = time.time()
        getattr(ws, name)
        took[f"build_{name}"] = time.time() - t
    build = sum(took.values())
    for name in REPORTS:
        t = time.time()
        run(registry.QUERIES[name](spark, FOLDER))
        took[name] = time.time() - t
    total = sum(took.values())
    extra, facts = published(spark)
    took.update(extra)
    print(json.dumps({
        "metric": "match build and report queries", "value": round(total, 2), "unit": "sec",
        "build_sec": round(build, 2), "queries": {k: round(v, 2) for k, v in took.items()},
        "published": facts, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
