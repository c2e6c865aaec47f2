"""The published catalogue size and totals (about a minute; RUN_PUBLISHED=1)."""

import os

import pytest

from itemweld.plans import jobs, matching
from itemweld.sources.staging import Stages


@pytest.mark.skipif(not os.environ.get("RUN_PUBLISHED"), reason="set RUN_PUBLISHED=1")
def test_published_totals(spark, stages):
    store = jobs.Store(spark, stages.path("facts"))
    jobs.generate(store, spark.range(185_000))
    truth = {r.relationship: r["count"] for r in store.read("ground_truth").groupBy("relationship").count().collect()}
    assert truth["duplicate"] == 9329
    built = matching.build(store.read("parts"), store.read("models"), store.read("supplier_catalogs"),
                           Stages(spark, "published"), method="grid", digits=None)
    assert built.groups.count() == 24_987 and built.members.count() == 65_251
    assert built.groups.selectExpr("round(sum(savings_potential), 2)").first()[0] == 36_112_562.69
