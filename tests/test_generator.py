"""Generated rows against their SQL for keys that the smallest tables do not hold."""

import os

import duckdb
import pytest
from compare import rows_of

from __spark_entry__ import oracle_sql
from itemweld import registry
from itemweld.plans.workspace import Workspace

# Keys whose weight lies just below a half of its last digit, and some more, 31479 among them, that share weights.
KEYS = [80957, 66005, 31437, 96141, 76503, 117748, *range(7, 33_000, 8)]


@pytest.mark.parametrize("name", ["gen_base_parts", "gen_supplier_offers", "gen_best_offers"])
def test_weights_are_rounded_once(spark, tmp_path, name):
    spark.createDataFrame([(k,) for k in KEYS], "p_partkey long").write.parquet(os.path.join(tmp_path, "part.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    theirs = con.execute(oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert rows_of(columns, theirs.fetchall()) == rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_seeding_rows_stores_only_what_they_need(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(200)], "p_partkey long").write.parquet(os.path.join(tmp_path, "part.parquet"))
    ws, saved = Workspace(spark, str(tmp_path)), []
    keep = ws.stages.save
    ws.stages.save = lambda df, name, **options: saved.append(name) or keep(df, name, **options)
    registry.seed_near_misses(ws).collect()
    assert saved == ["g_base"]
    registry.gen_description(ws).collect()
    assert saved == ["g_base", "g_parts"]
