import pytest
from pyspark.sql import functions as F

from itemweld.operators import economics as E
from itemweld.schema import TABLES, conform
from itemweld.sources import generator as G, staging
from itemweld.sources.tables import BrokenConstraint, read_table, write_bucketed, write_checked, write_table
from itemweld.streaming.kept_state import Folder


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_formats_round_trip(spark, stages, format):
    df = spark.createDataFrame([("s1", "A", "North"), ("s2", None, "South")], TABLES["suppliers"])
    path = stages.path("table")
    for _ in range(2):      # overwrite, not append
        write_table(df.select("region", "supplier_id", "supplier_name"), path, table="suppliers", format=format)
    back = read_table(spark, path, format=format, schema=TABLES["suppliers"], columns=["supplier_id", "region"])
    assert sorted(map(tuple, back.collect())) == [("s1", "North"), ("s2", "South")]


def test_conform_goes_by_name(spark):
    got = conform(spark.createDataFrame([("7", "p1", "x")], "hole_count string, part_id string, other string"), "parts")
    assert got.columns == TABLES["parts"].names and got.first().hole_count == 7 and got.first().weight is None


def test_bucketed_tables_join_without_exchange(spark):
    spark.sql("DROP TABLE IF EXISTS bucketed_a")
    spark.sql("DROP TABLE IF EXISTS bucketed_b")
    for name in ("bucketed_a", "bucketed_b"):
        write_bucketed(spark.range(1000).withColumn("x", F.col("id") % 7), name, "id", 4)
    joined = spark.table("bucketed_a").hint("merge").join(spark.table("bucketed_b"), "id")
    assert "Exchange" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert joined.count() == 1000
    spark.sql("DROP TABLE bucketed_a")
    spark.sql("DROP TABLE bucketed_b")


class _Session:
    """A session with the given settings, as far as `stage_root` looks."""

    def __init__(self, master, **settings):
        self.conf = self
        self.sparkContext = self
        self.master, self.applicationId, self.settings = master, f"app-{master}", settings

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_stage_root_comes_from_the_session():
    shared = {"spark.checkpoint.dir": "hdfs://shared/cp/"}
    assert staging.stage_root(_Session("yarn", **shared)) == "hdfs://shared/cp"
    assert staging.stage_root(_Session("local[8]", **shared)) == "hdfs://shared/cp"
    assert staging.stage_root(_Session("local[8]")).startswith("/")
    with pytest.raises(ValueError):
        staging.stage_root(_Session("yarn"))


def test_generated_catalogue(spark, stages):
    parts = stages.save(G.parts(spark.range(4000), stages), "parts")
    again = G.parts(spark.range(4000).repartition(3), stages)
    assert parts.exceptAll(again).isEmpty()
    suffix = {r.s: r["count"] for r in parts.groupBy(F.regexp_extract("part_id", "-([A-Z])$", 1).alias("s")).count().collect()}
    assert suffix[""] == 4000 and 120 < suffix["D"] < 280 and suffix["H"] > 40 and suffix["N"] > 15
    offers = G.offers(parts, stages)
    assert offers.groupBy("part_id").count().agg(F.min("count"), F.max("count")).first()[:] == (1, 3)
    moved = (parts.alias("d").join(parts.alias("b"), F.col("d.part_id") == F.concat("b.part_id", F.lit("-D")))
             .where("d.model_id = b.model_id").count())
    assert moved == 0
    assert G.models(G.plants(spark)).count() == 16


def test_unpriced_members_do_not_count(spark):
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "group_id string, part_id string")
    parts = spark.createDataFrame([("a", 10), ("b", 5), ("c", 100)], "part_id string, annual_volume int")
    offers = spark.createDataFrame([("a", 4.0, 0.5), ("a", 9.0, None), ("b", 1.0, None)],
                                   "part_id string, price_per_unit double, unit_discount double")
    r = E.group_savings(E.priced_members(members, parts, offers)).first()
    assert (r.group_best_price, r.total_current_spend, r.savings_potential) == (1.0, 25.0, 10.0)


def test_ids_beyond_seven_digits_stay_apart(spark):
    ids = spark.createDataFrame([(i,) for i in (7, 1_000_000, 9_999_999, 10_000_000, 10_000_001, 3_000_000_000, 3_000_000_001)], "id long")
    got = {r.part_id: r.part_number for r in G.base_parts(ids).select("part_id", "part_number").collect()}
    assert set(got) == {"P0000007", "P1000000", "P9999999", "P10000000", "P10000001", "P3000000000", "P3000000001"}


def test_checked_write_keeps_the_old_table(spark, stages):
    place = stages.path("checked") + "/models"
    kind = "model_id string, plant_id string, machine_type string, model_name string"
    plants = spark.createDataFrame([("p1",), ("p2",)], "plant_id string")
    put = lambda rows, **more: write_checked(spark.createDataFrame(rows, kind), place, "models", **more)     # noqa: E731
    held = lambda: sorted(r.model_id for r in spark.read.parquet(place).collect())     # noqa: E731
    put([("m1", "p1", "T", None), ("m2", "p2", "T", "x")], parents={"plants": plants})
    for rows, what in (([("m3", None, "T", None)], "plant_id: 1 null rows"), ([("m3", "p1", "T", "x")] * 2, "1 repeated keys"),
                       ([("m3", "p9", "T", "x")], "1 rows without their row in plants")):
        with pytest.raises(BrokenConstraint, match=what):
            put(rows, parents={"plants": plants})
        assert held() == ["m1", "m2"]
    write_checked(spark.read.parquet(place).where("model_id = 'm2'"), place, "models")        # reads what it replaces
    assert held() == ["m2"]
    folder = Folder(spark, place.rsplit("/", 1)[0])
    folder.rename("models", "_models-old")          # a run that ended between its renames
    with pytest.raises(BrokenConstraint):
        put([(None, "p1", "T", "x")])
    assert held() == ["m2"] and folder.names("") == ["models"]
    put([])
    assert held() == []
