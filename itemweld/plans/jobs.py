"""The batch jobs on stored tables, for an external scheduler.

Nightly order: `fold_reviews` where actions come as logs, `sync_reviews`, `match`, `evaluate`, `sync_facts`,
`sync_features`, `index_features`. Facts and review state are separate systems of record: `match` never writes
review tables and the review jobs never write match facts.
"""

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from itemweld import session
from itemweld.operators import crowds as K, economics as E, evaluation as EV, review as R
from itemweld.operators.neighbor_index import NeighborIndex
from itemweld.operators.neighbors import BLOCK
from itemweld.plans import matching, serving
from itemweld.schema import FEATURES, MATCH_DISTANCE, TABLES
from itemweld.sources import generator as G
from itemweld.sources.staging import Stages
from itemweld.sources.tables import read_table, write_checked, write_table
from itemweld.streaming import feature_sync


@dataclass
class Store:
    """Where tables live: a folder, or a database through ``options``.

    For a relational store use ``Store(spark, format="jdbc", options={"url": ...})``:
    the table name then goes into ``dbtable``. ``read_options`` and ``write_options`` add
    options per table, such as partitionColumn, lowerBound, upperBound and numPartitions for
    a parallel read or truncate for a write.
    """
    spark: SparkSession
    root: str | None = None
    format: str = "parquet"
    options: dict = field(default_factory=dict)
    read_options: dict = field(default_factory=dict)
    write_options: dict = field(default_factory=dict)

    def where(self, name, more):
        """Location and options of a table; ``more`` are the per-table ones."""
        options = {**self.options, **more.get(name, {})}
        if self.root is None:
            return None, {**options, "dbtable": name}
        return f"{self.root.rstrip('/')}/{name}", options

    def read(self, name, columns=None) -> DataFrame:
        location, options = self.where(name, self.read_options)
        schema = TABLES.get(name) if location else None
        return read_table(self.spark, location, format=self.format, columns=columns, schema=schema, **options)

    def write(self, df, name, table=None, parents=(), unique=True):
        """Replace a table. In a folder a declared table is replaced only by rows that keep its keys, its columns without
        nulls and its references to ``parents``, tables of this store; a database checks its own constraints."""
        location, options = self.where(name, self.write_options)
        if table is not None and location is not None:
            return write_checked(df, location, table, parents={p: self.read(p) for p in parents}, unique=unique, format=self.format, **options)
        write_table(df, location, table=table, format=self.format, **options)


def generate(store: Store, ids: DataFrame) -> None:
    """The synthetic catalogue for the given ids, all master tables replaced."""
    spark = session.tune(store.spark)
    with Stages(spark, "generate") as stages:
        store.write(G.plants(spark), "plants", "plants")
        store.write(G.models(G.plants(spark)), "models", "models", ["plants"])
        store.write(G.suppliers(spark.range(G.SUPPLIER_COUNT)), "suppliers", "suppliers")
        store.write(G.parts(ids, stages), "parts", "parts", ["models"])
        parts = store.read("parts")
        store.write(EV.ground_truth(parts, G.LABEL_OF_SUFFIX), "ground_truth", "ground_truth", ["parts"])
        # A supplier may offer a part more than once; the cheapest offer is the one served.
        store.write(G.offers(parts, stages), "supplier_catalogs", "supplier_catalogs", ["suppliers", "parts"], unique=False)


def match(store: Store, radius=MATCH_DISTANCE, method="exact", digits=6, features=FEATURES,
          crowd_work=K.CROWD_WORK, currency=None) -> None:
    """The match facts. Offers in several currencies need ``currency``, the one to price in."""
    offers = E.one_currency(store.read("supplier_catalogs"), currency)
    with Stages(session.tune(store.spark), "match") as stages:
        built = matching.build(store.read("parts"), store.read("models"), offers,
                               stages, radius, method, digits, features, crowd_work)
        store.write(built.stats, "feature_stats", "feature_stats")
        store.write(built.vectors, "part_features", "part_features")
        store.write(built.members, "match_group_members", "match_group_members")
        store.write(built.groups.withColumn("generated_at", F.current_timestamp()), "match_groups", "match_groups")


def evaluate(store: Store) -> None:
    found = EV.metrics(store.read("ground_truth"), store.read("match_group_members"), store.read("parts"))
    store.write(found.withColumn("evaluated_at", F.current_timestamp()), "eval_metrics", "eval_metrics")


def sync_facts(store: Store, serving_store: Store, currency=None) -> None:
    """The read models, each replaced, and the groups that still await a review: those
    that a person handled are left out of ``open_match_groups``."""
    members, parts = store.read("match_group_members"), store.read("parts")
    offers = E.one_currency(store.read("supplier_catalogs"), currency)
    groups = serving.serve_match_groups(store.read("match_groups"))
    serving_store.write(groups, "match_groups")
    try:
        reviews = store.read("review_dispositions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        reviews = store.spark.createDataFrame([], TABLES["review_dispositions"])       # no review was ever synced
    serving_store.write(R.suppress_reviewed(groups, reviews), "open_match_groups")
    serving_store.write(serving.serve_members(members, parts, offers), "match_group_members")
    serving_store.write(serving.serve_supplier_offers(offers, store.read("suppliers"), members), "supplier_offers")


def sync_reviews(serving_store: Store, store: Store) -> None:
    """Review state to the analytic side. Normalised numbers go to a table of their own,
    ``part_numbers``: the parts master table is never rewritten."""
    with Stages(session.tune(store.spark), "reviews") as stages:
        store.write(serving_store.read("review_dispositions"), "review_dispositions", "review_dispositions")
        assigned = stages.save(serving_store.read("normalized_assignments"), "assigned")
        store.write(R.normalized_parts(assigned, store.read("match_groups")), "normalized_parts", "normalized_parts")
        numbered = R.apply_normalized_ids(store.read("parts"), store.read("match_group_members"), assigned)
        store.write(numbered.where("normalized_part_id IS NOT NULL").select("part_id", "normalized_part_id"), "part_numbers")


def fold_reviews(serving_store: Store, buckets=64) -> dict:
    """Work off what was appended to the folders ``review_log`` and ``assignment_log`` since the last run:
    ``review_dispositions`` and ``normalized_assignments`` become the latest valid rows, the ``_rejects`` tables what broke
    the rules. The states stay beside the tables, so a restart replays nothing. Returns what each run read."""
    spark, did = session.tune(serving_store.spark), {}
    for log, table, made, order in (("review_log", "review_dispositions", R.review_state, "updated_at"),
                                    ("assignment_log", "normalized_assignments", R.assignment_state, "assigned_at")):
        schema = StructType([*TABLES[table].fields, StructField("seq", LongType())])
        state = made(spark, f"{serving_store.root.rstrip('/')}/{log}_state", schema, buckets)
        did[log] = state.sync(f"{serving_store.root.rstrip('/')}/{log}")
        serving_store.write(state.read().select(*TABLES[table].names), table, table)
        serving_store.write(state.read_rejects(), f"{log}_rejects")
    return did


def sync_features(store: Store, serving_store: Store, buckets=64, forget=None):
    """Bring the served vectors in step with ``part_features``: only parts that changed go through the feed, only
    their buckets are rewritten. With ``forget`` tombstones of versions up to it are dropped. Returns what the run read."""
    root = serving_store.root.rstrip("/")
    state = feature_sync.served(session.tune(store.spark), f"{root}/served_features", buckets)
    feature_sync.publish(store.read("part_features"), f"{root}/feature_feed", state)
    did = state.sync(f"{root}/feature_feed")
    if forget is not None:
        state.compact(f"op = 'delete' AND version <= {int(forget)}")
    return did


def index_features(serving_store: Store, buckets=64) -> dict:
    """Bring the neighbour index beside the served vectors in step with them: the first run builds it, later ones
    compare it with the vectors and rewrite the files that hold a changed part. Run after ``sync_features``."""
    spark = session.tune(serving_store.spark)
    index, now = feature_index(serving_store), served_features(serving_store, buckets).select("part_id", *BLOCK, "feature_vector")
    if not index.exists():
        index.build(now)
        return {"written": index.manifest().select("file").distinct().count(), "replaced": 0}
    with Stages(spark, "index_features") as stages:
        return index.refresh(stages.save(feature_sync.changes(now, index.vectors(), 0), "changed"))


def feature_index(serving_store: Store) -> NeighborIndex:
    """The index for ``similar``, as the last ``index_features`` left it."""
    return NeighborIndex(serving_store.spark, f"{serving_store.root.rstrip('/')}/feature_index")


def served_features(serving_store: Store, buckets=64) -> DataFrame:
    """The vectors as the last ``sync_features`` left them."""
    return feature_sync.live(feature_sync.served(serving_store.spark, f"{serving_store.root.rstrip('/')}/served_features", buckets))


def numbered_parts(store: Store) -> DataFrame:
    """The parts with the normalised ids of the last ``sync_reviews``."""
    numbers = store.read("part_numbers")
    parts = store.read("parts").drop("normalized_part_id")
    return parts.join(numbers, "part_id", "left").select(*TABLES["parts"].names)
