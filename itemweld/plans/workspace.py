"""All tables of one catalogue, each built once per session and then read back.

This is how the job runs in production too: master tables, match facts and
review state are stored, and every report or queue reads the stored tables.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from itemweld import session
from itemweld.operators import crowds, economics as E, evaluation as EV, neighbors as N, review as R
from itemweld.plans import matching, serving
from itemweld.schema import MATCH_DISTANCE
from itemweld.sources import orders_catalog as OC
from itemweld.sources.staging import Stages

WIDE_DISTANCE = 0.3     # listing radius for calibration and review bands
STATE_BUCKETS = 8       # of the review states of a workspace


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        session.tune(spark)
        self.spark = spark
        self.src = OC.SalesTables(spark, folder)
        self.stages = Stages(spark, "catalogue")

    def _save(self, df, name):
        return self.stages.save(df, name)

    # master tables
    @cached_property
    def plants(self):
        return OC.plants(self.src)

    @cached_property
    def models(self):
        return OC.models(self.src)

    @cached_property
    def suppliers(self):
        return OC.suppliers(self.src)

    @cached_property
    def parts(self):
        return self._save(OC.parts(self.src), "parts")

    @cached_property
    def offers(self):
        return self._save(OC.offers(self.src, self.parts), "offers")

    @cached_property
    def truth(self):
        return self._save(EV.ground_truth(self.parts, OC.LABEL_OF_SUFFIX), "ground_truth")

    # features and pairs
    @cached_property
    def features(self):
        return matching.build_features(self.parts, self.stages)

    @property
    def stats(self):
        return self.features[0]

    @property
    def vectors(self):
        return self.features[1]

    @cached_property
    def _points(self):
        return matching.build_points(self.vectors, self.stats, self.stages)

    @property
    def points(self):
        return self._points[0]

    @property
    def size(self):
        return self._points[1]

    @cached_property
    def folded(self):
        return matching.fold(self.points, self.stages)

    @cached_property
    def bands(self):
        return self._save(N.plan_bands(self.folded, MATCH_DISTANCE), "bands")

    @cached_property
    def folded_pairs(self):
        return matching.find_pairs(self.folded, self.size, self.stages, bands=self.bands)

    @cached_property
    def copies(self):
        return self._save(N.copies_of(self.points, self.folded), "copies")

    @cached_property
    def pairs(self):
        return self._save(N.unfold_pairs(self.folded_pairs, self.copies, self.stages), "pair_list")

    @cached_property
    def wide_folded_pairs(self):
        return matching.find_pairs(self.folded, self.size, self.stages, WIDE_DISTANCE)

    @cached_property
    def wide_pairs(self):
        return self._save(N.unfold_pairs(self.wide_folded_pairs, self.copies, self.stages), "wide_pair_list")

    # match facts
    @cached_property
    def labels(self):
        crowded = crowds.is_crowded(self.folded, self.bands, MATCH_DISTANCE)
        return matching.label_parts(self.points, self.folded, None if crowded else self.folded_pairs,
                                    self.size, self.stages)

    @cached_property
    def members(self):
        return matching.build_members(self.labels, self.parts, self.models, self.stages)

    @cached_property
    def groups(self):
        return matching.build_groups(self.members, self.parts, self.offers, self.stages)

    @cached_property
    def priced(self):
        return self._save(E.priced_members(self.members, self.parts, self.offers), "priced")

    @cached_property
    def eval_metrics(self):
        return self._save(EV.metrics(self.truth, self.members, self.parts), "eval_metrics")

    # serving models
    @cached_property
    def serving_members(self):
        return self._save(serving.serve_members(self.members, self.parts, self.offers), "serve_members")

    @cached_property
    def serving_offers(self):
        return self._save(
            serving.serve_supplier_offers(self.offers, self.suppliers, self.members), "serve_offers")

    # review state, folded from the logs by streams
    @cached_property
    def review_log(self):
        return self._save(OC.review_log(self.src, self.members), "review_log")

    @cached_property
    def assignment_log(self):
        return self._save(OC.assignment_log(self.review_log), "assignment_log")

    def _kept(self, made, log):
        made.sync(self.stages.location(log))
        return made

    @cached_property
    def review_state(self):
        return self._kept(R.review_state(self.spark, self.stages.path("reviews"), self.review_log.schema, STATE_BUCKETS), self.review_log)

    @cached_property
    def reviews(self):
        return self.review_state.read()

    @cached_property
    def assignments(self):
        return self._kept(R.assignment_state(self.spark, self.stages.path("assignments"), self.assignment_log.schema, STATE_BUCKETS),
                          self.assignment_log).read()

    @cached_property
    def normalized(self):
        return self._save(R.normalized_parts(self.assignments, self.groups), "normalized_parts")

    def queue(self, **filters):
        return serving.queue(self.groups, self.serving_members, self.serving_offers,
                             self.reviews, self.assignments, **filters)


_open = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """The session's workspace for a folder of sales tables."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Workspace(spark, folder)
    return _open[key]
