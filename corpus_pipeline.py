"""The corpus pipeline: five stages, each on all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it again for the next one. All but the last return the columns
of documents. Columns are never added to or dropped from the documents on the way, and a
table without rows passes through every stage. A stage drops the working tables of those before it, so
a stage's result is to be stored before the next one is called, as ``run`` does.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from itemweld.llm import langid, linededup, neardup, packing, quality
from itemweld.llm.common import table
from itemweld.sources.staging import Stages


_working = {}      # application -> working tables of its latest stages


def working(spark: SparkSession, docs: DataFrame, label: str) -> Stages:
    """Working tables for a stage. Those of the stages before go now: their results are stored and ``docs`` is
    such a result, read again. Tables that ``docs`` still reads itself stay."""
    app, files = spark.sparkContext.applicationId, docs.inputFiles()
    read = [old for old in _working.get(app, []) if any(f"/{old.folder.rsplit('/', 1)[1]}/" in f for f in files)]
    for old in _working.get(app, []):
        if old not in read:
            old.drop()
    _working[app] = [*read, Stages(spark, label)]
    return _working[app][-1]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained quality classifier rejects: probability of good below one half,
    or nothing but white space."""
    working(spark, docs, "quality")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("quality_view.keep").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose languages' encodings are too near to call."""
    working(spark, docs, "language")
    known = langid.learn(docs)
    return langid.identify(docs, known).where("language.accepted").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later similar lines out of the texts; n_chars follows the text. Documents left without text go."""
    cleaned = linededup.dedup_lines(docs, stages=working(spark, docs, "lines"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return cleaned.select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of smallest doc_id. Rows that repeat a doc_id are documents of
    their own, each judged by its text: they get ids of their own behind all others for the search. Null ids
    and texts without words stay; long texts are compared whole."""
    stages = working(spark, docs, "near_duplicates")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        found = neardup.near_duplicates(docs, stages=stages)
        return docs.join(found.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    row = "_row" + "_" * max(map(len, docs.columns))
    last = docs.agg(F.max("doc_id")).first()[0]
    once = docs.join(repeated, "doc_id", "left_anti").withColumn(row, F.col("doc_id").cast("long"))
    more = docs.join(repeated, "doc_id", "left_semi").withColumn(row, F.lit(last) + 1 + F.monotonically_increasing_id())
    keyed = stages.save(once.unionByName(more), "keyed")
    found = neardup.near_duplicates(keyed, doc_id=row, stages=stages)
    gone = found.where("NOT kept").select(F.col("doc_id").alias(row))
    return keyed.join(gone, row, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents along the Hilbert curve into sequences of 2048 ids."""
    return packing.pack(docs, stages=working(spark, docs, "packing"))


STAGES = [("quality", quality_stage), ("language", language_stage), ("lines", line_stage),
          ("near_duplicates", neardup_stage), ("packing", packing_stage)]
# The classifiers and the tokenizer can't be put in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stages.save(stage(spark, docs, sf_dir), name)
    return docs


QUERIES, SQL = {"pipeline": run}, {}
