"""Session settings the operators were planned for."""

from pyspark.sql import SparkSession

# Many-to-one joins in this package may meet a key that holds a large share of
# all rows. Their work is linear in bytes, so AQE's skew-join split is the right
# tool; "force" lets it split even where that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Stage tables are compressed files. Taken for their rows' size, many tables of several times the broadcast
    # threshold would go through the driver.
    "spark.sql.sources.fileCompressionFactor": "8",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores="*", shuffle_partitions=8, app="itemweld", **conf) -> SparkSession:
    """A session for tests and single-machine runs."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
