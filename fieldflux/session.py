"""Session settings the operators profit from."""

from pyspark.sql import SparkSession

# Runtime settings: may be changed on a running session.
RUNTIME = {
    # The balance is a long flat projection.  A generated method above the JVM's limit for
    # compilation would run interpreted, many times slower than separate smaller methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    **RUNTIME,
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with these settings; on a cluster leave master and partitions to its own configuration."""
    builder = SparkSession.builder.appName("fieldflux")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Apply the runtime settings to a session built elsewhere, unless it names its own."""
    for k, v in RUNTIME.items():
        if spark.sparkContext.getConf().get(k) is None:
            spark.conf.set(k, v)
