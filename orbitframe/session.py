"""Session settings the operators rely on."""

from pyspark.sql import SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot key of a join is split also where an aggregate by the same key follows
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # request filters: the last of repeated keys counts; the parser's default refuses such objects
    "spark.sql.variant.allowDuplicateKeys": "true",
    # session windows are merged inside each map task before the shuffle, so a
    # hot object ships sessions rather than rows
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # kept states time out with the next batch that has rows; with batches without rows, which a
    # timeout asks for without end, a stream of what is available now would never stop
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that change results or skew behaviour."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark

