"""Sessions with the settings that the engine expects."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "driftline", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map={**SETTINGS, **settings}).getOrCreate()
