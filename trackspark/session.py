"""Session settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with DEFAULTS; `extra` overrides with `spark_sql_x_y` spelled `spark.sql.x.y` by the caller's dict."""
    b = SparkSession.builder.appName("trackspark")
    if master:
        b = b.master(master)
    conf = DEFAULTS | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | extra
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
