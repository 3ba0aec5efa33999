"""Session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # recording a call site per column expression takes longer than planning small queries
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# A key with more rows than this is "hot": its rows are spread over several tasks.
# At most (total rows / HOT_ROWS) keys can be hot, which bounds every broadcast of hot keys.
HOT_ROWS_KEY = "spark.dupeframe.hotRows"
HOT_ROWS = 1_000_000


def build_session(master: str | None = None, app: str = "dupeframe", **extra: str) -> SparkSession:
    """Get or create a session with ``SETTINGS``; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_KEY, str(HOT_ROWS)))
