"""Session with the settings the engine's semantics rest on: UTC, ANSI casts, adaptive plans."""

from pyspark.sql import SparkSession


def session(name: str = "loomscan", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
