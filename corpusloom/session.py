"""The session's settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benchmarks. A cluster brings its own."""
    build = SparkSession.builder.master(f"local[{cpus}]").appName("corpusloom").config("spark.ui.enabled", "false")
    build = build.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    build = build.config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "512k")  # small tables still use every core
    for k, v in SETTINGS.items():
        build = build.config(k, v)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
