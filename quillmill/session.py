"""Session settings used by the tests and the bench; a cluster brings its own."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "quillmill") -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # workers find the package whatever folder the driver runs in; on a cluster it is installed
        .config("spark.executorEnv.PYTHONPATH", str(Path(__file__).resolve().parent.parent))
        .getOrCreate()
    )
