"""Session defaults for local runs; a cluster brings its own settings."""
from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "curbcast", shuffle_partitions: int = 8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "12g")
            # Wide generated methods are compiled too, instead of being interpreted.
            .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
            .config("spark.ui.enabled", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.sql.streaming.stateStore.providerClass",
                    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
            .getOrCreate())
