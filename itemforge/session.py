"""Session helper for scripts and tests; library code always takes a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "itemforge", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that the library is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
