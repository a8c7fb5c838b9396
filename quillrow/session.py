"""Make a session ready for the row format."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillrow.runtime import ship
from quillrow.sources.container_source import RowContainerSource


def install(spark: SparkSession) -> SparkSession:
    """Registers the data source, lets workers have this package's code, and turns TIME columns on."""
    ship()
    spark.dataSource.register(RowContainerSource)
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return spark
