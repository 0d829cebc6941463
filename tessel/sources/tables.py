"""Parquet tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """``<data_dir>/<name>.parquet``.  Projections and filters applied later reach the scan."""
    return spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))
