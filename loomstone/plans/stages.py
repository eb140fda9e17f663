"""Stages that write tables and are skipped once done."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Stage]], until: str | None = None) -> dict[str, DataFrame]:
    """Run each stage after the ones before it and give its table; a table that was written whole isn't made again.

    A stage's table is whole once Spark's commit marker is in its folder, so a run
    that broke off goes on with the stage it broke in.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    done: dict[str, DataFrame] = {}
    for name, build in stages:
        marker = path(f"{folder}/{name}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            build(spark, done).write.mode("overwrite").parquet(f"{folder}/{name}")
        done[name] = spark.read.parquet(f"{folder}/{name}")
        if name == until:
            break
    return done


def append_log(spark: SparkSession, path: str, **values: object) -> None:
    """One JSON row with the time of writing added to a log folder."""
    line = json.dumps({**values, "timestamp": time.time()}, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)
