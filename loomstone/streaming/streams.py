"""Streaming forms of the operators: monitors, incremental deduplication, running counts, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.operators.dedup import bands, content_key, greedy_keep, signatures, similar_pairs, similarity
from loomstone.session import cut

LATE = "1 day"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A parquet table as a file stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a table may be a folder of files or one file, which a file stream takes as a pattern only
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/{name}.parque[t]")


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there and give its result as a table."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.table(name)


def drain_to(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream that only appends over what is there into a table of its own, none of which goes to the driver."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def alert_stream(events: DataFrame, most: float) -> DataFrame:
    """Rows of a log whose value is no number or above the limit."""
    kind = F.when(F.isnan("value"), "nan").when(F.col("value") > most, "diverging")
    return events.withColumn("alert", kind).where("alert is not null")


def running_counts(events: DataFrame, group: str) -> DataFrame:
    return events.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def tumbling(events: DataFrame, width: str, group: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    return timed.groupBy(F.window("ts", width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), group, "n")


def sessions(events: DataFrame, gap: str, user: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    found = timed.groupBy(F.session_window("ts", gap), user).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), user, "n")


def distinct_stream(documents: DataFrame, text: str) -> DataFrame:
    """The first copy of each text as it comes in, whatever its time; the key of every distinct text is kept as state, for as long as the stream has its checkpoint."""
    keyed = documents.where(F.col(text).isNotNull()).withColumn("key", content_key(F.col(text)))
    return keyed.dropDuplicates(["key"])


def stalled(events: DataFrame, group: str, seconds: int) -> DataFrame:
    """For each group the longest silence between two rows, kept as state across batches, and whether it exceeds the limit."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = sorted(t for b in batches for t in b["t"].tolist())
        last, gap = state.get if state.exists else (None, 0.0)
        for t in times:
            if last is not None and last > 0:
                gap = max(gap, t - last)
            last = t if last is None else max(last, t)
        state.update((last or 0.0, gap))
        yield pd.DataFrame({"grp": [key[0]], "gap": [gap], "stalled": [gap > seconds]})

    timed = events.select(F.col(group).cast("string").alias("grp"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    return timed.groupBy("grp").applyInPandasWithState(step, "grp string, gap double, stalled boolean", "last double, gap double", "update", GroupStateTimeout.NoTimeout)


def near_duplicate_batches(documents: DataFrame, key: str, text: str, index_path: str, verdicts_path: str) -> DataFrame:
    """Micro-batches filtered against the bands of all that was kept before.

    The index and the verdicts are tables with a part for each batch, which is
    written over if the batch is run again, and a batch is held against the parts
    of earlier batches only: a batch that broke off, wherever it did, gives the
    same rows when it is run again.
    """
    def parts(spark: SparkSession, epoch: int) -> list[str]:
        root = spark._jvm.org.apache.hadoop.fs.Path(index_path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return [f"{index_path}/{name}" for name in found if name.startswith("epoch=") and int(name[6:]) < epoch]

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        signed = signatures(batch.where(F.col(text).isNotNull()), key, text).persist()
        fresh = signed
        if earlier := parts(spark, epoch):
            index = spark.read.parquet(*earlier)
            own, old = bands(signed, key), bands(index, key).withColumnRenamed(key, "old")
            met = own.join(old, ["band", "bucket"]).select(key, "old").distinct()
            close = met.join(signed, key).join(index.select(F.col(key).alias("old"), F.col("signature").alias("s2")), "old").where(similarity(F.col("signature"), F.col("s2")) >= 0.8)
            fresh = signed.join(close.select(key).distinct(), key, "left_anti")
        # a checkpoint, as a cached table that reads the index would be read anew once the index grows
        fresh = cut(fresh)
        kept = cut(greedy_keep(fresh, similar_pairs(fresh, key), key))
        kept.write.mode("overwrite").parquet(f"{index_path}/epoch={epoch}")
        kept.select(key).write.mode("overwrite").parquet(f"{verdicts_path}/epoch={epoch}")
        signed.unpersist()

    query = documents.writeStream.foreachBatch(one).option("checkpointLocation", f"{verdicts_path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return documents.sparkSession.read.parquet(verdicts_path).select(key)
