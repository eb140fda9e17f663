"""Readers and writers of the text, JSONL and shard layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as T

SENTINEL = "<|doc|>"
SENTINEL_LINE = r"(?md)^[ \t]*<\|doc\|>[ \t]*$"
BLANK_LINES = r"\n[ \t]*(?:\n[ \t]*)+"


def blank_line_documents(texts: DataFrame, text: Column, keys: list[str], more_than: int = 50) -> DataFrame:
    """Blocks between blank lines, stripped, of more than so many characters: ``keys``, ``part`` from 1, ``text``."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    blocks = F.filter(F.transform(F.split(unix, r"\n[ \t]*(?:\n[ \t]*)+"), T.strip), lambda b: F.length(b) > more_than)
    return texts.select(*keys, F.posexplode(blocks).alias("part", "text")).withColumn("part", F.col("part") + 1)


def sentinel_documents(texts: DataFrame, text: Column, keys: list[str], least: int = 200) -> DataFrame:
    """Documents of the newer layout: up to the first sentinel blank lines part documents too, after it sentinels alone do. A sentinel is a line of its own; inside a line it is text."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    pieces = F.split(unix, SENTINEL_LINE)
    blocks = F.concat(F.split(F.element_at(pieces, 1), BLANK_LINES), F.slice(pieces, 2, F.size(pieces)))
    kept = F.filter(F.transform(blocks, lambda b: T.mend(T.strip(b))), lambda b: F.length(b) >= least)
    return texts.select(*keys, F.posexplode(kept).alias("part", "text")).withColumn("part", F.col("part") + 1)


def read_documents(spark: SparkSession, paths: list[str], sentinel: bool = False, more_than: int = 50, least: int = 200) -> DataFrame:
    """Documents of text files read in the order of ``paths``: ``path_rank``, ``path``, ``part``, ``text``; missing files are skipped.

    In the newer layout the sentinel line is the record separator, so that a file
    of any size is read in splits; each file's first record, up to its first
    sentinel, is parted at blank lines as in the older layout. Documents of fewer
    than ``least`` characters (older layout: not ``more_than``) are left out.
    The older layout needs whole files.
    """
    found: DataFrame | None = None
    for rank, path in enumerate(paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            continue
        if sentinel:
            rows = spark.read.option("lineSep", f"\n{SENTINEL}\n").text(path)
            rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
            head = rows.where("at = 0").groupBy("file").agg(F.min("n").alias("first"))
            named = rows.join(head, "file", "left").select("n", F.when(F.col("n") == F.col("first"), F.col("value")).otherwise(F.concat(F.lit(SENTINEL + "\n"), "value")).alias("value"))
            own = sentinel_documents(named, F.col("value"), ["n"], least)
            own = own.select(F.lit(rank).alias("path_rank"), F.lit(path).alias("path"), (F.col("n") * 1_000_000 + F.col("part")).alias("part"), "text")
        else:
            rows = spark.read.text(path, wholetext=True)
            own = blank_line_documents(rows.withColumns({"path_rank": F.lit(rank), "path": F.lit(path)}), F.col("value"), ["path_rank", "path"], more_than)
            own = own.withColumn("part", F.col("part").cast("bigint"))
        found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], "path_rank int, path string, part bigint, text string")


def read_jsonl(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """``text``, ``source`` and ``category`` of each line; lines that are no JSON, or hold less text, are skipped."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", "text string, source string, category string").alias("j")).select("j.*")
    return parsed.where(F.length(T.strip(F.col("text"))) >= least)


def read_log(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The last lines of a JSONL log as a training record each; broken lines are skipped."""
    schema = "step bigint, loss double, lr double, grad_norm double, tok_per_sec double, val_loss double, val_ppl double, timestamp double"
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    tail = rows.orderBy(F.desc("line")).limit(last)
    return tail.select("line", F.from_json("value", schema).alias("r")).select("line", "r.*").where("step is not null")


def write_documents(documents: DataFrame, path: str, text: str = "text", sentinel: bool = True) -> None:
    """Documents one after the other: each behind a sentinel line, or, in the older layout, before a blank line."""
    unix = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    value = F.concat(F.lit(SENTINEL + "\n"), unix) if sentinel else unix
    documents.where(F.col(text).isNotNull()).select(value.alias("value")).write.mode("overwrite").option("lineSep", "\n" if sentinel else "\n\n").text(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_shards(sequences: DataFrame, path: str, per_shard: int = 100_000) -> None:
    """Packed sequences with their masks in one row, so that the two can't part; at most so many a file."""
    sequences.write.mode("overwrite").option("maxRecordsPerFile", per_shard).parquet(path)


def read_shards(spark: SparkSession, path: str, length: int, tokens: str = "tokens", mask: str = "mask") -> DataFrame:
    """Sequences of a shard folder; a row whose tokens or mask have another length fails the read."""
    rows = spark.read.parquet(path)
    fits = (F.size(tokens) == length) & (F.size(mask) == length)
    return rows.where(F.when(fits, True).otherwise(F.raise_error(F.lit("a sequence and its mask must have the packed length")).cast("boolean")))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").schema("piece string, score double").csv(path)


def require_sources(documents: DataFrame, weights: DataFrame, source: str = "source") -> None:
    """Fail if a source with weight has no document."""
    missing = weights.where("weight > 0").join(documents.select(source).distinct(), source, "left_anti")
    names = [r[source] for r in missing.select(source).limit(20).collect()]
    if names:
        raise ValueError(f"no documents of {', '.join(names)}")
