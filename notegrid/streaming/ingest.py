"""Extension: keep extracted rows of changed notes up to date with Structured Streaming.

A stream of note versions (title, ctx, md_text, version) is parsed batch by
batch; each batch replaces the parsed rows of its notes in a versioned Parquet
log, and ``current`` reads the newest version of each. A batch that runs again
writes the same rows to the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from notegrid.operators import extract


def follow(versions: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    def put(batch: DataFrame, number: int) -> None:
        newest = extract.with_key(batch).groupBy("key").agg(F.max(F.struct("version", "md_text")).alias("x")).select("key", "x.version", "x.md_text")
        parsed = extract.parse(newest, *extract.ALL, keep=("version",))
        parsed.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    w = versions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed rows of the newest version of each note."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("key").agg(F.max_by(F.struct("refs", "headings", "code", "tasks", "images"), F.struct("version", "batch")).alias("x")).select("key", "x.*")


def tag_activity(versions: DataFrame, at: str = "changed_at", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Uses of each tag per window of event time; later than the watermark is dropped."""
    parsed = extract.parse(extract.with_key(versions), "tags", keep=(at,))
    rows = extract.refs(parsed, "tag", keep=(at,)).withColumn("at", F.col(at).cast("timestamp"))
    return rows.withWatermark("at", late).groupBy(F.window("at", width), F.col("dst_name").alias("tag")).agg(F.count("*").alias("n"))
