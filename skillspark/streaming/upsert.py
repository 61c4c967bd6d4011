"""The newest-crawl rule as a stream: every batch of JSON lines is folded into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skillspark.sources.feeds import line_key


def _version(path: str, batch: int) -> str:
    return f"{path}/v={batch:010d}"


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole versions of the table, oldest first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest version of the table, or the latest before a number; a version is whole or not there."""
    done = [v for v in versions(spark, path) if before is None or v < _version("", before).lstrip("/")]
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None


def write_version(df: DataFrame, path: str, keep: int = 2) -> None:
    """Adds df as the newest version of a table and removes all but the `keep` newest ones; a reader sees the old or the new table, never a part."""
    done = versions(df.sparkSession, path)
    df.write.mode("overwrite").parquet(_version(path, int(done[-1].removeprefix("v=")) + 1 if done else 0))
    prune(df.sparkSession, path, keep)


def prune(spark: SparkSession, path: str, keep: int) -> None:
    """Removes all but the `keep` newest whole versions."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in versions(spark, path)[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)


def fold(old: DataFrame | None, lines: DataFrame) -> DataFrame:
    """(raw_key, source, line, file, seq) with the row of the last file, and there the last line, of every key."""
    keyed = line_key(lines).select("raw_key", "source", "line", "file", "seq")
    every = keyed if old is None else old.select(keyed.columns).unionByName(keyed)
    return every.groupBy("raw_key").agg(F.max_by(F.struct("source", "line", "file", "seq"), F.struct("file", "seq")).alias("r")).select("raw_key", "r.*")


def stream_upsert(spark: SparkSession, lines_dir: str, table_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Folds new files of a directory into the table. A batch that runs again writes the same version again, so a failure loses or doubles nothing."""
    lines = spark.readStream.text(lines_dir).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("seq")
    )

    def write(batch: DataFrame, number: int) -> None:
        ordered = batch.where(F.trim("line") != "").withColumn("seq", F.col("seq") + F.monotonically_increasing_id())
        # a batch that runs again must not read the version that it writes again
        previous = current(batch.sparkSession, table_path, before=number)
        fold(previous, ordered).write.mode("overwrite").parquet(_version(table_path, number))
        prune(batch.sparkSession, table_path, 2)  # the one before stays for readers that have opened it

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def weekly_counts(postings: DataFrame, late: str = "7 days") -> DataFrame:
    """Postings per source and week of a stream with `crawled_at`; rows later than `late` are dropped by the watermark."""
    return postings.withWatermark("crawled_at", late).groupBy(F.window("crawled_at", "7 days"), "source").agg(F.count("*").alias("n"))

