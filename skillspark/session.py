"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Keys that an operator may split out of a shuffle, at least; more where there are more shuffle partitions.
MAX_HEAVY_KEYS = 256
#: Estimates beyond this size (in bits) say nothing and would grow with every join of an iteration.
MAX_ESTIMATE_BITS = 60


def build_session(app: str = "skillspark", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that a cluster would get from its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A plain table for work that is dear per row: a small one that lies in fewer pieces than there are cores is dealt out to all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def max_heavy_keys(spark: SparkSession) -> int:
    """How many keys may be split out of a shuffle: a key with less than this part of all rows fits a task of the shuffle."""
    return max(MAX_HEAVY_KEYS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names; sets a temporary one where none is named, which only a local master may use."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[\d*, ]+\])?", sc.master):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skillspark-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, ends the lineage of iterative plans.

    A checkpoint keeps the size that was estimated for its plan, and a join
    multiplies the estimates of its sides. Where the estimate has left the range
    of real sizes it is dropped, so that adaptive execution goes by what it measures.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    if int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() <= MAX_ESTIMATE_BITS:
        return out
    plain = spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False)
    return DataFrame(plain, spark)
