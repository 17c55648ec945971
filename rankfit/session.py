"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benches. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankfit")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names. Only a local session may do with a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor does not replay a long chain."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def short_values(df: DataFrame, columns: list[str], most: int = 10_000) -> list[tuple]:
    """Distinct values of dimension columns, sorted, on the driver; fails where there are more than a dimension may have."""
    rows = [tuple(r) for r in df.select(*columns).distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct values of {columns}: not a dimension")
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])
