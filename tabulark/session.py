"""Session helpers: a configured local session for tests/bench and the shared
checkpoint folder used to cut long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tabulark") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's session is used
    as-is; nothing here is required by the operators."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # a long-running driver keeps status history for every job; cap it
        .config("spark.ui.retainedJobs", "200")
        .config("spark.ui.retainedStages", "400")
        .config("spark.ui.retainedTasks", "20000")
        .config("spark.sql.ui.retainedExecutions", "100")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABULARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there. Only a local master may leave it
    unset: then a fresh temp folder is used. Elsewhere executors would each
    write to their own disk, so a missing setting is an error."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="tabulark-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, for several readers
    that each need few columns; any column names are kept."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    plain = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    kinds = [f.dataType.typeName() for f in df.schema.fields]
    plain = [c.cast("string") if k == "void" else c for c, k in zip(plain, kinds, strict=True)]
    df.select(*[c.alias(f"c{i}") for i, c in enumerate(plain)]).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
