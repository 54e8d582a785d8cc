"""Session factory and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def build(app: str = "arcspark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master gets a folder of its own where the setting is missing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"arcspark-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arcspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Remove everything this application put into the shared folder; for its end, as results may still be read from there before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/arcspark-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and return it as read from there.

    The copy survives the loss of executors, carries column statistics and
    holds no lineage, so later steps neither recompute nor reshuffle its inputs.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._arcspark_path = path
    return out


def counted(df: DataFrame, name: str, only: Column | None = None) -> tuple[DataFrame, int]:
    """materialize, and the number of its rows (for which only holds), counted while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1) if only is None else F.when(only, 1)).alias("n")), name)
    return out, seen.get["n"]


def forget(df: DataFrame) -> None:
    """Remove a copy made by materialize that nothing reads any more."""
    path = getattr(df, "_arcspark_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
