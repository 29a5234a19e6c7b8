"""Session settings shared by the tests and the bench script, and staging in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints, or None when it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def staged(df: DataFrame) -> DataFrame:
    """Write a frame that several branches of a plan read, and go on from the written table.

    Branches that need different columns cannot share a shuffle, so without this
    each of them would repeat the work below. The table lies in the shared folder
    and outlives lost executors. Where no folder is named (tests), the frame stays lazy.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
