"""Cutting a plan into tables that survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The plan so far as a table: a checkpoint in the shared folder if the session has one, else a cached one.

    Set ``spark.checkpoint.dir`` on a cluster; a cached table is computed anew where its executor is lost, and stays until the
    session's cache is cleared.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
