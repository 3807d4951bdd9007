"""Folders written once by one batch each, ``<name>=<batch id>``; one counts once Spark has marked it complete."""

from __future__ import annotations

from pyspark.sql import SparkSession


def complete(spark: SparkSession, folder: str, name: str = "v") -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(
        int(s.getPath().getName()[len(name) + 1 :])
        for s in fs.listStatus(path)
        if s.getPath().getName().startswith(f"{name}=")
        and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    )
