"""Shared scratch tables for operators that need a materialised intermediate.

Intermediates are written as Parquet under the folder in ``spark.checkpoint.dir``, which every executor and
the driver share, so a lost executor costs nothing but the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session (tests) gets a temporary one where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Names and deletes the scratch tables of one operator call."""

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()
        Scratch.opened.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` once and return a frame that reads it back."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Write what an operator returns, and delete all tables that it came from."""
        done = self.table(df, name)
        if gone := self.names - {name}:
            self.drop(*gone)
        return done

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; with no names, all of them."""
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.names -= set(names or self.names)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables of every Scratch made inside it: write what is wanted of them before."""
    before = len(Scratch.opened)
    try:
        yield
    finally:
        for scratch in Scratch.opened[before:]:
            scratch.drop()
        del Scratch.opened[before:]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
