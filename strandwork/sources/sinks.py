"""Writers: JSON logs, staged tables, keyed upserts, two targets in order."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def log_lines(rows: DataFrame, rounding: dict[str, int] | None = None) -> DataFrame:
    """`value`: a JSON object a row without null fields, with `timestamp` and `level` for the logger's own names, numbers rounded half-even."""
    names = {"asctime": "timestamp", "levelname": "level"}
    columns = [(F.bround(c, (rounding or {})[c]) if c in (rounding or {}) else F.col(c)).alias(names.get(c, c)) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def write_log(rows: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Append log lines in files of bounded length."""
    rows.write.mode("append").option("maxRecordsPerFile", per_file).text(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. Only a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Files and folders in a folder; none if there is no such folder."""
    p, fs = _fs(spark, path)
    return [str(f.getPath()) for f in fs.listStatus(p)] if fs.exists(p) else []


def replace_table(rows: DataFrame, path: str, check: Callable[[DataFrame], bool] | None = None) -> None:
    """Write beside a table, check what was written, then put it in the table's place; a failed check leaves the table as it is."""
    spark = rows.sparkSession
    staging, _ = _fs(spark, path + ".staging")
    target, fs = _fs(spark, path)
    old, _ = _fs(spark, path + ".old")
    rows.write.mode("overwrite").parquet(path + ".staging")
    if check is not None and not check(spark.read.parquet(path + ".staging")):
        fs.delete(staging, True)
        raise ValueError("the staged table failed its check")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(staging, target)
    fs.delete(old, True)


def upserted(table: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key of two tables."""
    both = table.unionByName(new)
    rest = [c for c in table.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("b"))
    return best.select(*[F.col(c) if c == key else F.col(f"b.{c}").alias(c) for c in table.columns])


def append_absent(new: DataFrame, path: str, key: str) -> None:
    """Append rows whose key a table lacks: a checkpoint that may be repeated."""
    spark = new.sparkSession
    p, fs = _fs(spark, path)
    if fs.exists(p):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.dropDuplicates([key]).write.mode("append").parquet(path)


def in_order(first: Callable[[DataFrame, int], None], second: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of two targets: the second is written only after the first, and its failure does not undo it."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            first(batch, epoch)
            try:
                second(batch, epoch)
            except Exception as e:  # the fast tier may be down; the lasting one has the batch
                print(f"second target failed in batch {epoch}: {e}")
        finally:
            batch.unpersist()

    return write


def sleeve_svg(title: Column, artist: Column, palette: Column) -> Column:
    """A sleeve in the colours of a record's palette."""
    clean = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    shape = F.when(palette["variant"] == 0, F.format_string('<circle cx="160" cy="160" r="120" fill="%s"/>', palette["c2"])).when(palette["variant"] == 1, F.format_string('<rect x="60" y="60" width="200" height="200" fill="%s"/>', palette["c2"])).otherwise(F.format_string('<path d="M160 40 L280 280 L40 280 Z" fill="%s"/>', palette["c2"]))
    return F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 320 320"><rect width="320" height="320" fill="%s"/>%s<text x="24" y="262" fill="%s">%s</text><text x="24" y="292" fill="%s">%s</text></svg>', palette["c0"], shape, palette["c3"], clean(title), palette["c3"], clean(artist))
