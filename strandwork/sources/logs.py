"""Log lines of JSON objects, tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.functions.times import day_text, iso_week, parsed


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as `value`; a path that does not exist has none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path)
    return spark.read.text(path) if found else spark.createDataFrame([], "value string")


def records(raw: DataFrame, value: str = "value", since: Column | None = None) -> DataFrame:
    """(j variant, raw_ts, ts) of the lines that are JSON objects, from a time on; other columns are kept.

    Blank and broken lines and JSON scalars are dropped. A missing or unreadable time never drops a record; times without
    an offset are UTC. A line is parsed once: the explode keeps the optimizer from repeating the parse in each expression.
    """
    j = F.explode(F.array(F.try_parse_json(F.col(value)))).alias("j")
    rows = raw.where(F.col(value).rlike(r"^\s*\{")).select(*[c for c in raw.columns if c != value], j).where(F.col("j").isNotNull())
    rows = rows.withColumn("raw_ts", F.try_variant_get("j", F.lit("$.timestamp"), "string")).withColumn("ts", parsed(F.col("raw_ts")))
    return rows if since is None else rows.where(F.col("ts").isNull() | (F.col("ts") >= since))


def dated(rows: DataFrame, raw_ts: str = "raw_ts") -> DataFrame:
    """Rows with `day` and ISO `week` as their own text has them."""
    day = day_text(F.col(raw_ts))
    return rows.withColumn("day", day).withColumn("week", F.when(day.isNotNull(), iso_week(F.to_date(day))))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """A growing folder of log files as a stream of lines."""
    return spark.readStream.text(folder)
