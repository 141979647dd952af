"""Projections and filters over semi-structured and array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_completion(value: Column, step: str = "summary", step_path: str = "$.pipeline_step", needed: str = "$.total_pipeline_time_s") -> Column:
    """Whether a record is of one step and has a key, whatever its value: a JSON null counts, a missing key does not."""
    right = F.try_variant_get(value, F.lit(step_path), "string") == step
    return F.coalesce(right & F.try_variant_get(value, F.lit(needed), "variant").isNotNull(), F.lit(False))


def completions(log: DataFrame, value: str = "j") -> DataFrame:
    """The records that are completions."""
    return log.where(is_completion(F.col(value)))


def number_at(value: Column, path: str) -> Column:
    """A JSON number or boolean as double; numeric strings and everything else are null."""
    kind = F.schema_of_variant(F.try_variant_get(value, F.lit(path), "variant"))
    return F.when(~kind.startswith("STRING"), F.try_variant_get(value, F.lit(path), "double"))


def list_or_single(value: Column, many: str, one: str) -> Column:
    """Strings of a list, or a single string as a list; the list wins where it is one."""
    items = F.try_variant_get(value, F.lit(many), "array<variant>")
    strings = F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))), lambda x: x.isNotNull())
    single = F.when(F.schema_of_variant(F.try_variant_get(value, F.lit(one), "variant")) == "STRING", F.try_variant_get(value, F.lit(one), "string"))
    return F.coalesce(strings, F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))


def not_silent(stems: DataFrame, lufs: str = "lufs", least: float = -50.0) -> DataFrame:
    """Drop nearly silent rows; rows without a measurement stay."""
    return stems.where(F.col(lufs).isNull() | (F.col(lufs) >= least))


def time_slice(samples: Column, rate: int, start_s: Column, end_s: Column) -> Column:
    """Samples from start to end in seconds, clamped to what there is."""
    n = F.size(samples)
    first = F.greatest(F.lit(0), F.least(n, F.floor(start_s * rate).cast("int")))
    last = F.greatest(first, F.least(n, F.floor(end_s * rate).cast("int")))
    return F.slice(samples, first + 1, last - first)


def is_lossy(quality: Column) -> Column:
    return F.startswith(F.coalesce(quality, F.lit("")), F.lit("youtube"))


def accepted_uploads(files: DataFrame, *, name: str = "name", size: str = "length", duration: str = "duration_s", extensions: tuple[str, ...] = (".mp3", ".wav", ".flac", ".m4a"), most_bytes: int = 50 << 20, most_s: float = 900.0) -> DataFrame:
    """Add `accepted` and the first `reason` against a file: extension, size, duration."""
    from strandwork.functions.rules import first_match
    from strandwork.functions.urls import extension

    reason = first_match([(~extension(F.col(name)).isin(*extensions), "extension"), (F.col(size) > most_bytes, "size"), (F.coalesce(F.col(duration) > most_s, F.lit(False)), "duration")])
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
