"""Caches of bytes with a size cap and aliases, and stems published as whole sets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.operators import joins, sequences as seq
from strandwork.sources import sinks


class BlobCache:
    """Bytes by key below a folder that all machines share.

    Each put appends its content in a folder of its own, which is never written again; then the index of (key, size,
    modified, put, row) is written beside the old one and swapped in. A put that dies between the two leaves content that no
    index names, for `sweep` to remove. The index moves through Spark, content only once when it is put.

    A row without a key or without bytes is not put. Of several rows of one key in a put the newest stays. A put replaces what
    its keys held, then the oldest entries go until the rest fits `cap` bytes; those just put or in flight are passed
    over, even if they alone exceed the cap.
    """

    def __init__(self, spark: SparkSession, path: str, cap: int, key: str = "key") -> None:
        self.spark, self.path, self.cap, self.key = spark, path.rstrip("/"), cap, key

    def _table(self, name: str) -> DataFrame | None:
        path = f"{self.path}/{name}"
        return self.spark.read.parquet(path) if sinks.exists(self.spark, path) else None

    def entries(self) -> DataFrame | None:
        """(key, size, modified, put, row), None before the first put."""
        return self._table("index")

    def aliases(self) -> DataFrame | None:
        """(alias, key), None before the first one."""
        return self._table("aliases")

    def put(self, new: DataFrame, in_flight: DataFrame | None = None) -> None:
        """Put rows of (key, modified, content); `in_flight` has keys that must stay."""
        key, put = self.key, "p" + uuid.uuid4().hex
        folder = f"{self.path}/content/put={put}"
        rows = new.select(key, "modified", F.col("content").cast("binary").alias("content"), F.octet_length("content").cast("long").alias("size"))
        rows.where(F.col(key).isNotNull() & (F.col("size") > 0)).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
        newest = F.max_by(F.struct("size", "modified", F.lit(put).alias("put"), "row"), F.struct("modified", "row"))
        fresh = self.spark.read.parquet(folder).groupBy(key).agg(newest.alias("e")).select(key, "e.*")
        old = self.entries()
        index = fresh if old is None else old.join(fresh.select(key), key, "left_anti").unionByName(fresh)
        busy = F.col("put") == put
        if in_flight is not None:
            index = index.join(in_flight.select(key, F.lit(True).alias("_busy")).distinct(), key, "left")
            busy = busy | F.coalesce("_busy", F.lit(False))
        index = index.select(key, "size", "modified", "put", "row", busy.alias("_kept"))
        gone = seq.evicted(index, [], ["modified", key], "size", self.cap, "_kept")
        sinks.replace_table(index.drop("_kept").join(gone.select(key), key, "left_anti"), f"{self.path}/index")

    def put_aliases(self, new: DataFrame) -> None:
        """Add (alias, key) rows whose key is an entry and whose alias is neither an alias nor an entry; the least key of an alias stays."""
        entries = self.entries()
        if entries is None:
            return
        rows = new.join(entries.select(self.key), self.key, "left_semi").groupBy("alias").agg(F.min(self.key).alias(self.key))
        rows = rows.join(entries.select(F.col(self.key).alias("alias")), "alias", "left_anti")
        sinks.append_absent(rows, f"{self.path}/aliases", "alias")

    def get(self, requests: DataFrame, request: str) -> DataFrame:
        """Requests that hit, by their own key or by an alias, with key, size, modified and content; an alias whose entry has gone misses."""
        entries = self.entries()
        if entries is None:
            raise ValueError(f"nothing has been put into {self.path}")
        content = self.spark.read.parquet(f"{self.path}/content").select("put", "row", "content")
        aliases = self.aliases()
        if aliases is None:
            aliases = entries.select(F.col(self.key).alias("alias"), self.key).where(F.lit(False))
        hits = joins.through_alias(requests, aliases, entries, request, "alias", self.key)
        return hits.join(content, ["put", "row"]).drop("put", "row")

    def sweep(self) -> None:
        """Remove the content of puts of which no entry is left."""
        entries = self.entries()
        live = set() if entries is None else {r[0] for r in entries.select("put").distinct().collect()}  # as many as puts
        for folder in sinks.children(self.spark, f"{self.path}/content"):
            if folder.rsplit("put=", 1)[-1] not in live:
                sinks.remove(self.spark, folder)


def published(current: DataFrame, staged: DataFrame, key: Sequence[str], name: str, wanted: Sequence[str]) -> DataFrame:
    """What holds after staged sets are published: a key whose staged names are just the wanted ones gives all its rows in
    place of the current ones, any other leaves the current ones as they are. Keys are not null."""
    exact = F.bool_and(F.coalesce(F.col(name).isin(*wanted), F.lit(False)))
    for n in wanted:
        exact = exact & F.bool_or(F.coalesce(F.col(name) == n, F.lit(False)))
    whole = staged.groupBy(*key).agg(exact.alias("_ok")).where("_ok").select(*key)
    return current.join(whole, list(key), "left_anti").unionByName(staged.join(whole, list(key), "left_semi"))
