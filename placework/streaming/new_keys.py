"""Each key once, as items arrive.

The seen keys are a table of folders, one per micro-batch, each split by a hash of the key; a batch reads only the parts its
keys fall into. Folders of MERGED batches in a row become one, those of MERGED such folders another, and so on, so
the number of files grows with the logarithm of the number of batches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of the key table, and folders that become one.
BUCKETS = 16
MERGED = 8


def stream_new_keys(
    stream: DataFrame, key: list[str], ts: str | None = None, delay: str | None = None
) -> DataFrame:
    """The first item of each key.

    Without `delay` a key is never emitted twice and the state holds every key. With `ts` and `delay` the
    state holds keys for that time only, and a key may come back later.
    """
    if delay is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


class KeyFolders:
    """The folders of a key table: `query=<id>/first=<batch>/last=<batch>`, each with the keys of those batches."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.out).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, query: str, first: int, last: int) -> str:
        return f"{self.out}/query={query}/first={first}/last={last}"

    def found(self) -> dict[str, list[tuple[int, int]]]:
        """query -> (first, last) of its whole folders; one that is being written has no mark of success yet."""
        marks = self.fs.globStatus(self.path(f"{self.out}/query=*/first=*/last=*/_SUCCESS"))
        out: dict[str, list[tuple[int, int]]] = {}
        for mark in marks or ():
            query, first, last = re.search(r"/query=([^/]*)/first=(\d+)/last=(\d+)/_SUCCESS$", mark.getPath().toString()).groups()
            out.setdefault(query, []).append((int(first), int(last)))
        return out

    @staticmethod
    def current(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The folders that hold every batch once: the longest from each batch on."""
        out, at = [], -1
        for first, last in sorted(spans, key=lambda s: (s[0], -s[1])):
            if first > at:
                out.append((first, last))
                at = last
        return out

    def read(self, fields: str, spans: dict[str, list[tuple[int, int]]]) -> DataFrame:
        folders = [self.folder(query, *span) for query, own in spans.items() for span in own]
        if not folders:
            return self.spark.createDataFrame([], f"{fields}, bucket INT")
        return self.spark.read.schema(f"{fields}, bucket INT").option("basePath", self.out).parquet(*folders)

    def write(self, keys: DataFrame, query: str, first: int, last: int) -> None:
        rows = keys.repartition(BUCKETS, "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self.folder(query, first, last))

    def remove_covered(self, query: str, before: int) -> None:
        """Folders whose batches are all in a longer folder that ends before a batch; that one is committed."""
        spans = [s for s in self.found().get(query, []) if s[1] < before]
        kept = set(self.current(spans))
        for first, last in spans:
            if (first, last) not in kept:
                self.fs.delete(self.path(self.folder(query, first, last)), True)


def key_bucket(key: list[str]):
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def unseen_keys(folders: KeyFolders, fields: str, key: list[str], fresh: DataFrame, spans: dict) -> DataFrame:
    """The rows of fresh (key columns, bucket) whose key no folder has; only the buckets of fresh are read."""
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
    seen = folders.read(fields, spans).filter(F.col("bucket").isin(touched))
    same = [fresh[k].eqNullSafe(seen[k]) for k in key]
    return fresh.join(seen, [fresh["bucket"] == seen["bucket"], *same], "left_anti")


def write_new_keys(stream: DataFrame, key: list[str], out: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that adds unseen keys to the key table `out`, and return it.

    A micro-batch is reduced to its distinct keys before it is shuffled, so a hot key sends one row per
    task, and the seen keys are a table rather than operator state. A batch owns its folder: one that is run again
    after a failure overwrites what it wrote and looks at everything but itself and later ones. Folders that a merge
    covers go only when a later batch has begun, so the merging batch can be repeated too. The query's id comes with
    its checkpoint, so a new checkpoint into the same table keeps all stored keys.
    """
    spark = stream.sparkSession
    fields = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in key)

    def append(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        folders = KeyFolders(spark, out)
        folders.remove_covered(own, batch_id)
        spans = {
            query: folders.current([s for s in found if query != own or s[1] < batch_id])
            for query, found in folders.found().items()
        }
        fresh = batch.select(*key).distinct().withColumn("bucket", key_bucket(key))
        folders.write(unseen_keys(folders, fields, key, fresh, spans), own, batch_id, batch_id)
        width = MERGED
        while (batch_id + 1) % width == 0:
            first = batch_id + 1 - width
            inside = [s for s in folders.found()[own] if first <= s[0] and s[1] <= batch_id and s != (first, batch_id)]
            folders.write(folders.read(fields, {own: folders.current(inside)}), own, first, batch_id)
            width *= MERGED

    writer = stream.select(*key).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_new_keys(spark: SparkSession, out: str, fields: str) -> DataFrame:
    """The stored keys, each once, with the hash part of each."""
    folders = KeyFolders(spark, out)
    return folders.read(fields, {query: folders.current(spans) for query, spans in folders.found().items()})
