"""Exact deduplication with keyed streaming state.

Rows are reduced to (digest, stable identifier, content locator) and streamed through an aggregation that keeps, per
digest, the row that stays and the number of rows. The state lies in RocksDB on disk, never expires and is restored
from the checkpoint, so later rows are compared with all earlier ones. A hit is a digest that occurs again: then the
full bytes are compared, and where equal digests have different bytes, all keys are taken from the next digest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_of, keep_rows, text_of, work_folder

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Of all partitions of the state on an executor together; beside the heap and the Python workers.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # No disk space is reserved ahead for the logs of many small partitions.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
DIGESTS: tuple[Callable[[Column], Column], ...] = (
    lambda text: F.sha2(text, 256),
    lambda text: F.concat(F.sha2(text, 512), F.md5(text)),
)


def stream_keys(spark: SparkSession, keys_folder: str, checkpoint: str, states_folder: str) -> None:
    """Feed the rows of keys_folder that were not seen yet to the state kept in checkpoint.

    Each micro-batch writes the changed entries to states_folder/batch=N (once, also when it is repeated). A later
    call with the same checkpoint goes on with the state of the earlier ones.
    """
    stream = spark.readStream.schema(spark.read.parquet(keys_folder).schema).parquet(keys_folder)
    state = stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator", "row")).alias("keeper"), F.count("*").alias("group_size")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{states_folder}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def latest_states(spark: SparkSession, states_folder: str) -> DataFrame:
    """digest, keeper, group_size as the last micro-batch that changed them left them."""
    states = spark.read.parquet(states_folder)
    last = F.max_by(F.struct("keeper", "group_size"), "batch")
    return states.groupBy("digest").agg(last.alias("last")).select("digest", "last.keeper", "last.group_size")


def differing_bytes(docs: DataFrame, digest: Callable[[Column], Column]) -> bool:
    """Whether two different texts have the same digest. Equal texts meet inside each task first."""
    texts = docs.select(digest(text_of()).alias("digest"), text_of().alias("text")).distinct()
    return not texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").isEmpty()


def exact_groups(docs: DataFrame, digests: Sequence[Callable[[Column], Column]] = DIGESTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, locator of the row that stays.

    Of equal texts the row with the largest doc_id stays; a null doc_id is below every other, and of rows that
    repeat doc_id and text one stays. Null counts as empty text. An empty table gives an empty result. Other
    columns are ignored. digests: tried in order until no two different texts share one.
    """
    spark = docs.sparkSession
    for number, digest in enumerate(digests):
        keys_folder = work_folder(spark, "exact-keys")
        docs.select(
            "doc_id",
            digest(text_of()).alias("digest"),
            digest_of().alias("text_sha256"),
            F.input_file_name().alias("locator"),
            F.monotonically_increasing_id().alias("row"),
        ).write.parquet(keys_folder)
        keys = spark.read.parquet(keys_folder)
        if keys.isEmpty():
            keeper = F.struct("doc_id", "locator", "row").alias("keeper")
            state = keys.select("digest", keeper, F.lit(1).cast("long").alias("group_size"))
        else:
            states = work_folder(spark, "exact-states")
            stream_keys(spark, keys_folder, work_folder(spark, "exact-state"), states)
            state = latest_states(spark, states)
        if number + 1 == len(digests) or not differing_bytes(docs, digest):
            break
    return keys.join(state, "digest").select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"),
        "text_sha256",
        F.col("keeper.locator").alias("locator"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, all columns as they are."""
    groups = exact_groups(docs)
    return keep_rows(docs, groups.where("kept").select("doc_id", F.col("text_sha256").alias("digest")))
