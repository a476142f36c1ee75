"""Token counts through a digest cache.

The cache is a folder of rows (content digest, tokenizer digest, number of tokens). Documents are joined to it by the
digest of their normalised content; only distinct contents that it does not hold are encoded, and their counts are
appended. Counts of another tokenizer file are never used, because its digest differs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folder_exists, pieces, release_words, text_of, token_ids

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _encoder(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "content"):
                counts = [len(ids) // 4 for ids in token_ids(texts, path)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "digest": part.column(part.schema.get_field_index("digest")),
                        "tokenizer": pa.array([version] * len(counts), pa.string()),
                        "n_tokens": pa.array(counts, pa.int64()),
                    }
                )
        release_words(path)

    return encode


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str, limit: int = 512, normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs.

    tokenizer: path of a `tokenizers` file that every executor has. normalise: what is done to a text before it is
    counted and digested (default: nothing); n_bytes is the length of the text as it is.
    Null and empty texts have 0 bytes and tokens. Repeated rows and texts each get their row. An empty table gives an
    empty result. Other columns are ignored. A job that is repeated appends counts again; equal ones are read as one.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    content = normalise(text_of()) if normalise else text_of()
    rows = docs.select(
        "doc_id", content.alias("content"), F.sha2(content, 256).alias("digest"), F.octet_length(text_of()).cast("long").alias("n_bytes")
    )

    def stored() -> DataFrame:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        return table.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    missing = rows.select("digest", "content")
    if folder_exists(spark, cache):
        missing = missing.join(stored(), "digest", "left_anti")
    # One row per content; equal contents meet inside each task first.
    missing = missing.groupBy("digest").agg(F.first("content").alias("content"))
    missing.mapInArrow(_encoder(tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    return rows.drop("content").join(stored(), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
