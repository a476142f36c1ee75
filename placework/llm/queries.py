"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import work_folder
from .conversation_repair import planted_report
from .dart_minhash import near_classes
from .decontamination import benchmark_matches
from .exact_dedup import exact_groups
from .licenses import license_matches
from .main_text import extract_main_text
from .packing import pack_documents
from .periodic_runs import periodic_runs, run_digests, with_planted_period
from .personal_data import personal_data
from .piece_codes import code_digests
from .quality import quality_scores
from .repeated_spans import remove_repeats
from .token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@_query
def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@_query
def op4_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cache for each call, so that a result never depends on an earlier run."""
    return count_tokens(table(spark, sf_dir, "documents"), work_folder(spark, "token-cache"), vocabulary())


@_query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


@_query
def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("locator")


ORACLES["op8_exact_duplicates"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op9_packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@_query
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


@_query
def op11_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@_query
def op12_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_report(table(spark, sf_dir, "conversations"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_period(table(spark, sf_dir, "documents"))))
