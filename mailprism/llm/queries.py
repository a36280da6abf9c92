"""One query per corpus operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.llm.chat import rotate_perspectives
from mailprism.llm.common import ready
from mailprism.llm.lexical_search import search_documents
from mailprism.llm.line_quality import judge_documents
from mailprism.llm.mixing import mix_documents
from mailprism.llm.packing import pack_documents
from mailprism.llm.phrase_index import decontaminate
from mailprism.llm.secret_scan import scan_secrets
from mailprism.llm.simhash import simhash_components
from mailprism.llm.spelling import spelling_variants
from mailprism.llm.suffix_dedup import repeats_report
from mailprism.llm.token_files import token_table
from mailprism.llm.top_k import top_k
from mailprism.llm.url_filter import filter_urls


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ready(spark)
        return operator(spark.read.parquet(f"{folder}/{name}.parquet"))

    return query


def _with_benchmark(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ready(spark)
        return operator(*(spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark")))

    return query


def _contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontaminate(docs, items).withColumn("n_near_items", F.size("near_items").cast("long"))
    return found.drop("items", "near_items", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _over("documents", scan_secrets),
    "op2_token_files": _over("documents", token_table),
    "op3_url_filter": _over("pages", filter_urls),
    "op4_perspectives": _over("conversations", rotate_perspectives),
    "op5_simhash": _over("documents", simhash_components),
    "op6_packing": _over("documents", pack_documents),
    "op7_suffix_dedup": _over("documents", repeats_report),
    "op8_mixing": _over("documents", mix_documents),
    "op9_line_quality": _over("documents", lambda docs: judge_documents(docs).drop("host", "digest")),
    "op10_top_k": _over("embeddings", lambda vectors: top_k(vectors.sparkSession, vectors)),
    "op11_phrase_index": _with_benchmark(_contamination),
    "op12_lexical_search": _with_benchmark(search_documents),
    "op13_spelling": _over("documents", spelling_variants),
}
