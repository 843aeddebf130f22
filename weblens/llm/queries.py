"""One registered query per operator, over its whole table, and the SQL twins there are."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from weblens.llm import (
    cross_align, decontaminate, language, lexical_search, line_dedup, mixing, ngram_join, prefix_tokens, quality, sharding,
    url_filter, vector_join, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *names: str, **options) -> Query:
    """A query that applies an operator to whole tables."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names), **options)
    return run


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return prefix_tokens.counted_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _both_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return cross_align.aligned_documents(docs, *paths)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": _over(line_dedup.deduplicated_documents, "documents"),
    "op2_sharding": _over(sharding.sharded_documents, "documents", shards=16),
    "op3_warc": _over(warc.archived_pages, "pages"),
    "op4_url_filter": _over(url_filter.judged_pages, "pages"),
    "op5_source_mixing": _over(mixing.mixed_documents, "documents"),
    "op6_ngram_jaccard_join": _over(ngram_join.linked_documents, "documents", n=4, percent=85),
    "op7_language_id": _over(language.identified_documents, "documents"),
    "op8_quality_rules": _over(quality.judged_documents, "documents", "labels"),
    "op9_benchmark_decontamination": _over(decontaminate.leaks, "documents", "benchmark"),
    "op10_token_counts": _tokens,
    "op11_embedding_near_dedup": _over(vector_join.near_vectors, "embeddings", least=0.9),
    "op12_cross_tokenizer_alignment": _both_tokens,
    "op13_ranked_lexical_search": _over(lexical_search.ranked_documents, "documents", "benchmark"),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.SQL,
    "op4_url_filter": url_filter.SQL,
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op11_embedding_near_dedup": vector_join.SQL,
    "op13_ranked_lexical_search": lexical_search.SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
