"""The numbered queries with production parameters, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .divergence import DIVERGENCE_SQL, source_divergence
from .licenses import license_report
from .minhash import near_duplicates
from .mixing import MIX_SQL, mixed_sizes
from .packing import pack
from .quality import quality_scores
from .secrets import secret_report
from .sharding import shard_report, shard_sql
from .toxicity import toxicity_scores
from .trie import TRIE_SQL, prefix_trie
from .urls import judged_pages
from .vector_dedup import NEAR_VECTORS_SQL, vector_near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pages(table(spark, sf_dir, "pages"))


def op3_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.9)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public tokenizer that the packing query fixes."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op9_toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(table(spark, sf_dir, "documents"), shards=24)


QUERIES = {
    "op1_ivf_pq_search": op1_ivf_pq_search,
    "op2_url_filter": op2_url_filter,
    "op3_vector_near_dedup": op3_vector_near_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_discriminant": op5_quality_discriminant,
    "op6_mix_sources": op6_mix_sources,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity_network": op9_toxicity_network,
    "op10_secret_scan": op10_secret_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_feistel_shards": op13_feistel_shards,
}

ORACLE_SQL: dict[str, str] = {
    "op3_vector_near_dedup": NEAR_VECTORS_SQL,
    "op6_mix_sources": MIX_SQL,
    "op11_source_divergence": DIVERGENCE_SQL,
    "op12_prefix_trie": TRIE_SQL,
    "op13_feistel_shards": shard_sql(),
}
