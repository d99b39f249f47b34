"""Training-corpus pipeline over documents: each stage's result is written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import written
from lociflow.llm.minhash import near_duplicates
from lociflow.llm.mixing import mix
from lociflow.llm.packing import pack
from lociflow.llm.quality import good_documents
from lociflow.llm.queries import table, tokenizer_path
from lociflow.llm.secrets import redacted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, with all their columns.

    A null or empty text is scored like a text without words; whole texts are scored, however long. Rows that repeat an id,
    or have a null one, are scored each for itself. Without labels of a class its law is the pooled one. An empty table
    gives an empty one.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on five-word shingles at 0.8: the one with the smallest id.

    Documents without words and with a null id stay. Where several rows of a group have that id, the one with the
    smallest hash of its text stays, and one of rows that repeat it in id and text. Ids that other texts have as well
    don't matter: a row goes by its id and text.
    """
    groups = written(near_duplicates(docs, shingle_words=5, percent=80), "groups")
    grouped = groups.where("component is not null")
    heads = grouped.where("kept").groupBy("component").agg(F.min("text_key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = written(heads, "heads")  # groups with several rows of the smallest id: none where ids are unique
    others = grouped.where("kept").join(heads, "component").where("text_key <> head")
    gone = grouped.where("not kept").select("doc_id", "text_key").unionByName(others.select("doc_id", "text_key")).distinct()
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__text": F.xxhash64(F.col("text").cast("string"))})
    named = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"))
    kept = keyed.join(named.hint("merge"), ["__id", "__text"], "left_anti")
    if not heads.isEmpty():
        repeated = grouped.where("kept").join(heads, "component").where("text_key = head").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct()
        once = kept.join(repeated, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"])
        kept = kept.join(repeated, ["__id", "__text"], "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars set anew where one was.

    Null and empty texts stay as they are, with their n_chars. Rows that repeat an id, or have a null one, are changed each
    for itself. An empty table gives an empty one; other columns stay.
    """
    clean = redacted(docs.withColumn("__was", F.length("text")))
    return clean.withColumn("n_chars", F.when(F.length("text") != F.col("__was"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, sorted by training position.

    Documents without words, null texts among them, are never taken. A null source is a source of its own; rows of a
    source that repeat an id are taken alike, rows with a null id too. An empty table gives an empty one.
    """
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens.

    A null or empty text is one piece that holds the end id alone; a longer text than a sequence is cut. Rows that repeat an
    id are packed each for itself, and a null id stays null. An empty table gives an empty one.
    """
    return pack(docs, tokenizer_path(), capacity=4096)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Learned scores, sketches and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
