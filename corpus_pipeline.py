"""A corpus pipeline of five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes every stage's rows as Parquet in
the shared folder and hands them, read again, to the next.

Defined results: null, empty and blank texts fail the quality rules and go; of rows in
one near-duplicate group those with the smallest doc_id stay, so rows of one id stay or
go together, and a row without id always stays; passages go from all documents but that
with the smallest id, which may leave an empty text; texts of any length are handled
whole; the mix repeats documents, and the pieces of each repetition carry its number in
``copy``; further columns of any name pass through to the last stage; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing, quality, simhash, substring_dedup
from graphloom.llm.common import table, tokenizer_path, written

#: The pipeline flattens the mix gently: no document is lost, and the smallest sources pass this often at most.
REPEAT_LIMIT = 1.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.filter_quality(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that a document with a smaller id has too."""
    out = substring_dedup.cut_documents(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs, limit=REPEAT_LIMIT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "copy")


STAGES = [
    ("quality", keep_quality),
    ("simhash", drop_near_copies),
    ("substrings", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SimHash components, suffix refinement and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
