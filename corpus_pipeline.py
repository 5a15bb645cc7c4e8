"""A corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir), returns a DataFrame and is written and read back before the next one. All but
the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosscut.llm import langid, lexicon, line_dedup, mixing, near_dup
from crosscut.llm.common import settle
from crosscut.llm.token_files import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose two best languages are too close, go; the others stay as they are."""
    return langid.identify(docs, langid.fit(docs)).filter(~F.col("rejected")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that an earlier document holds."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity of 0.8 or more)."""
    return near_dup.keep_first(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix reads of each document, in blocks of 64 words, once for every time that it is read."""
    return mixing.mixed_documents(docs, block_words=64)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the hash of what they decode to."""
    out = lexicon.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"), decoded=False, keep=["doc_id", "lang", "source", "n_chars"])
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode_tokens),
]

#: Language ID and token ids are beyond SQL; tests/llm/test_pipeline.py holds every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
