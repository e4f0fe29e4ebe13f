"""A training corpus from raw documents, in five stages.

Each stage gets all that the one before kept, and its decisions take effect: toxic documents go, later copies of
line runs and of lines of more than 50 words are cut (documents with nothing left go), one document of each near-duplicate group stays, sources are
drawn to their target weights (a document may come up to three times), and what is left is packed into sequences.
All stages but the last return the columns of ``documents``; the last one returns the pieces of sequences with their token
ids, with row_id to tell the copies of a document apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import jaccard, linededup, mixing, packing, toxicity
from paperloom.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't reject. Null and empty texts stay; repeated rows are judged alike; without labels all stay."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs. Texts without a line, null ones too, stay; what loses all its lines goes."""
    return linededup.deduped(docs, long_words=linededup.LONG_WORDS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the first by id and text. Texts without a word link with nothing and stay."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times. A null source is a source; texts without a word are never taken."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Null and empty texts are the closing id alone; rows of one id are packed each for itself."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity grammar, the tokenizer and the packing aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
