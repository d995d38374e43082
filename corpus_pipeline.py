"""The corpus pipeline: documents to token ids, stage by stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import crf, pieces
from tabscope.llm.common import free_name, shared_path
from tabscope.llm.mixing import mixed
from tabscope.llm.ngram_join import one_of_each_group
from tabscope.llm.suffix_dedup import remove_repeats

PIECES = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes each document's predicted language into ``lang`` and rejects documents without letters.

    Text in several languages stays, with the language of the largest share.
    """
    model = crf.fit(docs.where(~crf.held_out() & F.col("doc_id").isNotNull()))
    label, score = free_name(docs, "_language"), free_name(docs, "_score")
    found = crf.with_language(docs, model, label, score).where(F.col(label) != crf.UNKNOWN)
    return found.select(*[F.col(label).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of similar 5-word shingle sets."""
    return one_of_each_group(docs, width=5, threshold=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document with a smaller doc_id holds too."""
    return remove_repeats(docs, keep_text=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that the sources come near their target weights."""
    return mixed(docs, weights=(5, 2, 1), max_epochs=3)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, piece_ids) of every taken document."""
    encoded = pieces.encode(docs, pieces.Vocabulary(public_tokenizers.path(PIECES)))
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", token_ids),
]

#: SQL expresses neither the language model nor the segmentation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
