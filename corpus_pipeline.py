"""The corpus pipeline: stages over documents, each of which reads what the one before it has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.common import materialize, read_table
from cuelattice.llm.langid import fit, keep_known, training_fold
from cuelattice.llm.minhash import near_duplicates
from cuelattice.llm.mixing import take_mix
from cuelattice.llm.packing import pack_documents
from cuelattice.llm.queries import word_bpe
from cuelattice.llm.secrets import redact_secrets

#: Documents of which a larger share of trigrams is in no learned language are rejected.
MOST_UNSEEN = 0.3

#: SQL has no tokenizer and no mixture inference.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts, texts without letters and those of no learned language go. Repeated rows stay."""
    model = fit(docs.where(~training_fold(F.col("doc_id"))), key=F.col("doc_id"))
    return keep_known(docs, model, most_unseen=MOST_UNSEEN)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest doc_id. Rows without a doc_id stay."""
    gone = near_duplicates(docs, shingle_words=5, similarity=(80, 100)).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked; null texts and repeated rows stay as they are."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their sources, some of them several times. Null texts have size 0, a null source is one of its own."""
    return take_mix(docs, weights=(5, 2, 1), most_repeats=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their places in sequences of 2048; a null text is its end id alone, repeated rows are packed one by one."""
    return pack_documents(docs, word_bpe(), sequence_length=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. An empty table gives an empty result; other columns go along up to the packing."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
