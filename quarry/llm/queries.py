"""The queries of this package: opN_<name> over the whole tables, with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import table
from quarry.llm import line_dedup as lines
from quarry.llm import oracles
from quarry.llm.ann import nearest
from quarry.llm.embedding_dedup import near_duplicates
from quarry.llm.jaccard import jaccard_components
from quarry.llm.kneser_ney import held_out, score, train
from quarry.llm.mixing import mix_sources
from quarry.llm.packing import pack_documents
from quarry.llm.quality import fit_quality, grades_of, score_quality
from quarry.llm.token_binary import token_binary
from quarry.llm.token_counts import token_counts


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents: groups linked by a similarity of five-word shingles of 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of all documents; a null text counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the token files; a null text counts as empty."""
    return token_binary(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, place of all documents; a null source is a source of its own. Targets are the square roots of the sources' counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", "block", "slot", "place")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, p_top, kept of all documents, by a model fitted on the rated ones; a null text is graded as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, grades_of(table(spark, sf_dir, "labels")))
    return score_quality(docs, model).select("doc_id", "expected_grade", "p_top", "kept")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents by a model of those that are not held out; a null text is one end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where("NOT held_out"))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of every 100th vector among all usable ones."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed and the text left of all documents; a null text stays null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "removed", "text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a null text is one end id."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all vectors: links within a label by a cosine of 0.93 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_token_counts,
        op3_token_binary,
        op4_mix_sources,
        op5_quality_classifier,
        op6_language_model,
        op7_nearest_neighbours,
        op8_line_dedup,
        op9_best_fit_packing,
        op10_embedding_dedup,
    )
}
ORACLES = {"op1_ngram_jaccard": oracles.OP1, "op8_line_dedup": lines.ORACLE, "op10_embedding_dedup": oracles.OP10}
