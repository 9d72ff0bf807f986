"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each one's rows as Parquet to the shared folder and
hands them, read again, to the next. All but the last return the columns of their docs, whatever these are. The files of the mixing
stage hold the schedule as the order of their rows, which packing keeps.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import free_names, saved, table
from quarry.llm.jaccard import jaccard_components
from quarry.llm.line_dedup import line_dedup
from quarry.llm.mixing import mix_sources
from quarry.llm.packing import ORDER, in_order, pack, token_pieces, with_ranks
from quarry.llm.quality import fit_quality, grades_of, score_quality

#: Pieces of the schedule that are packed together, about: fewer keep closer to the targets, more leave less room empty.
MIX_PIECES = 1024


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade (well written and clean) reaches the threshold; the others go.

    Fitted on rated documents of docs. With no rated one, all stay. A null or empty text is graded by its emptiness.
    """
    model = fit_quality(docs, grades_of(table(spark, sf_dir, "labels")))
    prefix = "__q"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return score_quality(docs, model, prefix=prefix).where(f"{prefix}kept").select(*(f"`{c}`" for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; a document with no line left goes. n_chars follows the text.

    A null text stays as it is, and so does a document that has been empty from the start.
    """
    made = free_names(docs, "n_lines", "n_removed", "removed")
    total, gone = map(F.col, made[:2])
    left = line_dedup(docs, out=tuple(made)).where((gone == 0) | (gone < total))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(gone > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays.

    Documents without words link with nothing and stay; so do rows without a doc_id.
    """
    groups = jaccard_components(docs.select("doc_id", "text"))
    return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule: at every moment each source is within one block of its target weight."""
    made = free_names(docs, "block", "slot", "place")
    return mix_sources(docs, out=tuple(made)).orderBy(*made[1:]).select(*(f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it. The sequences, by their ids, follow the order of docs.

    That is the schedule of `mixing`, as its rows stand in the files: by the number of the file, then by the place in it.
    """
    numbered = in_order(docs.select("doc_id", "text"))
    pieces = saved(token_pieces(numbered, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, carry=ORDER), "pieces")
    return pack(saved(with_ranks(pieces), "ordered"), capacity=4096, block_pieces=MIX_PIECES)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: SQL can't fit the classifier; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
