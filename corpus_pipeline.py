"""From raw documents to token ids: quality, copies, near copies, source mix, pieces.

Each stage works on all that its predecessor kept and returns rows with the
columns of its input; the last one returns encoded rows. ``run`` writes and
rereads every stage's result, so a lost executor costs at most one stage.

In every stage a NULL text counts as empty, NULL ids, languages and sources are
values like others unless a stage says otherwise, repeated rows are judged alike,
an empty table gives an empty one, and further columns pass through under whatever
name.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.catalog import table
from tallyframe.llm.exact_dedup import kept_documents
from tallyframe.llm.mixing import mixed_documents
from tallyframe.llm.ngram_join import near_duplicates
from tallyframe.llm.pieces import encode
from tallyframe.llm.quality_vote import fit, scored
from tallyframe.session import cut_lineage

MODEL = "piece_bpe_32k.model"


def any_names(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on tables whose own columns may begin with an underscore, as helper columns of operators do."""

    @functools.wraps(stage)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apart = {c: f"further{c}_{k}" for k, c in enumerate(docs.columns) if c.startswith("_")}
        out = stage(spark, docs.withColumnsRenamed(apart), sf_dir)
        return out.withColumnsRenamed({new: old for old, new in apart.items()})

    return staged


@any_names
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from ``labels`` and these documents."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, name="_score").where("_score >= 0.5").select(*docs.columns)


@any_names
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The owner of each group of equal texts."""
    return kept_documents(docs)


@any_names
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of linked documents; rows with a NULL id link with nothing and stay."""
    found = near_duplicates(docs.select("doc_id", "text"))
    others = cut_lineage(found.where("doc_id != component_id").select(F.col("doc_id").alias("_other")).distinct())
    return docs.join(others, F.col("doc_id") == F.col("_other"), "left_anti")


@any_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


@any_names
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces and the byte spans they come from, with id and source; other columns end here."""
    return encode(docs, public_tokenizers.path(MODEL), carry=("doc_id", "source"), results=("ids", "begins", "ends", "n_tokens"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]
#: No SQL: the classifier and the tokenizer have no form in it. Tests repeat the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
