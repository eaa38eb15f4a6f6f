"""Queries over the words and pieces of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.catalog import query, table
from tallyframe.llm.pieces import encode

MODEL = "piece_bpe_32k.model"


@query("op1_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path(MODEL), results=("n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"))
