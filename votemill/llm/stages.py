"""The pipeline's stages: documents in, documents out, all columns kept; the last one returns its own result.

Every stage takes rows with null, empty or very long texts, repeated rows and
null or repeated ids, and returns no rows for an empty table.  Columns besides
those of ``documents`` pass through under their own names: what a stage adds
for itself stands beside the whole row, never among its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from votemill import runtime
from votemill.llm import ngram_join, packing, quality, suffix_dedup, toxicity
from votemill.llm.queries import held_out

#: Shortest repeated passage that the fourth stage cuts, in bytes, and the order of its difference set (period 57).  The texts'
#: passages of more than 50 words have 271 bytes or more, so a passage repeats in full well above this length.
PASSAGE = suffix_dedup.Settings(length=200, q=7)

#: Stretches of text that a worker remembers in the last stage, where the executors hold what four stages have left in them.
STRETCHES = 300_000


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3, a null or empty text by the share of toxic labels; equal texts go or stay together."""
    runtime.lean(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(*toxicity.training_sample(docs, labels, ~held_out("doc_id", 4)))
    return toxicity.score(docs, model).where(F.col("score") < 0.3).select(*_columns(docs))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept, without their failing lines; null and empty texts are rejected."""
    runtime.lean(spark)
    return quality.clean_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id (of those the first row, null ids last); documents without words stay."""
    runtime.lean(spark)
    numbered = docs.select(_row(docs).alias("row"), F.monotonically_increasing_id().alias("number"), F.col("text"))  # the same each time a table is read
    joined = ngram_join.join(numbered.select("number", "text", F.col("row.doc_id").alias("doc_id")), keep=["doc_id", "number"]).select("component", "row.doc_id", "row.number")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("number"))
    chosen = joined.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.number").alias("number"))
    return numbered.join(chosen, "number", "left_semi").select(*_columns(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the strings of ``PASSAGE.length`` bytes that also stand elsewhere, every copy; a character cut in two goes whole.

    A null text comes back empty, a text that repeats as a whole (also in a repeated row) likewise.
    """
    runtime.lean(spark)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    raw = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))
    out = suffix_dedup.dedup(docs, keep=others, settings=PASSAGE).select("row", text.alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents left and its place in a sequence of at most 1024 tokens; a null or empty text is its end token alone."""
    runtime.lean(spark)
    pieces = packing.tokenize(docs, keep=["doc_id"], path=public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024, memory=STRETCHES)
    out = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), size=1024)
    return out.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
