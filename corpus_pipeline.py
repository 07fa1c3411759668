"""Documents made ready for training: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import decontam, langid, minhash, packing, rlz
from voxloom.llm.common import read_table, written

#: A document whose language has less than this share of its letters is rejected.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told: some letters, and one language for enough of them. lang becomes that language."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs, model, keep=True)
    found = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates: that of smallest doc_id.

    Of several rows with that doc_id the one of smallest text stays (null last),
    of those the one of smallest hash over all columns. Rows without doc_id stay.
    """
    kept = minhash.near_duplicates(spark, docs).where("kept and doc_id is not null").select("doc_id").distinct()
    row, order = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col("text").isNull(), "text", F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c != "text"]))
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    named = named.groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 50 words or more that an earlier document has; a document of which nothing stays goes, one that was empty or null before stays."""
    found = rlz.parse(spark, docs, keep=True).where("n_removed = 0 or kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Rows without doc_id or text stay: they can't be named or contain nothing."""
    found = decontam.containments(spark, docs, read_table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 2048 tokens. A null or empty text is its end token alone; repeated rows are packed each, rows without doc_id keep it null."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, 2048)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: A fitted language model and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
