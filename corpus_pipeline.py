"""Cleans a corpus in stages; each stage reads what the one before it wrote.

Quality: documents scored below the threshold go. Near-duplicates: of each group of texts alike in five-word shingles the
document of the least id stays. Decontamination: documents with ten words in a row of a benchmark item go. Personal data:
spans are masked in the text. Tokens: texts are encoded and decoded again.

All stages but the last return the columns of the documents they got, ``n_chars`` kept in step with the text. Null and
empty texts are no duplicates and no leaks; the classifier judges them like any other. Null ids are never duplicates.
Of rows that share an id, near-dedup keeps one, the least text (nulls first). Extra columns pass through; in the last
stage those named ``ids``, ``n_tokens`` or ``round_trip`` are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.llm import bpe, near, nbsvm, pii, suffixes
from emberline.llm.queries import QUALITY_THRESHOLD, held_out
from emberline.llm.stored import stored
from emberline.session import prepare

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    model = nbsvm.learn(docs, labels)
    return nbsvm.score(docs, model, name="__score").where(F.col("__score") >= QUALITY_THRESHOLD).select(*columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    told = stored(near.link(docs, size=5))
    gone = told.where("NOT kept").select("doc_id").distinct()
    few = gone.count() <= near.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*columns(docs))
    repeated = stored(told.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    first = W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    one = (kept.join(repeated, "doc_id", "left_semi").withColumn("__place", F.row_number().over(first))
           .where("__place = 1").select(*columns(docs)))
    return kept.join(repeated, "doc_id", "left_anti").select(*columns(docs)).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    prepare(spark)
    return suffixes.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    prepare(spark)
    found = pii.find(docs.withColumnRenamed("spans", "__spans").withColumnRenamed("base_spans", "__base_spans"),
                     pii.learn(docs), redacted="__masked")
    found = found.drop("spans", "base_spans").withColumnsRenamed({"__spans": "spans", "__base_spans": "base_spans"})
    changed = {"text": F.col("__masked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").eqNullSafe(F.col("__masked")), F.col("n_chars")).otherwise(
            F.length("__masked")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(changed).select(*columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether decoding them gives the text back."""
    prepare(spark)
    coded = bpe.encode_and_decode(docs, TOKENIZER, decoded="__decoded")
    return coded.withColumn("round_trip", F.col("__decoded") == F.coalesce("text", F.lit(""))).drop("__decoded")


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("tokens", tokens)]

#: No stage but the third can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is stored before the next one reads it."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
