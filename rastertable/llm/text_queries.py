"""Queries over whole texts that need no other rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertable.llm import bpe, fingerprints, language, licences, quality, secrets
from rastertable.llm.registry import query
from rastertable.llm.tables import read_table


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path, public_tokenizers.PATTERN).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *(F.size(_of_kinds(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(_of_kinds(*(r.kind for r in secrets.BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _of_kinds(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


@query("op2_licences")
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered templates in every document; the score is the largest share of a template that is covered."""
    found = licences.scan(read_table(spark, sf_dir, "documents"))
    base, starts = F.transform("places", lambda p: p["label"]), F.transform("places", lambda p: p["start"])
    more = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)),
                   F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op13_language")
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs)).withColumn("held_out", language.held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", "accepted")


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.compare_with_next(read_table(spark, sf_dir, "documents"))


@query("op7_near")
def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with like fingerprints."""
    return fingerprints.classes(read_table(spark, sf_dir, "documents"))
