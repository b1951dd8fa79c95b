"""The registered queries of this package over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tideline.llm import ann, divergence, embedding_dedup, exact_dedup, language, license, mixing, ngram_join, packing, quality, token_files, tokens, toxicity, whitening
from tideline.llm.common import table
from tideline.session import scratch_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _rest(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(_rest() != 1))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(_rest() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_license(spark, sf_dir):
    notices = spark.createDataFrame(list(license.NOTICES.items()), "license string, notice string")
    return license.scan(table(spark, sf_dir, "documents"), notices)


def op4_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(_rest() != 1), table(spark, sf_dir, "labels").where(_rest() != 1))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(_rest() == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = tokens.pieces(docs, VOCABULARY, end_id=1, longest=2048)
    digests = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests, ["doc_id", "start"])


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"))


def op10_token_files(spark, sf_dir):
    path = scratch_dir(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, VOCABULARY, end_id=2)
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_license, op4_ngram_join, op5_toxicity, op6_ann, op7_packing, op8_embedding_dedup, op9_mixing, op10_token_files, op11_whitening, op12_divergence, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; the others are tested against brute force."""
    return {"op3_license": license.oracle_sql(), "op12_divergence": divergence.oracle_sql(),
            "op13_exact_dedup": exact_dedup.oracle_sql()}
