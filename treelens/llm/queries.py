"""The thin queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import exact_dedup, lattice_lm, line_dedup, minhash, mixing, passages, pieces, quality, secrets, sharding
from .common import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.quality(docs, table(spark, sf_dir, "labels"))
    return judged.drop("text")


def piece_model() -> str:
    """The path of the vocabulary file; TREELENS_PIECES or the installed public file."""
    if path := os.environ.get("TREELENS_PIECES"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir):
    return pieces.tokenize(table(spark, sf_dir, "documents"), piece_model(), with_ids=False)


def op5_suffix_dedup(spark, sf_dir):
    return passages.passage_dedup(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark, sf_dir):
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark, sf_dir):
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op9_lm_score(spark, sf_dir):
    """score is the marginal of the lattice with all its learned arcs, pieces and counted words; lattice_score that of the pieces alone."""
    scored = lattice_lm.lm_score(table(spark, sf_dir, "documents"), piece_model(), rounds=3)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("mixed_score").alias("score"), F.col("cached_score").alias("mixed_score"), F.col("score").alias("lattice_score"))


def op10_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", "copies", (F.col("copies") > 0).alias("kept"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_line_dedup, op3_quality_rules, op4_sentencepiece, op5_suffix_dedup, op6_sharding, op7_near_dedup, op8_secret_scan, op9_lm_score, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op2_line_dedup": line_dedup.ORACLE, "op10_mixing": mixing.ORACLE}
