"""From raw documents to token ids, in stages; each works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from treelens.llm import line_dedup, minhash, mixing, pieces, quality
from treelens.llm.common import Scratch, table
from treelens.llm.queries import piece_model

#: Percent of shingles from which documents are near-duplicates here (op7's query has its own 85), and coordinates
#: that must match: a pair exactly at the threshold is missed with probability 1e-6.
SIMILAR, SIMILAR_MATCHES = 80, 14


def packed(docs):
    """(doc_id, text, rest): what no stage looks at is in one column, so that no name can clash with a stage's own."""
    rest = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("-"), *rest).alias("rest"))


def unpacked(rows, docs):
    """``rows`` with the columns of ``docs``."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns])


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rules or are unlike the trusted ones go.

    Null and short texts fail the base rules; rows that repeat an id are judged
    each; without labels the base rules decide; an empty table stays empty.
    """
    return unpacked(quality.quality(packed(docs), table(spark, sf_dir, "labels")).where("kept"), docs)


def common_lines(spark, docs, sf_dir):
    """Lines that three documents or more share stay in one of them; n_chars, where there is one, follows the text.

    Every row stays; a null text becomes an empty one.  Rows that repeat an id,
    and all rows without one, count as one document.
    """
    cut = unpacked(line_dedup.line_dedup(packed(docs)), docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays; of rows without an id and with one text, one row.

    Texts without a word are near nothing and stay.  Rows that repeat an id are
    one document and stay or go together.
    """
    rows, docs = docs, packed(docs)
    kept = minhash.near_dedup(docs, percent=SIMILAR, matches=SIMILAR_MATCHES, with_key=True).where("kept")
    kept = kept.select(F.col("key").alias("kept_key"), F.col("doc_id").isNull().alias("nameless")).distinct()
    alone = F.col("doc_id").isNotNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t-\\r]")
    once = docs.where(alone).unionByName(docs.where(~alone).dropDuplicates(["text"]))
    return unpacked(once.join(kept, (minhash.key_of() == F.col("kept_key")) & (F.col("doc_id").isNull() == F.col("nameless")), "left_semi"), rows)


def mixed(spark, docs, sf_dir):
    """Each document as many times as epochs of its leaf take it.

    Null languages and sources are leaves of their own; a null text has no
    token and is taken with the whole epochs of its leaf.
    """
    own = packed(docs).withColumns({c: F.col("rest")[c] for c in ("lang", "source")})
    dealt = mixing.mix(own).where("copies > 0")
    return unpacked(dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def token_ids(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row; a null text has the end id only."""
    return pieces.tokenize(docs, piece_model())


STAGES = [("quality_rules", quality_rules), ("line_dedup", common_lines), ("near_dedup", near_duplicates), ("mixing", mixed), ("sentencepiece", token_ids)]
#: Hashed n-grams and signatures are not for SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
