"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage reads the columns of documents only, so further ones, whatever their names, do no harm. Null texts go in the
first stage; rows with a null doc_id stay and are told apart by their texts. Repeated rows, very long texts and empty
tables are taken by every stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomread.llm.decontamination import decontaminate
from loomread.llm.nearest import near_groups
from loomread.llm.pieces import encode_texts
from loomread.llm.rules import quality_cascade
from loomread.llm.suffixes import remove_repeats
from loomread.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark, docs, sf_dir):
    """Documents that no quality rule rejects; a null text counts as empty and goes."""
    return quality_cascade(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """The document with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8).

    Rows with a null doc_id stay; of rows with equal doc_ids all stay or go together.
    """
    docs = docs.select(COLUMNS)
    kept = near_groups(docs, k=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(COLUMNS)


def suffix_dedup(spark, docs, sf_dir):
    """Texts without passages of 50 bytes or more that a document with a smaller doc_id has too; n_chars follows.

    A document of which nothing but white space is left goes, as it said nothing of its own.
    """
    out = remove_repeats(docs.select(COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination(spark, docs, sf_dir):
    """Documents without a window of ten words, or a whole shorter item, of ``benchmark``."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text"))
    return decontaminate(docs.select(COLUMNS), bench).select(COLUMNS)


def sentencepiece(spark, docs, sf_dir):
    """Each document's encoding: pieces, and scores and digests of the ids of its three best segmentations."""
    return encode_texts(docs.select(COLUMNS), ids=False).select("doc_id", "lang", "source", "n_chars", "n_pieces", "best_score", "scores", "ids_sha256", "round_trip", "n_best_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Stages 2, 3 and 5 can't be said in SQL at these sizes; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
