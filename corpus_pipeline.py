"""From raw documents to token ids: the stages of a training-data pipeline.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns a
DataFrame, which is written as Parquet and read again before the next stage.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm.bpe import bpe_encode
from xylem.llm.common import read, remove, trim
from xylem.llm.decontaminate import drop_leaks
from xylem.llm.jaccard import one_of_each
from xylem.llm.queries import vocabulary
from xylem.llm.repair import shared_path
from xylem.llm.rlz import substring_dedup
from xylem.llm.toxicity import fit_toxicity, score_toxicity

#: Documents of this score or more are rejected as toxic.
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays below ``TOXIC``; null and empty texts stay."""
    weights, bias = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    trim()  # the driver need not hold the labelled texts any longer
    scored = score_toxicity(docs, weights, bias, sentences=False, into="__toxic")
    return scored.filter(F.col("__toxic") < TOXIC).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, of its least id; null ids stay.

    Five-word shingles, a similarity of 0.8 or more.  Rows are told by id and text: another
    text on a second row of an id is a document of its own, an equal row is a copy.
    """
    return one_of_each(docs).select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages cut, the rest joined by blanks; other texts untouched.

    Null and empty texts stay as they are; rows of one id cut nothing from each other; rows
    without an id keep all words.
    """
    out = substring_dedup(docs, factors=False, prefix="__")
    cut = F.col("__n_removed") > 0
    text = F.when(cut, F.col("__kept_text")).otherwise(F.col("text"))
    size = F.when(cut, F.char_length("__kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks; null and empty texts stay, equal rows go together."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of each row; a null text has no ids."""
    return bpe_encode(docs, vocabulary("word_bpe_49k.json"), digests=True, keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", toxicity), ("simhash near-dedup", near_dedup), ("substring dedup", substring), ("benchmark decontamination", decontamination), ("bpe", bpe)]

#: Fitted scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # the next stage reads this one's files alone
        if before is not None:
            remove(spark, before)
        before = path
    return docs
