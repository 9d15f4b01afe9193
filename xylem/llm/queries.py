"""The training-data queries (``op1_`` to ``op10_`` and ``pipeline``) and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; ``XYLEM_TOKENIZERS`` names another folder."""
    folder = os.environ.get("XYLEM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, vocabulary("word_bpe_49k.json"), ids=False, digests=True, keep=["doc_id"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rlz import substring_dedup

    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), factors=False, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id"])


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdtree import exact_topk

    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, pages_to_responses

    out = derivatives(pages_to_responses(read(spark, sf_dir, "pages")))
    return out.withColumnRenamed("key", "page_id").drop("error")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out
    from .toxicity import fit_toxicity, score_toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights, bias = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    out = score_toxicity(docs, weights, bias, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import read_token_files, shared_path, write_token_files

    path = shared_path(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("word_bpe_49k.json"))
    return read_token_files(spark, path, ids=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import held_out
    from .quality import fit_quality, score_quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    table, bias = fit_quality(docs, read(spark, sf_dir, "labels"))
    out = score_quality(docs, table, bias, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_substring_dedup, op3_token_counts, op4_exact_topk, op5_warc, op6_toxicity, op7_decontaminate, op8_token_files, op9_quality, op10_simhash, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_SQL = {
    "op2_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), t AS (
  SELECT doc_id, ws, len(ws) AS n, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) AS p FROM w
), g AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM t
), f AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM g JOIN f USING (g) WHERE first < doc_id
), c AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ws[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
""",
    "op4_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
