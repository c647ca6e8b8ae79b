"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.warc import archive_round_trip

    back = archive_round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS top FROM d GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d JOIN g USING (h)
"""

#: No document is read more than twice as often as another by the production mixture.
MOST_REPETITIONS = 2.0


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.mixing import Target, mix

    out = mix(_table(spark, sf_dir, "documents"), Target(repetitions=MOST_REPETITIONS))
    return out.select(*[F.col(f"_mix_{a}").alias(b) for a, b in (("id", "doc_id"), ("source", "source"), ("tokens", "n_tokens"), ("epoch", "epoch"), ("block", "block"), ("weight", "weight"))])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm import toxicity as t

    docs = _table(spark, sf_dir, "documents")
    held_out = t.in_fold(F.col("doc_id"), 4, 2)
    model = t.train(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    return t.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= t.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.lm_scoring import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


#: Passages of over 50 words that documents share are told even where they are too short to be cut.
PASSAGE = 51


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deltaview.llm.suffix_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), passage=PASSAGE)
    return out.withColumns({"n_kept": F.col("n_bytes") - F.col("n_removed"), "changed": F.col("n_removed") > 0})


QUERIES = {
    "op4_suffix_dedup": op4_suffix_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op5_toxicity": op5_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op3_quality": op3_quality,
    "op6_packing": op6_packing,
    "op1_source_mixing": op1_source_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_warc": op10_warc,
}
SQL = {"op8_exact_dedup": OP8_SQL, "op10_warc": OP10_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
