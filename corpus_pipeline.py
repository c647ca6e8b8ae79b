"""A training-data pipeline over ``documents``: reject poor texts, drop copies and near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it again as the next stage's documents. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.llm._rows import text_key, without_texts
from deltaview.llm._store import Scratch
from deltaview.llm.exact_dedup import keep_first
from deltaview.llm.jaccard_join import one_of_each
from deltaview.llm.mixing import Target, mixed_documents
from deltaview.llm.packing import pack
from deltaview.llm.quality import classify

#: No source is read more than twice as often as another, and every document at least once.
MOST_REPETITIONS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Defined results: the decision is one of the text, so rows with a null id and repeated rows follow
    their text; a null text is judged as the empty one; without labels of two grades all stay; an empty
    table stays empty; further columns are kept, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    judged = classify(texts, labels, fit_on=docs.select("doc_id", "text"))
    rejected = judged.filter("NOT accepted").select(F.col("doc_id").alias("key")).distinct()
    return without_texts(docs, Scratch(spark, "quality").save(rejected, "rejected"), "text")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id.

    Defined results: a null text equals the empty one; a null id comes after all others; of rows that
    repeat id and text one stays; an empty table stays empty; further columns are kept.
    """
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Defined results: the smallest doc_id of a group stays, a null id after all others; texts without
    words all stay; rows that repeat id and text stay or go together; an empty table stays empty;
    further columns are kept.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them.

    Defined results: a null source is a source, a null id an id; empty and null texts count one token;
    repeated rows are read on their own; an empty table stays empty; further columns are kept.
    """
    return mixed_documents(docs, Target(repetitions=MOST_REPETITIONS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their place in sequences.

    Defined results: null and empty texts are the end alone; a null id is kept; repeated rows are
    packed on their own; an empty table gives no piece.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier and the tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
