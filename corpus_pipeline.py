"""The corpus pipeline: stages over `documents`, each by one operator of millrace.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Null and empty texts and null ids are judged like any others and stay if they aren't
    rejected; rows that repeat get the same verdict. Without labels nothing is rejected.
    An empty table gives no rows; further columns of `docs` are left out.
    """
    from millrace.llm.toxicity import toxicity_scores, train_toxicity

    chain = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_scores(docs.select(*COLUMNS), chain).where("not is_toxic").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component stays; a document all of whose lines were copies goes.

    Null and empty texts stay as they are. Rows that repeat id and text are one document
    and lose the same lines. Ties go to the smallest (id, position). An empty table gives
    no rows; further columns of `docs` are left out.
    """
    from millrace.llm.line_dedup import dedup_lines

    kept = dedup_lines(docs.select(*COLUMNS))
    return _documents(kept.where("n_removed = 0 or n_removed < n_lines"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one that gives the group its id.

    Near duplicates share at least 0.8 of their five-word shingles. Of a group the smallest
    id stays; rows that repeat id and text are one document and stay once. Null and empty
    texts and null ids belong to no group. An empty table gives no rows; further columns of
    `docs` are left out.
    """
    from millrace.llm.ngram_join import ngram_components

    groups = ngram_components(docs, n=5, percent=80).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    kept = docs.select(*COLUMNS).join(groups, F.col("doc_id") == F.col("_copy"), "left_anti")
    kept = kept.withColumn("_key", F.xxhash64("doc_id", "text"))
    # narrow rows tell which documents repeat; only their texts are shuffled
    again = kept.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key")
    once = kept.join(again, "_key", "left_anti").select(*COLUMNS)
    return once.unionByName(kept.join(again, "_key", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null and empty texts stay. Rows that share an id go together. An empty table or an
    empty benchmark is no error; further columns of `docs` are left out.
    """
    from millrace.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids.

    A null or empty text is its end id alone; null and repeated ids are packed like any
    others. An empty table gives no rows; columns other than id and text are ignored.
    """
    import public_tokenizers

    from millrace.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]
#: Training, MinHash, components and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to `documents`; what a stage returns is written and read again.

    The table that a stage has read goes once the next one is written.
    """
    from millrace.llm.runtime import discard, materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
