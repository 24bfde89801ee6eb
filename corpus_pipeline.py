"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder and reads
it back as the next one's docs. All but the last return the columns of documents, whatever these are: columns besides doc_id and
text travel along, and none of their names clashes. Empty tables go through all stages, and texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import stored
from barloom.llm.decontaminate import contamination
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.near_dedup import near_duplicates
from barloom.llm.packing import pack_documents
from barloom.llm.toxicity import score_column, train


def _named(docs: DataFrame) -> list[F.Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 stay, by a classifier fitted on this stage's own documents. A null text is scored as an empty
    one, and repeated rows score alike. Other columns travel as a struct."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select(F.struct(*_named(docs)).alias("row"), score_column(spark, model).alias("score"))
    return scored.filter("score < 0.3").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two or more lines go; a document that loses its whole text goes too. Null and empty texts stay as they are,
    and rows with equal doc_id and text share one fate."""
    return dedup_lines(docs, count=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8.

    Of rows with equal doc_id and text one stays. Rows whose doc_id is null, and texts without words, are no one's copies and stay.
    """
    gone = near_duplicates(docs).filter("not kept").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*_named(docs))
    several = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    once = kept.join(several, "doc_id", "left_anti").select(*_named(docs))
    return once.union(kept.join(several, "doc_id", "left_semi").select(*_named(docs)).dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go, each row on its own, repeated ones alike. A null or empty text holds none. Other
    columns travel as a struct."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("item_ids") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence of 4096 ids, and their ids as little-endian unsigned 32-bit integers. A null or
    empty text is one piece with the end id alone; repeated rows are packed each. Other columns are left out."""
    return pack_documents(docs, with_ids=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The fitted classifier, connected components and the packing aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
