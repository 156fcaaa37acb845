"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame that is written as Parquet and read back as the next
one's ``docs``; all but the last return the columns of ``docs``.

Nulls, empty and repeated rows: a null or empty text has nothing against it and
stays until the packing, where it is one end id; a row without id links with
nothing and stays; rows that repeat id and text stay once. Extra columns are
carried along (n_words, n_removed, removed, score, expected_grade and p_select
are refused, see the operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelens.llm.jaccard_join import ngram_jaccard_join
from tablelens.llm.packing import pack_documents
from tablelens.llm.quality import fit_quality, grade_documents, grades_of_labels
from tablelens.llm.stage import Steps
from tablelens.llm.substring_dedup import remove_repeated_spans

#: Words of a passage that later documents lose when an earlier one holds it.
REPEATED_WORDS = 50

#: Not expressible in SQL (a fitted model, hash walks, a packing heuristic).
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least one half."""
    model = fit_quality(docs, grades_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")), levels=3)
    graded = grade_documents(docs, model, select_grade=2)
    return graded.where("p_select >= 0.5").select(*[f"`{c}`" for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"{name}_"
    return name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that shares five-word
    shingles with a Jaccard similarity of 0.8 or more. Rows are told apart by id
    and text, so an id that occurs with several texts loses only those that
    another row stands for."""
    row, group, gone = (_free(docs, c) for c in ("row", "group", "gone"))
    keyed = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    linked = ngram_jaccard_join(keyed.select(row, "text"), id_col=row, n=5, threshold=(4, 5)).where("n_links > 0")
    members = linked.groupBy(F.col("doc_id").alias(row)).agg(F.min("component_id").alias(group))
    keepers = keyed.select("doc_id", row).join(members, row).groupBy(group).agg(F.min(F.struct("doc_id", row))[row].alias(gone))
    marks = members.join(keepers, group).select(row, (F.col(row) != F.col(gone)).alias(gone))
    joined = keyed.join(marks, row, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # rows of the keeper's id and text are the same document: one of them stays
    again = joined.where(~F.col(gone)).groupBy(row).agg(F.min(F.struct(*columns)).alias(group)).select(f"{group}.*")
    return joined.where(F.col(gone).isNull()).select(*columns).union(again)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document with the smallest id;
    a document of nothing else goes."""
    cut = remove_repeated_spans(docs, window=REPEATED_WORDS, payload="text")
    columns = [F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema[c].dataType)
               .alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cut.where("n_removed = 0 or n_removed < n_words").select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, placed in sequences of at most 2048 tokens."""
    return pack_documents(docs, capacity=2048, payload="ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is a written step."""
    steps = Steps(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = steps.write(name, docs)
            if k:
                steps.drop(STAGES[k - 1][0])
    return docs
