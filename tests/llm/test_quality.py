"""Quality classifier: held-out accuracy, determinism, odd rows."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm.quality import fit_ordinal, fit_quality, grade_documents, grades_of_labels


def test_held_out_accuracy(llm_spark):
    d = "/root/testdata/sf0.1"
    docs = llm_spark.read.parquet(f"{d}/documents.parquet")
    grades = grades_of_labels(llm_spark.read.parquet(f"{d}/labels.parquet")).where("grade is not null")
    train, test = grades.where("pmod(doc_id, 5) <> 0"), grades.where("pmod(doc_id, 5) = 0")
    model = fit_quality(docs, train, levels=3)
    assert list(model.cuts) == sorted(model.cuts)
    graded = grade_documents(docs.join(F.broadcast(test), "doc_id"), model, 2)
    rows = graded.groupBy("grade").agg(F.avg((F.col("p_select") >= 0.5).cast("int")).alias("kept"),
                                       F.avg("expected_grade").alias("mean")).collect()
    kept = {r["grade"]: r["kept"] for r in rows}
    mean = {r["grade"]: r["mean"] for r in rows}
    assert kept[2] > 0.97 and kept[1] < 0.05 and kept[0] < 0.05
    assert mean[0] < mean[1] < mean[2]


def test_odd_rows(llm_spark, edge, empty):
    ratings = llm_spark.createDataFrame([(4, 2), (4, 1), (11, 0), (99, 1), (None, 2), (6, None), (7, 5)],
                                        "doc_id long, grade int")
    model = fit_quality(edge, ratings, levels=3)
    rows = grade_documents(edge, model, 2).collect()
    assert len(rows) == edge.count() and all(0 <= r["p_select"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    again = [r["score"] for r in rows if r["text"] == "one two"]
    assert len(set(again)) == 1
    assert grade_documents(empty, model, 2).count() == 0
    with pytest.raises(ValueError):
        grade_documents(edge.withColumnRenamed("key", "score"), model, 2)


def test_no_ratings_keep_all(llm_spark, edge, empty):
    none = llm_spark.createDataFrame([], "doc_id long, grade int")
    model = fit_quality(edge, none, levels=3)
    assert {r["p_select"] for r in grade_documents(edge, model, 2).collect()} == {1.0}


def test_fit_needs_little_memory_beside_the_marks():
    """Marks are counted and numbered text by text: besides them and the telling
    ones the fit holds no further copies of all marks."""
    random = np.random.RandomState(0)
    marks = [np.unique((random.random_sample(2500) ** 4 * (1 << 18)).astype(np.int32)) for _ in range(1500)]
    grades = random.randint(0, 3, len(marks))
    tracemalloc.start()
    try:
        index, weight, cuts = fit_ordinal(marks, grades, 3, epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index) == len(weight) and list(cuts) == sorted(cuts)
    assert peak < 3 * sum(m.nbytes for m in marks)
