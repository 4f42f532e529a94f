"""What the operators cost in Python workers, beside their results."""

import numpy as np
import pytest
from helpers import odd_docs

from epigrid.llm.common import Workspace, few_rows, running_total
from epigrid.llm.near_dedup import without_near_duplicates
from epigrid.llm.packing import pack_documents
from epigrid.llm.tokens import default_vocabulary


def _totals(docs):
    with Workspace(docs.sparkSession, "totals") as ws:
        return running_total(ws, docs.selectExpr("doc_id", "1L as one"), ["doc_id"], "one", "totals").collect()


@pytest.mark.parametrize("run", [without_near_duplicates, lambda d: pack_documents(d, default_vocabulary()), _totals])
def test_small_tables_start_no_second_set_of_workers(spark, run, monkeypatch):
    docs, kind, made = odd_docs(spark), type(spark), []
    was = kind.createDataFrame
    monkeypatch.setattr(kind, "createDataFrame", lambda *a, **b: made.append(was(*a, **b)) or made[-1])
    run(docs)
    assert made and not any("PythonRDD" in df._jdf.queryExecution().toRdd().toDebugString() for df in made)


def test_texts_go_to_near_duplicates_and_packing_in_small_batches(spark):
    for run in (without_near_duplicates, lambda d: pack_documents(d, default_vocabulary())):
        run(odd_docs(spark))
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "2m"


def test_few_rows(spark):
    assert sorted(few_rows(spark, {"a": [1, 2], "b": np.array([3, 4])}, "a int, b long").collect()) == [(1, 3), (2, 4)]
    none = few_rows(spark, {"a": [], "b": []}, "a int, b long")
    assert none.dtypes == [("a", "int"), ("b", "bigint")] and none.count() == 0
