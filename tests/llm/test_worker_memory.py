"""Python workers: one for each running task, and little memory in each."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from storelake.llm import near_dups, toxicity
from storelake.session import ship_package, written

PYTHON = ("ArrowEvalPython", "MapInArrow", "FlatMapGroupsInPandas")


def stacked(df):
    """Pairs of Python steps that share a stage of the plan."""
    above, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        name = re.search(r"[A-Z]\w+", line)
        if not name:
            continue
        above = [x for x in above if x[0] < name.start()]
        if name[0] in PYTHON:
            for _, step in reversed(above):
                if step.endswith("Exchange"):
                    break
                if step in PYTHON:
                    found.append((step, name[0]))
        above.append((name.start(), name[0]))
    return found


@pytest.mark.parametrize("module", [near_dups, toxicity])
def test_no_stage_takes_two_workers_a_task(spark, tmp_path, monkeypatch, module):
    ship_package(spark)
    path = str(tmp_path / "docs")
    rows = [(k, " ".join(f"w{(k // 2) * 7 + j % 40}" for j in range(60)) + f" end{k}",
             "en") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    docs = spark.read.parquet(path)
    found, seen = [], []

    def watched(df, *label):
        seen.append(df)
        found.extend(stacked(df))
        return written(df, *label)

    monkeypatch.setattr(module, "written", watched)
    if module is near_dups:
        assert near_dups.classed(docs).select("root").distinct().count() < 60
    else:
        labels = spark.createDataFrame([(k, k % 2) for k in range(0, 60, 3)],
                                       "doc_id long, toxic int")
        toxicity.train(docs, labels)
    assert seen and not found


def test_memory_of_a_worker_follows_the_slice():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(words[k] for k in rng.integers(0, 5000, 400)) for _ in range(2500)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": list(range(len(texts))), "name": [b""] * len(texts), "text": texts})
    network = toxicity.Trainer().network()
    for work in (lambda: [None for _ in near_dups.signer(5, 4, 3)([batch])],
                 lambda: [None for _ in near_dups.run_sets(5)([batch])],
                 lambda: network.scores(batch.column("text"))):
        tracemalloc.start()
        try:
            work()
            assert tracemalloc.get_traced_memory()[1] < 32 << 20
        finally:
            tracemalloc.stop()
