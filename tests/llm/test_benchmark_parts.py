"""Many parts of a benchmark: the same results as one part, one Python stage, one part's index at a time; ids of text."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorlab.llm import decontamination as D

SF = "/root/testdata/sf0.001"


def report(docs, bench):
    return sorted(map(str, D.digest(D.scan(docs, bench)).collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3), spark.read.parquet(f"{SF}/benchmark.parquet")


def test_parts_change_nothing(tables, monkeypatch):
    docs, bench = tables
    want = report(docs, bench)
    monkeypatch.setattr(D, "PASS_BYTES", 400)
    many = D.scan(docs, bench)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, D.digest(many).collect())) == want


def test_one_index_at_a_time(tables, monkeypatch):
    """Inside a task the parts are let go of one by one."""
    docs, bench = tables
    monkeypatch.setattr(D, "PASS_BYTES", 400)
    held = []

    class Part:
        def __init__(self, value):
            self.index = value

        @property
        def value(self):
            self._value = self.index
            held.append(sum("_value" in vars(p) for p in parts))
            return self._value

    parts, caught = [], {}
    monkeypatch.setattr(type(docs.sparkSession.sparkContext), "broadcast", lambda self, value: parts.append(Part(value)) or parts[-1])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: caught.update(work=work) or self)
    D.scan(docs, bench)
    batch = pa.RecordBatch.from_pylist([{"doc_id": r.doc_id, "text": r.text} for r in docs.limit(20).collect()])
    out = list(caught["work"](iter([batch, batch])))
    assert len(parts) > 10 and set(held) == {1} and [b.num_rows for b in out] == [20, 20]


@pytest.mark.parametrize("size", [8 << 20, 300])
def test_ids_of_text(spark, tables, monkeypatch, size):
    docs, bench = tables
    named = bench.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("item_id"), "text")
    monkeypatch.setattr(D, "PASS_BYTES", size)
    got = {r.doc_id: r for r in D.digest(D.scan(docs, named)).collect()}
    want = {r.doc_id: r for r in D.digest(D.scan(docs, bench)).collect()}
    assert any(r.n_items for r in want.values())
    for i, r in want.items():
        assert (got[i].n_hit, got[i].n_items, got[i].longest_words) == (r.n_hit, r.n_items, r.longest_words)
        assert (got[i].longest_item is None) == (r.longest_item is None)
    assert D.scan(docs, spark.createDataFrame([("", "x y z"), (None, "a b"), ("b", None)], "item_id string, text string")).count() == docs.count()
