"""What is held at a time: texts that are encoded, vectors that are compared."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import tokens
from millrace.operators import dedup


def test_texts_are_encoded_in_slices(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 10)
    runs = list(tokens._slices(pd.Series(["abcd", None, "efghij", "k", "x" * 30, "", "y"], dtype=object)))
    assert runs == [["abcd", "", "efghij"], ["k"], ["x" * 30], ["", "y"]]


@pytest.mark.parametrize("size", [4, 4096])
def test_cosine_pairs_of_blocks_are_those_of_a_join(spark, monkeypatch, size):
    monkeypatch.setattr(dedup, "VECTORS", size)
    rows = [(i, i % 3, [float((i * 7 + k * 5) % 11) - 5 for k in range(4)]) for i in range(40)]
    rows += [(50, 0, None), (51, 0, [1.0, None, 2.0, 3.0]), (52, 1, [1.0, 2.0]), (53, None, [1.0, 1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0, 1.0]), (54, 2, [float("nan"), 1.0, 1.0, 1.0]), (7, 1, rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").where("vec_id is null or label is null or embedding is null or exists(embedding, x -> x is null or x <> 0)")
    a, b = df.toDF("a", "label", "va"), df.toDF("b", "label", "vb")
    want = a.join(b, "label").where("a < b").select("a", "b", dedup.cosine(F.col("va"), F.col("vb")).alias("cos")).where("cos >= 0.3")
    got = dedup.cosine_pairs(df, "vec_id", "label", "embedding", 0.3)
    key = lambda r: (r["a"], r["b"], str(r["cos"]))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
