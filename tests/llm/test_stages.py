"""Stages of the pipeline."""

from pyspark.sql import functions as F

import corpus_pipeline
from trailmesh.llm import lines


def test_line_dedup_of_the_pipeline_carries_each_text_once(spark, monkeypatch):
    seen = []
    real = lines.without_repeated_lines
    monkeypatch.setattr(lines, "without_repeated_lines", lambda docs: seen.append(docs.schema) or real(docs))
    block = "one line of twelve words that many documents here will share again today"
    rows = [(1, block, "x", 73), (2, f"{block}\nmore", "y", 78), (3, None, "z", None), (None, "t", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, n_chars long")
    got = corpus_pipeline.without_repeated_lines(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [
        got.collect()[0].__class__(doc_id=a, text=b, n_removed=c, n_chars=d) for a, b, c, d in (
            (1, block, "x", 73), (2, "more", "y", 4), (3, None, "z", None), (None, "t", None, 1))]))
    assert "text" not in seen[0]["_row"].dataType.names
    only = corpus_pipeline.without_repeated_lines(spark, docs.select("doc_id", "text"), "")
    assert only.filter(F.col("doc_id") == 2).first().text == "more"
