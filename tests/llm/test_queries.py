"""Registered queries against their SQL, and the pipeline against a plain version."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check import TABLES, canonical
from tests.llm import brute
from tests.llm.awkward import clash, texts
from trailmesh.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def database(folder=FOLDER):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), database().execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def rest_of(docs, con):
    """Plain stages over a pandas frame of documents."""
    con.register("given", docs)
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM given")
    scored = con.execute(queries.ORACLES["op1_quality"]).df()
    docs = docs[docs.doc_id.isin(scored[scored.kept].doc_id)]
    kept = brute.repeated_lines(list(zip(docs.doc_id, docs.text, strict=True)))
    docs = docs.assign(text=docs.doc_id.map(kept), before=docs.text)
    docs = docs[(docs.text != "") | (docs.before == "")].drop(columns="before")
    found = brute.near_duplicates(list(zip(docs.doc_id, docs.text, strict=True)), 5, 80)
    docs = docs[[found[i][1] == i for i in docs.doc_id]]
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    bad = {d for d, _ in brute.contaminated(list(zip(docs.doc_id, docs.text, strict=True)), items)}
    return docs[~docs.doc_id.isin(bad)]


def test_pipeline_equals_plain_stages(spark):
    con = database()
    docs = con.execute("SELECT * FROM documents").df()
    want = rest_of(docs, con)
    assert 0 < len(want) < len(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert set(pieces.doc_id) == set(want.doc_id)
    for doc, rows in pieces.sort_values("start").groupby("doc_id"):
        ids = tokenizer.encode(want[want.doc_id == doc].text.iloc[0], add_special_tokens=False).ids + [2]
        assert b"".join(rows.ids) == np.array(ids, "<u4").tobytes()


def test_stages_survive_awkward_rows(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(i, t, None if i == 3 else "en", None, len(t or "")) for i, t in texts()]
    given = spark.createDataFrame(rows, schema)
    for docs in (clash(given).withColumn("n_lines", F.lit(1)), given, spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r[0] for r in rows}
        assert corpus_pipeline.packed(spark, docs, FOLDER).columns[0] == "doc_id"
