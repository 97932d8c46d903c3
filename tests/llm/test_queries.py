"""The queries of the subpackage on the smallest tables, and the pipeline against a plain version."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import check  # noqa: E402
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402
from measurelens.llm import queries  # noqa: E402
from measurelens.operators.common import settle  # noqa: E402

QUERIES, SQL = queries.load()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    import duckdb

    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in SQL:
        con = duckdb.connect()
        for t in check.TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        cur = con.execute(SQL[name])
        assert check.compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) is None


def test_pipeline_stages(spark, sf_dir):
    """Every stage does its own job on what the stage before kept."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    frames = [source]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(settle(stage(spark, frames[-1], sf_dir)))
    for before, after in zip(frames[:4], frames[1:5]):
        assert after.columns == before.columns
    text = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:5]]
    # toxic ones only go: no labelled clean document of the training rows is lost
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()} & set(text[0])
    assert len(clean - set(text[1])) <= 0.02 * len(clean)
    found = plain.components(sorted(text[1].items()))
    assert set(text[2]) == {d for d, _, c in found if d == c}
    assert set(text[3]) == {d for d, _, hits, _ in plain.contamination(text[2].items(), items) if not hits}
    assert set(text[4]) == set(text[3])
    assert all(text[4][d] == text[3][d] for d in text[3] if not plain.secrets(text[3][d]))
    assert not any(plain.secrets(t) for t in text[4].values())
    assert {r.doc_id for r in frames[5].collect()} == set(text[4])


def test_pipeline_without_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    assert docs.count() == 0


def test_pipeline_deduplicates_rows(spark, sf_dir):
    """One row of each group of similar texts stays, whatever ids the rows have."""
    base = [f"b{i}" for i in range(60)]
    near = " ".join([*base[:59], "edited"])
    base = " ".join(base)
    rows = [(5, base), (5, "all alone here"), (5, "alone as well"), (3, base), (4, near), (None, near), (None, "never seen"), (None, "never seen"), (6, "twice"), (6, "twice"), (9, ""), (9, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, {"k": i}) for i, t in rows], "doc_id long, text string, more map<string,long>")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, sf_dir).collect()]
    want = [(5, "all alone here"), (5, "alone as well"), (3, base), (None, "never seen"), (6, "twice"), (9, ""), (9, None), (None, " ")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_odd_rows(spark, sf_dir, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        assert docs.columns == odd_docs.columns
    clash = docs.select("SCORE", "ids", "spans", "n_words", "fingerprint").distinct().collect()
    assert [tuple(r) for r in clash] == [(0.5, "clash", 7, "clash", 1)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() > 0
