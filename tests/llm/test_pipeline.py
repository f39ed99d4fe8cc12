"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import gc

import pyarrow as pa
import pytest

import corpus_pipeline
from marketpulse.llm import common, secrets, toxicity

from .conftest import SMALL
from .test_duplicates import brute_groups
from .test_filters import brute_hits


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return [sorted(rows) for rows in out]


def test_each_stage_takes_effect(spark, stages):
    given, clean, single, free, plain, coded = stages
    columns = set(given[0].asDict())
    assert all(set(rows[0].asDict()) == columns for rows in (clean, single, free, plain))
    assert set(clean) <= set(given)

    s = corpus_pipeline.jaccard.Settings(width=5, num=80)
    groups = brute_groups([r.text for r in clean], s)
    assert single == [clean[i] for i, _, first in groups if i == first]

    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert free == [r for r in single if not brute_hits(r.text, items)[4]]

    assert [r.doc_id for r in plain] == [r.doc_id for r in free] == [r.doc_id for r in coded]
    assert not any(secrets.base_spans(r.text) for r in plain)
    assert all(r.n_chars == len(r.text) for r in plain)
    assert [r for r in plain if "[SECRET]" not in r.text] == [
        r for r in free if not secrets.base_spans(r.text)
    ]


def test_toxic_rows_go(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, data).collect()}
    truth = spark.read.parquet(f"{data}/labels.parquet").collect()
    toxic = [r.doc_id in left for r in truth if r.toxic]
    clean = [r.doc_id in left for r in truth if not r.toxic]
    assert sum(toxic) < 0.3 * len(toxic) and sum(clean) > 0.97 * len(clean)


def test_pipeline_keeps_clean_rows(stages):
    assert len(stages[-1]) > 0.5 * len(stages[0])


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(r.doc_id for r in got.collect()) == [r.doc_id for r in stages[-1]]


def test_stages_on_empty_and_odd_rows(spark, odd):
    shape = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    rows = [(r.doc_id, r.text, None, None, None) for r in odd.collect()]
    for docs in (spark.createDataFrame(rows, shape), spark.createDataFrame([], shape)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SMALL).count() >= 0


def test_filters_see_few_rows_at_once():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": ["a b"] * 5000})
    found = list(common.slices(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in found) <= common.SLICE_ROWS
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))


def test_encoding_leaves_no_codec_in_the_workers(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(50)

    def held(batches):
        for _ in batches:
            pass
        kept = [o for o in gc.get_objects() if type(o).__name__ == "PieceCodec"]
        yield pa.RecordBatch.from_pydict({"n": [sum(o.cache == 100_000 for o in kept)]})

    corpus_pipeline.encode(spark, docs, SMALL).collect()
    left = spark.range(64, numPartitions=16).mapInArrow(held, "n long").collect()
    assert sum(r.n for r in left) == 0


def test_counts_do_not_depend_on_how_often_tasks_pass_them_on(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(50)
    sample = docs.selectExpr("text", "cast(doc_id % 2 as int) label").coalesce(1)
    counts = lambda: sorted(toxicity._counts(sample, str.split).collect())
    once = counts()
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 10)
    assert counts() == once and len(once) > 10
