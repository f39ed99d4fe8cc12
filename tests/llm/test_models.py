"""Quality classifier and toxicity lexicon."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from marketpulse.llm import labelled, quality_model, toxicity
from marketpulse.llm.registry import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("name", "label", "modulus", "rest", "least"),
    [("op3_quality_classifier", "quality", 3, 1, 0.93), ("op9_toxicity", "toxic", 5, 0, 0.93)],
)
def test_held_out_accuracy(spark, name, label, modulus, rest, least):
    rows = QUERIES[name](spark, DATA).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(judged) >= least


def test_sample_bounds_the_rows_learned_from(spark):
    rows = [(i, f"text {i}") for i in range(50)] + [(7, f"more {i % 200}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = range(1000, 3000)
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(50), *gone)], "doc_id long, y int")
    for most, want in ((20, 20), (100, 100), (5000, 250)):
        got = [tuple(r) for r in labelled.sample(docs, labels, "y", 5, -1, most).collect()]
        assert len(got) == len(set(got)) == want
        assert {r[:2] for r in got} <= set(rows) and all(r[2] == r[0] % 2 for r in got)


def test_disguises_fold_to_the_same_word():
    for text in ("M0ron", "mörön", "mоron", "ＭＯＲＯＮ", "m0r0n!"):  # noqa: RUF001
        assert "moron" in toxicity.folded(text)
    assert toxicity.folded("1d10t") == toxicity.folded("Idiot")
    assert toxicity.folded("in 2015 for $5").split() == ["in", "for"]
    assert toxicity.folded("").split() == []


def test_exception_phrases_cancel_an_entry():
    lexicon = toxicity.Lexicon({" ciown ": 5.0}, frozenset({" ciown fish "}), (1.0, 1.0, 1.0, -1.0))
    m = toxicity.Matcher(lexicon)
    assert m.features("the clown fish")[0] == 0
    assert m.features("the clown ate a clown fish")[0] > 0
    assert m.score("you clown") > m.score("a clown fish")


def test_lexicon_is_learned(spark):
    rows = [(i, ("the vile words " if i % 2 else "some fine words ") + f"x{i}", i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.fit(frame)
    assert any(e.startswith(" vii") for e in lexicon.weights)  # "vile", folded
    m = toxicity.Matcher(lexicon)
    assert m.score("the v1le words") > 0.5 > m.score("some fine words")


def test_network_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(float)  # no straight line parts these
    layers = quality_model.train(x, y, quality_model.Settings(epochs=150))
    z = quality_model.forward(layers, x)[1]
    assert ((z > 0) == y).mean() > 0.9
    t = quality_model.temperature(3 * z, y)
    loss = lambda s: -np.mean(
        np.log(np.clip(labelled.sigmoid(np.where(y, s, -s)), 1e-9, 1))
    )
    assert loss(3 * z / t) <= loss(3 * z) + 1e-9


def test_pooling_of_nothing():
    vectors = quality_model.index_vectors(quality_model.Settings(buckets=64))
    assert not quality_model.pooled(np.empty(0, np.int64), vectors).any()
    assert (np.abs(vectors).sum(axis=1) == 4).all()


def test_models_on_odd_rows(odd, none, labels_of):
    for fn in (quality_model.quality_scores, toxicity.toxicity_scores):
        rows = fn(odd, labels_of).collect()
        assert len(rows) == 9 and not [r for r in rows if r.doc_id is None and r.held_out]
        assert fn(none, labels_of).count() == 0
        assert fn(odd, labels_of.limit(0)).count() == 9


def test_toxic_rows_go_with_all_columns(odd):
    lexicon = toxicity.Lexicon({" iorem ": 5.0}, frozenset(), (5.0, 5.0, 0.0, -3.0))
    kept = toxicity.drop_toxic(odd, lexicon)
    assert kept.columns == odd.columns and kept.count() == 8
