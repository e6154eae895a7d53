"""Held-out recall by language, and the cut that scores are moved to."""

import numpy as np

from quire.llm import toxicity


def test_recall_in_every_language(spark):
    d = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    scored = toxicity.score(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "toxic", "predicted").toPandas()
    toxic = scored[scored.toxic == 1].groupby("lang").predicted.agg(["mean", "size"])
    assert (toxic["mean"][toxic["size"] >= 10] >= 0.9).all() and len(toxic) == 4
    assert scored.predicted[scored.toxic == 1].mean() >= 0.92 and scored.predicted[scored.toxic == 0].mean() < 0.005


def test_the_cut_is_amid_the_best_gap():
    z, y = np.array([3.0, 2.0, 2.0, 1.0, -1.0, -5.0]), np.array([1.0, 1.0, 1.0, 0.0, 0.0, 0.0])
    moved = z + toxicity.calibrated(z, y, 0.7)
    assert np.isclose((moved[2] + moved[3]) / 2, np.log(0.7 / 0.3))
    assert np.isfinite(toxicity.calibrated(np.zeros(4), np.array([1.0, 0, 0, 0]), 0.7))
    assert np.isfinite(toxicity.calibrated(np.array([1.0]), np.array([1.0]), 0.7))
