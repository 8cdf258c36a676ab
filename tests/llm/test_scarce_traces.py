"""Mixing when toxic and low-quality text is scarcer than its weight."""

from __future__ import annotations

import numpy as np

from tests.llm.test_models import LABEL, PLAIN
from tidemark.llm import mixing


def test_clean_documents_stay_when_traces_are_scarce(spark, documents):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(PLAIN, 30)) + "." for _ in range(600)]
    for k in range(0, 600, 100):
        texts[k] += " zorkel zorkelin quumpf zorkel"
        texts[k + 50] = " ".join(w.upper() + "!!" for w in texts[k + 50].split())
    labels = [(k, int(k % 100 != 50), int(k % 100 == 0)) for k in range(600)]
    drawn = {r["doc_id"]: r["copies"] for r in mixing.sampled(documents(texts), spark.createDataFrame(labels, LABEL)).collect()}
    assert all(drawn.get(k, 0) >= 1 for k, q, t in labels if q and not t)


def test_scarce_traces_are_not_multiplied(spark):
    rows = [(10, 1.0, 0.0, 0.0)] * 990 + [(10, 0.0, 1.0, 0.0)] * 5 + [(10, 0.0, 0.0, 1.0)] * 5
    members = spark.createDataFrame(rows, "tokens bigint, p_clean double, p_low_quality double, p_toxic double")
    steps, totals, target = mixing.solve(members, mixing.WEIGHTS, 1.0, traces=mixing.TRACES)
    assert np.allclose(mixing.rates_after(np.eye(3), steps), 1, atol=1e-3) and target["toxic"] == 50
