"""The pipeline's result against each stage computed again, document by document, in plain Python."""

from __future__ import annotations

import re

import numpy as np

import corpus_pipeline
from tests.llm.test_scans import base_secrets, contaminated
from tests.llm.test_simhash import near_groups
from tidemark.llm import mixing, quality
from tidemark.llm.common import staged, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(text):
    spans, out, at = sorted((a, b) for _, a, b in base_secrets(text)), "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_run_equals_the_stages_in_plain_python(spark):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [tuple(r[c] for c in COLUMNS) for r in docs.orderBy("doc_id").collect()]

    model = quality.fit(staged(quality._viewed(docs)), labels)
    a, b = (np.array([f(r) for r in rows]) for f in (lambda r: quality.text_view(r[1]), lambda r: quality.meta_view(*r[1:])))
    rows = [r for r, s in zip(rows, model.scores(a, b)[2], strict=True) if s >= 0.3]
    assert 0.5 * docs.count() < len(rows) < docs.count()

    lead = near_groups([r[1] for r in rows])
    before = len(rows)
    rows = [r for k, r in enumerate(rows) if lead[k] == k]
    assert len(rows) < before

    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = [r for r in rows if not contaminated(r[1], items)[1]]
    rows = [(r[0], m := masked(r[1]), r[2], r[3], len(m)) for r in rows]
    assert got and all(not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"]) for r in got.values())

    # the same rows in the same stage give the same fit
    kept = staged(spark.createDataFrame(rows, docs.schema))
    domain = mixing.fit_domains(kept, labels)
    p, tokens = domain.posterior([r[1] for r in rows]), np.array([len(r[1].split()) for r in rows])
    target = np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS]) * tokens.sum()
    rates = np.ones(len(rows))
    for _ in range(40):
        totals = (tokens * rates) @ p
        if np.abs(totals - target).max() <= 1e-4 * tokens.sum():
            break
        rates = np.maximum(0, rates - p @ ((totals - target) / (tokens @ p)))
    want = {r[0]: (r[1], r[4], x) for r, x in zip(rows, rates, strict=True)}
    assert {k for k, (_, _, x) in want.items() if x >= 1} <= set(got) <= {k for k, (_, _, x) in want.items() if x > 0}
    for k, r in got.items():
        assert (r["text"], r["n_chars"]) == want[k][:2]
        assert abs(r["rate"] - want[k][2]) < 1e-5 and abs(r["copies"] - r["rate"]) < 1 and r["copies"] >= 1


def test_stages_are_in_order_and_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "mixing",
    ]
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, odd_documents):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, odd_documents, SF)
        assert set(odd_documents.columns) <= set(docs.columns)
        assert docs.count() <= 8
        assert stage(spark, odd_documents.limit(0), SF).count() == 0
