"""Trained operators: gradients, held-out accuracy and plain versions of what they compute."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, pseudo_likelihood, quality, tagger, toxicity

LABEL = "doc_id bigint, quality int, toxic int"
PLAIN = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnr"]


def corpus(n, seed=1):
    """Texts with their quality and toxicity: shouting junk, and insults with free endings."""
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(20, 60))]
        toxic, low = int(rng.random() < 0.25), int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("zorkel", "zorkelin", "zorkelas", "quumpf")))
        text = " ".join(words) + "."
        if low:
            text = " ".join(w.upper() + "!!" for w in words)
        texts.append(text)
        labels.append((k, 1 - low, toxic))
    return texts, labels


@pytest.fixture(scope="module")
def labelled_corpus(spark, documents):
    texts, labels = corpus(500)
    return documents(texts), spark.createDataFrame(labels, LABEL).repartition(3), labels


def test_toxicity_on_held_out_rows(labelled_corpus, odd_documents, spark):
    docs, labels, truth = labelled_corpus
    held = F.col("doc_id") % 4 == 2
    model = toxicity.fit(docs, labels, ~held)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs.drop("lang"), model).collect()}
    right = [got[k]["predicted"] == t for k, _, t in truth if k % 4 == 2]
    assert np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = toxicity.toxicity(odd_documents, model).collect()
    assert len(odd) == 8 and len({r["score"] for r in odd}) == 1 and not any(r["predicted"] for r in odd)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none.weights == {} and 0 < none.score("x") < 0.3
    assert 0 < toxicity.fit(odd_documents.limit(0), spark.createDataFrame([], LABEL)).score(None) < 1


def test_toxicity_learns_from_positive_labels_alone(labelled_corpus, spark):
    docs, labels, truth = labelled_corpus
    held = F.col("doc_id") % 4 == 2
    # half of the toxic rows are confirmed; nothing else has a label, so the rest is unlabelled with toxic rows in it
    model = toxicity.fit(docs, labels.where("toxic = 1 AND crc32(cast(doc_id AS string)) % 2 = 0").drop("quality").withColumn("quality", F.lit(None)), ~held)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, model).collect()}
    assert model.weights and np.mean([got[k] == t for k, _, t in truth if k % 4 == 2]) > 0.95
    everything = toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic"), F.lit(0).alias("quality")))
    assert not everything.weights and everything.score("any text") < 0.3  # no unlabelled text to learn from


def test_prior_is_estimated_from_unlabelled_rows():
    rng = np.random.default_rng(1)
    positive = np.r_[np.ones(400), np.zeros(4_000)]
    toxic = np.r_[np.ones(400), (rng.random(4_000) < 0.1)].astype(bool)
    held = rng.random((4_400, 6)) < np.where(toxic[:, None], 0.5, 0.01)
    rows, cols = np.nonzero(held)
    assert 0.07 < toxicity.estimated_prior(rows, cols, 4_400, 6, positive) < 0.14


def test_calibration_raises_scores_to_the_prior_and_never_lowers_them():
    positive, f = np.r_[np.ones(50), np.zeros(950)], np.r_[np.full(100, 3.0), np.full(900, -4.0)]
    assert toxicity.calibrated(f, positive, 0.01)[1] < 1e-6  # the mean posterior is above the prior already
    scale, shift = toxicity.calibrated(f, positive, 0.06)
    assert scale == 2.0 and 0 < shift <= 1.0


def test_toxicity_reads_whole_texts(labelled_corpus):
    docs, labels, _ = labelled_corpus
    model = toxicity.fit(docs, labels)
    assert model.score("bal " * 50_000 + "zorkel quumpf zorkelin") > 0.5 > model.score("bal " * 50_000)


def test_pu_risk_is_never_stepped_below_zero():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.2
    marked = (truth & (rng.random(2000) < 0.5)).astype(float)  # half of the positives are confirmed
    held = truth & (rng.random(2000) < 0.95)
    rows = np.nonzero(held)[0]
    w, b = toxicity.fit_nonnegative_pu(rows, np.zeros(len(rows), dtype=int), 2000, 1, marked, 0.2)
    score = b + w[0] * held
    assert ((score > 0) == truth).mean() > 0.97  # unconfirmed positives are recognized as well


def test_quality_cotraining(labelled_corpus, odd_documents, spark):
    docs, labels, truth = labelled_corpus
    some = labels.where("doc_id % 3 <> 0")  # the others are the pool
    got = {r["doc_id"]: r for r in quality.quality(docs, some, per_class=20).collect()}
    assert np.mean([got[k]["keep"] == bool(q) for k, q, _ in truth if k % 3 == 0]) > 0.97
    kept = {r["doc_id"] for r in quality.kept(docs, some, per_class=20).collect()}
    assert kept == {k for k, r in got.items() if r["keep"]}
    odd = quality.quality(odd_documents, labels).collect()
    assert len(odd) == 8 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.quality(odd_documents.limit(0), spark.createDataFrame([], LABEL)).count() == 0
    assert all(r["keep"] for r in quality.quality(docs.drop("source", "n_chars"), labels.where("quality = 1")).collect())


def test_mixing_reaches_its_targets(labelled_corpus, odd_documents, spark):
    docs, labels, truth = labelled_corpus
    rows = mixing.mixed(docs, labels, {"clean": 0.7, "low_quality": 0.2, "toxic": 0.1}, budget=0.8, traces=()).collect()
    assert {r["off_target"] for r in rows} == {""}
    total = sum(r["tokens"] for r in rows)
    for domain, share in (("clean", 0.7), ("low_quality", 0.2), ("toxic", 0.1)):
        reached = sum(r["rate"] * r["tokens"] * r[f"p_{domain}"] for r in rows)
        assert abs(reached - share * 0.8 * total) < 0.001 * total
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in rows)
    assert all(abs(r["p_clean"] + r["p_low_quality"] + r["p_toxic"] - 1) < 1e-9 for r in rows)
    best = {r["doc_id"]: max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"]) for r in rows}
    assert np.mean([(best[k] == "toxic") == bool(t) for k, _, t in truth]) > 0.95
    odd = mixing.mixed(odd_documents, labels).collect()
    assert len(odd) == 8 and sum(r["tokens"] == 0 for r in odd) == 3
    assert mixing.mixed(odd_documents.limit(0), spark.createDataFrame([], LABEL)).count() == 0
    plain = mixing.mixed(docs, labels).first()
    shares = {d: plain[f"reached_{d}"] for d in mixing.DOMAINS}
    assert plain["off_target"] == ",".join(d for d in mixing.DOMAINS if abs(shares[d] - mixing.WEIGHTS[d]) > 0.001)
    clashing = docs.withColumn("tokens", F.lit("own")).withColumn("draw", F.lit(1)).withColumn("rate", F.lit(9.0))
    assert {r["tokens"] for r in mixing.sampled(clashing, labels).collect()} == {"own"}
    drawn = mixing.sampled(docs, labels).collect()
    assert all(r["copies"] > 0 for r in drawn) and set(docs.columns) < set(drawn[0].asDict())


def test_projected_steps_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    p, tokens = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 90, 200)
    rows = [(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)]
    members = spark.createDataFrame(rows, "tokens bigint, p_clean double, p_low_quality double, p_toxic double").repartition(4)
    steps, totals, _ = mixing.solve(members, {"clean": 0.1, "low_quality": 0.8, "toxic": 0.1}, 1.0, rounds=25, tolerance=0)
    r, target = np.ones(200), np.array([0.1, 0.8, 0.1]) * tokens.sum()
    for _ in range(25):
        r = np.maximum(0, r - p @ (((tokens * r) @ p - target) / (tokens @ p)))
    assert np.allclose(mixing.rates_after(p, steps), r) and np.allclose(list(totals.values()), (tokens * r) @ p)


def test_tagger_gradients():
    model = tagger.Tagger(5, embed=4, hidden=3)
    rng = np.random.default_rng(0)
    codes, y = rng.integers(0, tagger.N_CHARS, (3, 7)), rng.integers(0, 5, (3, 7))
    _, g = model.gradients(codes, y)
    for name, part in g.items():
        at = tuple(rng.integers(0, n) for n in part.shape) if name != "E" else (codes[0, 2], 1)
        model.p[name][at] += 1e-5
        up, _ = model.gradients(codes, y)
        model.p[name][at] -= 2e-5
        down, _ = model.gradients(codes, y)
        model.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - part[at]) < 1e-6, name


def plain_likelihood(net, ids):
    """Each position on its own, with the full two-level softmax."""
    padded, total = [0, 0, *ids, 0, 0], 0.0
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for k in range(len(ids)):
        near = [padded[k + 2 + o] for o in (-2, -1, 1, 2)]
        h = np.tanh(p["b"] + sum(p["E"][w] @ p["W"][j] for j, w in enumerate(near)))
        g, m = divmod(ids[k], pseudo_likelihood.MEMBERS)
        for logits, gold in ((h @ p["C"] + p["c"], g), (h @ p["M"][g] + p["m"][g], m)):
            total += logits[gold] - np.log(np.exp(logits).sum())
    return total


def test_pseudo_likelihood(spark, documents, odd_documents):
    rng = random.Random(6)
    texts = []
    for _ in range(300):  # every word is told by its neighbours: two interleaved alphabets
        k = rng.randrange(20)
        texts.append(" ".join(PLAIN[(k + j) % 40] for j in range(rng.randint(30, 60))))
    docs = documents([*texts, None, "", "bal"])
    vocab = pseudo_likelihood.vocabulary(docs)
    assert set(vocab) == {w.encode() for w in PLAIN[:40]} | {b"bal"}
    ids = pseudo_likelihood.encoded(docs, vocab)
    net, means = pseudo_likelihood.train(ids, rounds=6, step=1)
    assert means[-1] > means[0] + 1 and means[-1] > -np.log(40) + 1
    number = {w: k + 2 for k, w in enumerate(vocab)}
    coded = [[number[w.encode()] for w in t.split()] for t in texts[:5]]
    data = [np.array(c, dtype="<u2").tobytes() for c in coded]
    flat, at, of = pseudo_likelihood.joined([data[0], None, *data[1:]])
    got = np.bincount(of, weights=net.log_likelihood(flat, at), minlength=6)
    assert np.allclose(got[[0, 2, 3, 4, 5]], [plain_likelihood(net, c) for c in coded], atol=1e-2) and got[1] == 0
    shuffled = [rng.sample(c, len(c)) for c in coded]
    assert all(plain_likelihood(net, c) > plain_likelihood(net, s) for c, s in zip(coded, shuffled, strict=True))
    rows = {r["doc_id"]: r for r in pseudo_likelihood.pseudo_likelihood(docs, rounds=1).collect()}
    assert len(rows) == 303 and rows[300]["n_tokens"] == 0 and rows[301]["mean_log_likelihood"] is None
    assert rows[0]["n_tokens"] == len(texts[0].split()) and rows[0]["log_likelihood"] < 0
    assert pseudo_likelihood.pseudo_likelihood(odd_documents, rounds=1).count() == 8
    assert pseudo_likelihood.pseudo_likelihood(odd_documents.limit(0), rounds=1).count() == 0


def test_network_gradient_lowers_the_loss():
    net = pseudo_likelihood.Network()
    ids = np.array([0, 0, *([5, 70, 9, 200] * 500), 0, 0])
    at = np.arange(2, len(ids) - 2)
    memory = {k: np.full(v.shape, 1e-4, dtype=np.float32) for k, v in net.p.items()}
    before = net.log_likelihood(ids, at).mean()
    for _ in range(20):
        net.train(ids, at, memory)
    assert net.log_likelihood(ids, at).mean() > before / 4
