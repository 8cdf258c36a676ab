"""Toxicity by non-negative positive-unlabelled learning.

The confirmed toxic examples are the only labels that are used.  A sample of all other documents, with
or without a label, is the unlabelled text, and holds toxic ones too; a linear model in numpy minimizes
``prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)])``, whose second term is the negative
risk of the unlabelled text corrected by the class prior and kept from going below zero.  The
prior, the toxic share of the unlabelled text, is a parameter or estimated from the scores of a first fit.
Features are words and word beginnings that toxic examples hold significantly more often, by a factor.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LETTERS, labelled, sigmoid, staged, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BEGINNINGS = (4, 5, 6, 7, 8, 9)  # bytes
_HEAD = min(_BEGINNINGS)


def features(text: str | None) -> set[bytes]:
    """The words of ``text``, closed by a blank, and the beginnings of its longer words."""
    words = set(utf8(text).translate(LETTERS).split())
    out = {w + b" " for w in words}
    for n in _BEGINNINGS:
        out.update(w[:n] for w in words if len(w) > n)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    intercept: float

    def __post_init__(self) -> None:
        # only words that start like a feature can hold one
        heads = {f[:-1][:_HEAD] if f.endswith(b" ") else f[:_HEAD] for f in self.weights}
        object.__setattr__(self, "heads", frozenset(heads))

    def score(self, text: str | None) -> float:
        weights, heads = self.weights, self.heads
        near = [w for w in set(utf8(text).translate(LETTERS).split()) if w[:_HEAD] in heads]
        total = self.intercept
        for w in near:
            total += weights.get(w + b" ", 0.0)
        for n in _BEGINNINGS:
            for b in {w[:n] for w in near if len(w) > n}:
                total += weights.get(b, 0.0)
        return float(1.0 / (1.0 + np.exp(-min(max(total, -30.0), 30.0))))

    def column(self, text: str = "text") -> Column:
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([self.score(t) for t in texts], dtype="float64")

        return F.pandas_udf(scored, "double")(text)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many rows, and how many positives, hold a feature: one row for a feature and batch."""
    for frame in frames:
        every: Counter[bytes] = Counter()
        positive: Counter[bytes] = Counter()
        for text, target in zip(frame["text"], frame["target"], strict=True):
            own = features(text)
            every.update(own)
            if target:
                positive.update(own)
        yield pd.DataFrame(
            {"feature": list(every), "n": list(every.values()), "n_pos": [positive.get(f, 0) for f in every]}
        )


def significant(sample: DataFrame, most: int, z: float, lift: float = 3.0, support: float = 0.002) -> list[bytes]:
    """The features that positives hold ``lift`` times as often as unlabelled texts, by ``z`` errors or more.

    The lift keeps out what tells the two samples apart for other reasons, as a language or a source
    that is more often labelled: such a share differs significantly, but not by a factor.  A feature
    that fewer than ``support`` of the positives hold is left out.
    """
    total, positive = sample.agg(F.count("*"), F.sum("target")).first()
    if not total or not positive or positive == total:
        return []
    unlabelled = total - positive
    counts = sample.mapInPandas(_counted, "feature binary, n bigint, n_pos bigint").groupBy("feature")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")).where("n >= 3")
    share = F.col("n") / total
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1.0 / total)) * (1.0 / positive + 1.0 / unlabelled))
    gap = F.col("n_pos") / positive - (F.col("n") - F.col("n_pos")) / unlabelled
    specific = F.col("n_pos") * unlabelled >= lift * positive * (F.col("n") - F.col("n_pos"))
    specific = specific & (F.col("n_pos") >= support * positive)
    rated = counts.withColumn("z", gap / error).where((F.col("z") >= z) & specific)
    return [bytes(r["feature"]) for r in rated.orderBy(F.desc("z"), "feature").limit(most).collect()]


def fit_nonnegative_pu(
    rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int, positive: np.ndarray, prior: float,
    rounds: int = 3_000, rate: float = 0.1, l2: float = 1e-5, unlabelled: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and intercept; (rows, cols) are the ones of a sparse 0/1 matrix.

    ``positive`` marks the confirmed rows, ``unlabelled`` those drawn from unlabelled text (all, if not given).
    """
    w, b = np.zeros(n_cols), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    unlabelled = np.ones(n_rows) if unlabelled is None else unlabelled
    drawn, confirmed = unlabelled / max(unlabelled.sum(), 1), positive / max(positive.sum(), 1)
    for k in range(1, rounds + 1):
        f = b + np.bincount(rows, weights=w[cols], minlength=n_rows)
        p = sigmoid(f)
        loss_negative = -np.log(np.clip(1 - p, 1e-12, None))
        negative_risk = (drawn - prior * confirmed) @ loss_negative
        # d l(f)/df = p - 1 and d l(-f)/df = p; a negative risk below zero is stepped back from.
        if negative_risk >= 0:
            g = prior * confirmed * (p - 1) + (drawn - prior * confirmed) * p
        else:
            g = -(drawn - prior * confirmed) * p
        grad = np.append(np.bincount(cols, weights=g[rows], minlength=n_cols) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (1 - (k - 1) / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def calibrated(f: np.ndarray, positive: np.ndarray, prior: float, scale: float = 2.0, most: float = 1.0) -> tuple[float, float]:
    """Scale and shift that turn margins into posteriors of the unlabelled text.

    The non-negative correction leaves clean text a score where the prior is a little too high.  Margins
    are sharpened by ``scale``, then raised, by ``most`` at the most, to where the corrected risk
    ``-prior * E+[g] + Eu[log(1 + exp(g))]`` is least: where the mean posterior of unlabelled rows is the prior.
    """
    low, high, other = 0.0, most, scale * f[positive == 0]
    for _ in range(40):
        shift = (low + high) / 2
        low, high = (low, shift) if sigmoid(other + shift).mean() > prior else (shift, high)
    return scale, (low + high) / 2


def estimated_prior(rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int, positive: np.ndarray, seed: int = 5) -> float:
    """The positive share of the unlabelled rows, by the best bin of a first classifier.

    Fitted on one half, it ranks the other: above any score lies at least the prior's part of what the
    confirmed rows have there, so the least ratio of unlabelled to confirmed rows above a score, among
    scores that half of the confirmed rows reach, bounds the prior from above and is near it.
    """
    half = np.random.default_rng(seed).random(n_rows) < 0.5
    bounds = []
    for learn in (half, ~half):
        seen = learn[rows]
        p, u = positive * learn, (1 - positive) * learn
        if not p.sum() or not u.sum():
            continue
        w, b = fit_nonnegative_pu(rows[seen], cols[seen], n_rows, n_cols, p, 0.5, rounds=300, l2=1e-4, unlabelled=u)
        f = b + np.bincount(rows, weights=w[cols], minlength=n_rows)
        confirmed, other = f[(positive > 0) & ~learn], f[(positive == 0) & ~learn]
        if not len(confirmed) or not len(other):
            continue
        cuts = np.unique(confirmed[confirmed <= np.median(confirmed)])
        above = [((other >= t).mean(), (confirmed >= t).mean()) for t in cuts]
        bounds.append(min(u / p for u, p in above))
    least = 1.0 / (n_rows + 1)
    if not bounds:
        return least
    # a standard error less: a prior above the truth would push up the scores of clean text
    top = float(np.mean(bounds))
    return float(np.clip(top - np.sqrt(top * (1 - top) / max((positive == 0).sum(), 1)), max(least, top / 2), 0.9))


def _sketch(texts: pd.Series) -> pd.Series:
    """The least hash of three words in a row: most often equal for near copies, never by chance."""
    found = []
    for text in texts:
        w = utf8(text).translate(LETTERS).split()
        found.append(min(crc32(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))))
    return pd.Series(found, dtype="int64")


def _sample(documents: DataFrame, labels: DataFrame, keep: Column, most: int) -> DataFrame:
    """text and target: at most ``most`` confirmed rows (1), and about as many different texts of all other documents (0), both by hash."""
    toxic = labels.where("toxic = 1")
    confirmed = labelled(documents, toxic, F.col("toxic"), keep, most).select("text", "target")
    fold = documents.where(F.coalesce(keep, F.lit(False)))
    # a bound on the hash lets about ``most`` rows through, whatever the size of the table
    share = min(1.0, most / max(fold.count(), 1))
    drawn = F.xxhash64("text")
    near = fold.where(F.pmod(drawn, F.lit(1_000_000)) < int(np.ceil(share * 1_000_000)))
    others = near.join(toxic.select("doc_id").distinct(), "doc_id", "left_anti").select("text").distinct()
    both = confirmed.unionAll(others.select("text", F.lit(0).alias("target")))
    # of near copies, which agree in everything, one is enough evidence
    return both.withColumn("sketch", F.pandas_udf(_sketch, "bigint")("text")).dropDuplicates(["target", "sketch"]).drop("sketch")


def fit(
    documents: DataFrame, labels: DataFrame, keep: Column | None = None,
    max_rows: int = 20_000, max_features: int = 4_000, z: float = 5.0, prior: float | None = None,
) -> ToxicityModel:
    """Train on the confirmed toxic rows and a sample of all other documents that satisfy ``keep``.

    Labels other than toxic = 1 are not looked at.  ``max_rows`` bounds both samples together, taken by a
    hash (the second one in expectation); ``max_features`` bounds the model.  These are bounds on what the classifier is fitted on; scoring
    covers every text.  ``prior`` is the toxic share of the other documents; None estimates it.
    Without toxic examples, or with nothing else, the model returns a small score for every text.
    """
    keep = F.lit(True) if keep is None else keep
    sample = staged(_sample(documents.select("doc_id", "text"), labels, keep, max_rows // 2))
    chosen = significant(sample, max_features, z)
    number = {f: k for k, f in enumerate(chosen)}

    def present(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = [sorted(number[f] for f in features(t) if f in number) for t in frame["text"]]
            yield pd.DataFrame({"target": frame["target"], "held": held})

    got = sample.mapInPandas(present, "target int, held array<int>").toPandas()
    n = len(got)
    if not chosen:
        return ToxicityModel({}, float(-np.log(max(n, 20))))
    positive = got["target"].to_numpy(dtype=np.float64)
    rows = np.repeat(np.arange(n), [len(h) for h in got["held"]])
    cols = np.concatenate([np.asarray(h, dtype=np.int64) for h in got["held"]])
    prior = estimated_prior(rows, cols, n, len(chosen), positive) if prior is None else prior
    w, b = fit_nonnegative_pu(rows, cols, n, len(chosen), positive, prior, unlabelled=1 - positive)
    scale, shift = calibrated(b + np.bincount(rows, weights=w[cols], minlength=n), positive, prior)
    return ToxicityModel(dict(zip(chosen, (scale * w).tolist(), strict=True)), float(scale * b + shift))


def toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``documents`` with score (0 to 1) and predicted (score >= threshold) of the whole text.

    Null and empty texts get the score of a text without features; repeated rows get equal scores.
    """
    scored = documents.withColumn("score", model.column())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
