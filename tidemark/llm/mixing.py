"""Mixing documents to target weights by soft domain membership.

A classifier fitted on the labelled rows gives every document a posterior over domains.  A
document sampled at rate r adds r * tokens * posterior to the expected token totals of the
domains.  Projected gradient steps on the squared distance of those totals from the targets,
each followed by the projection onto rates >= 0, find the rates, starting from rate one.

A step changes a rate by a combination of the document's posteriors with one coefficient a
domain.  So the rates after any number of steps follow from the short list of coefficients:
each round is one aggregation over the staged posteriors, and nothing a document is written again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LETTERS, labelled, sigmoid, staged, utf8
from tidemark.llm.quality import N_TEXT, View, text_view
from tidemark.llm.toxicity import ToxicityModel, fit as fit_toxicity

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOMAINS = ("clean", "low_quality", "toxic")
_POSTERIOR = "tokens bigint, " + ", ".join(f"p_{d} double" for d in DOMAINS)


def n_tokens(text: str | None) -> int:
    return len(utf8(text).split())


class DomainModel:
    """Posterior over DOMAINS: toxic words against all else, then low quality against clean."""

    def __init__(self, toxic: ToxicityModel, low: View):
        self.toxic, self.low = toxic, low

    def posterior(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        if len(texts):
            out[:, 2] = [self.toxic.score(t) for t in texts]
            low = sigmoid(self.low.logit(np.array([text_view(t) for t in texts])))
            out[:, 1] = low * (1 - out[:, 2])
            out[:, 0] = 1 - out[:, 1] - out[:, 2]
        return out

    def column(self, text: str = "text") -> Column:
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                p = self.posterior(list(texts))
                frame = {"tokens": np.array([n_tokens(t) for t in texts], dtype=np.int64)}
                yield pd.DataFrame(frame | {f"p_{d}": p[:, k] for k, d in enumerate(DOMAINS)})

        return F.pandas_udf(scored, _POSTERIOR)(text)


def fit_domains(documents: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> DomainModel:
    """Fit on at most ``max_rows`` labelled rows: label toxic, else quality 0, else clean."""
    toxic = fit_toxicity(documents, labels, max_rows=max_rows)
    sample = labelled(documents.select("doc_id", "text"), labels.where("toxic = 0"), 1 - F.col("quality"), F.lit(True), max_rows)

    def viewed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"target": frame["target"], "x": [text_view(t) for t in frame["text"]]})

    got = sample.select("text", "target").mapInPandas(viewed, "target int, x array<double>").toPandas()
    y = got["target"].to_numpy(dtype=np.float64)
    if len(set(y)) < 2:
        bias = np.zeros(N_TEXT + 1)
        bias[-1] = -10.0 if not len(y) or y[0] == 0 else 10.0
        return DomainModel(toxic, View(np.zeros(N_TEXT), np.ones(N_TEXT), bias))
    x = np.stack(got["x"].to_numpy())
    view = View.fitted(x, y)
    # The fit weighs both classes alike; the posterior needs their odds back.
    view.weights[-1] += np.log(y.mean() / (1 - y.mean()))
    return DomainModel(toxic, view)


def rates_after(posterior: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The rates of documents with ``posterior`` after the projected steps, starting from one."""
    r = np.ones(len(posterior))
    for step in steps:
        r = np.maximum(0.0, r - posterior @ step)
    return r


def solve(members: DataFrame, weights: dict[str, float], budget: float = 1.0, rounds: int = 40, tolerance: float = 1e-4, traces: tuple[str, ...] = ()):
    """The steps (one coefficient a domain each) and the totals they reach.

    ``members``: tokens and p_<domain> of all documents.  The target of a domain is its weight
    times ``budget`` times all tokens.  Each residual is divided by the domain's own tokens, so
    small domains converge like large ones; a domain without tokens cannot be reached and is
    left out.  The target of a domain in ``traces`` is no more than what it holds at rate
    one; the other domains get the rest by their weights.
    """
    names = [f"p_{d}" for d in DOMAINS]
    share = np.array([weights[d] for d in DOMAINS], dtype=np.float64)
    share = share / share.sum()
    steps = np.zeros((0, len(DOMAINS)))
    available = target = totals = None
    for number in range(rounds + 1):

        def summed(frames: Iterator[pd.DataFrame], steps=steps) -> Iterator[pd.DataFrame]:
            for frame in frames:
                p = frame[names].to_numpy()
                held = (frame["tokens"].to_numpy() * rates_after(p, steps)) @ p
                yield pd.DataFrame([[*held, float(frame["tokens"].sum())]], columns=[*names, "tokens"])

        schema = ", ".join(f"{c} double" for c in [*names, "tokens"])
        row = members.select("tokens", *names).mapInPandas(summed, schema)
        row = row.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in [*names, "tokens"]]).first()
        totals = np.array([row[c] for c in names])
        if available is None:
            available, target = totals, share * budget * row["tokens"]
            trace = np.array([d in traces for d in DOMAINS])
            spare = np.where(trace, np.maximum(target - available, 0.0), 0.0)
            target = target - spare + np.where(trace, 0.0, share) / max(share[~trace].sum(), 1e-12) * spare.sum()
        reach = available > 1e-9
        error = np.where(reach, (totals - target) / np.where(reach, available, 1.0), 0.0)
        if number == rounds or np.abs(totals - target)[reach].max(initial=0.0) <= tolerance * max(row["tokens"], 1.0):
            break
        steps = np.vstack([steps, error])
    return steps, dict(zip(DOMAINS, totals.tolist(), strict=True)), dict(zip(DOMAINS, target.tolist(), strict=True))


# Low-quality and toxic text may stay as a trace; clean text fills the rest.
WEIGHTS = {"clean": 0.96, "low_quality": 0.03, "toxic": 0.01}
TRACES = ("low_quality", "toxic")


def mixed(
    documents: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float = 1.0, traces: tuple[str, ...] = TRACES, **fitting
) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate (expected copies) and copies (drawn by a hash) of every document.

    ``copies`` is the rate rounded up with the probability of its fraction, by a hash of doc_id
    and text, so a rerun draws alike.  reached_<domain> is the share of ``budget`` times all
    tokens that the rates reach, and off_target names the domains more than 0.001 away from
    their weight: no rates may reach them, or ``traces`` holds them down.

    Null and empty texts have no tokens, hence no influence; their rate follows from their
    posterior.  Very long texts count whole.  Repeated rows get equal rates and copies.  An empty
    table gives an empty result.  Other columns are not read.
    """
    model = fit_domains(documents, labels, **fitting)
    members = staged(
        documents.select("doc_id", F.xxhash64("doc_id", "text").alias("draw"), model.column().alias("m")).select("doc_id", "draw", "m.*")
    )
    steps, totals, _ = solve(members, weights, budget, traces=traces)
    tokens = budget * sum(totals_at_rate_one(members).values())
    reached = {d: totals[d] / tokens if tokens else 0.0 for d in DOMAINS}
    off = [d for d in DOMAINS if tokens and abs(reached[d] - weights[d] / sum(weights.values())) > 0.001]
    out = members.withColumn("rate", _rate(steps)).withColumn("copies", _copies()).drop("draw")
    out = out.withColumns({f"reached_{d}": F.lit(float(reached[d])) for d in DOMAINS})
    return out.withColumn("off_target", F.lit(",".join(off)))


def totals_at_rate_one(members: DataFrame) -> dict[str, float]:
    row = members.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in DOMAINS]).first()
    return row.asDict()


def _rate(steps: np.ndarray) -> Column:
    def rate(*columns: pd.Series) -> pd.Series:
        p = np.column_stack([c.to_numpy() for c in columns]) if len(columns[0]) else np.zeros((0, len(DOMAINS)))
        return pd.Series(np.round(rates_after(p, steps), 9))

    return F.pandas_udf(rate, "double")(*[f"p_{d}" for d in DOMAINS])


def _copies() -> Column:
    chance = F.pmod(F.col("draw"), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("bigint")


def sampled(
    documents: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    budget: float = 1.0,
    traces: tuple[str, ...] = TRACES,
    keep_clean: bool = True,
    **fitting,
) -> DataFrame:
    """The documents drawn at least once, whole rows with ``rate`` and ``copies``.

    With ``keep_clean`` every document that is most likely clean stays: it has one copy at
    least, also where its posterior is mixed and its rate below one.  Null and empty texts are
    rows like any other; very long texts count whole; repeated rows are drawn alike; an empty
    table gives an empty result.  Given columns stay, save two named ``rate`` and ``copies``,
    which are replaced.
    """
    model = fit_domains(documents, labels, **fitting)
    whole = documents.select(*[c for c in documents.columns if c not in ("rate", "copies")])
    members = staged(
        whole.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("draw"), model.column().alias("m")).select("row", "draw", "m.*")
    )
    steps, _, _ = solve(members, weights, budget, traces=traces)
    out = members.withColumn("rate", _rate(steps)).withColumn("copies", _copies())
    if keep_clean:
        clean = F.col("p_clean") >= F.greatest("p_low_quality", "p_toxic")
        out = out.withColumn("copies", F.when(clean, F.greatest("copies", F.lit(1))).otherwise(F.col("copies")))
    return out.where("copies > 0").select("row.*", "rate", "copies")
