"""Composed jobs: events to observations, decisions and reports, for all fixtures at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import RISK_POLICY_VERSION, ConsensusConfig, EvaluationConfig, RiskPolicy
from tidemark.functions.staging import stage
from tidemark.operators.consensus import consensus_trace
from tidemark.operators.evaluation import evaluate, probe_orders, signals
from tidemark.operators.risk import decide, namespace_market, risk_inputs


def strategy_trace(
    events: DataFrame,
    config: ConsensusConfig,
    policies: dict[str, RiskPolicy],
    policy_version: str = RISK_POLICY_VERSION,
    namespaces: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Observations and decisions of every policy.

    ``namespaces`` (fixture_id, namespace) isolates the market ids of an evaluation.
    """
    trace = stage(consensus_trace(events, config))
    inputs = risk_inputs(events, trace, config)
    if namespaces is not None:
        isolated = inputs.join(namespaces, "fixture_id")
        inputs = isolated.withColumn("market_id", F.expr(namespace_market("namespace", "market_id"))).drop("namespace")
    return trace, stage(decide(inputs, policies, policy_version))


def sweep(
    events: DataFrame,
    manifest_rows: DataFrame,
    config: ConsensusConfig,
    policies: dict[str, RiskPolicy],
    base_policy: str,
    evaluation: EvaluationConfig = EvaluationConfig(),
    changes: dict[str, dict[str, int]] | None = None,
    data_mode: str = "historical",
    policy_version: str = RISK_POLICY_VERSION,
    probe: dict | None = None,
) -> DataFrame:
    """Reports of all policies over all fixtures in one pass over the trace."""
    namespaces = manifest_rows.select("fixture_id", F.concat(F.lit("evaluation:"), "manifest_id").alias("namespace"))
    trace, decisions = strategy_trace(events, config, policies, policy_version, namespaces)
    rejected = probe_orders(events, decisions, signals(events), **(probe or {}))
    # every policy is measured on the base policy's sample orders
    shared = rejected.filter(F.col("policy_id") == base_policy).drop("policy_id")
    each = shared.withColumn("policy_id", F.explode(F.array(*[F.lit(p) for p in policies])))
    return evaluate(
        events, trace, decisions, manifest_rows, policies, evaluation, each, base_policy, changes, data_mode
    )
