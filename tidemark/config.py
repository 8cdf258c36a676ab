"""Configuration objects and the fixed vocabularies the operators share.

Every label that names a feed or a version is a parameter.  Two deployments
that configure the same labels derive the same identifiers.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

# --- fixed values -----------------------------------------------------------
PROBABILITY_SCALE = 1_000_000
CONSENSUS_FORMULA = "reported-pct-proportional-median-v1"
SELECTION_VERSION = "covered-market-selection-v1"
STATES = ("OPEN", "WIDENED", "PAUSED", "RECOVERY")
ACTIONS = ("none", "widen", "pause", "begin_recovery", "reopen")
EVENT_KINDS = ("fixture.observed", "odds.observed", "score.observed")
PAYLOAD_KINDS = ("fixture", "odds", "score")
LEGAL_TRANSITIONS = (
    ("begin_recovery", "PAUSED", "RECOVERY"),
    ("begin_recovery", "WIDENED", "RECOVERY"),
    ("none", "OPEN", "OPEN"),
    ("none", "WIDENED", "WIDENED"),
    ("none", "PAUSED", "PAUSED"),
    ("none", "RECOVERY", "RECOVERY"),
    ("pause", "OPEN", "PAUSED"),
    ("pause", "WIDENED", "PAUSED"),
    ("pause", "RECOVERY", "PAUSED"),
    ("reopen", "RECOVERY", "OPEN"),
    ("widen", "OPEN", "WIDENED"),
)
BUCKET_MS = 300_000  # the five-minute grid used for backfill and for chunked scans
# ----------------------------------------------------------------------------


def canonical_text(value) -> str:
    """Canonical JSON of a small configuration value (sorted keys, no spaces)."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value) -> str:
    return hashlib.sha256(canonical_text(value).encode()).hexdigest()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class FeedLabels:
    """Names of the feed sources and encodings; `prefix` qualifies the three feed sources."""

    prefix: str = ""
    price_encoding: str = "native-i32-v1"
    probability_encoding: str = "pct-percent-3dp-v1"

    @property
    def historical(self) -> str:
        return f"{self.prefix}historical"

    @property
    def snapshot(self) -> str:
        return f"{self.prefix}snapshot"

    @property
    def live(self) -> str:
        return f"{self.prefix}live"

    @property
    def simulation(self) -> str:
        return "simulation"

    @property
    def priorities(self) -> dict[str, int]:
        return {self.simulation: 0, self.historical: 10, self.snapshot: 20, self.live: 30}


@dataclass(frozen=True)
class ConsensusConfig:
    min_fresh_bookmakers: int = 1
    stale_after_ms: int = 5_000
    formula_version: str = CONSENSUS_FORMULA
    chunk_ms: int = BUCKET_MS

    def __post_init__(self) -> None:
        _require(self.formula_version == CONSENSUS_FORMULA, "unsupported consensus formula")
        _require(self.min_fresh_bookmakers >= 1, "min_fresh_bookmakers must be positive")
        _require(self.stale_after_ms >= 0, "stale_after_ms must not be negative")
        _require(self.chunk_ms >= 1, "chunk_ms must be positive")


@dataclass(frozen=True)
class MarketSelection:
    min_valid_bookmakers: int = 1
    preferred_types: tuple[str, ...] = ()
    require_in_running: bool = False

    def __post_init__(self) -> None:
        _require(self.min_valid_bookmakers >= 1, "min_valid_bookmakers must be positive")
        _require(
            len(set(self.preferred_types)) == len(self.preferred_types),
            "preferred_types must not repeat",
        )


@dataclass(frozen=True)
class RiskPolicy:
    """Thresholds of the market risk policy; defaults suit feeds seconds apart."""

    critical_shock_hold_ms: int = 8_000
    minimum_fresh_bookmakers: int = 1
    minimum_pause_ms: int = 2_000
    minimum_widened_ms: int = 2_000
    pause_dispersion_micros: int = 50_000
    pause_quote_age_ms: int = 5_000
    pause_reaction_latency_ms: int = 4_000
    pause_stale_bookmaker_fraction_ppm: int = 500_000
    pause_velocity_micros_per_second: int = 60_000
    recovery_cooldown_ms: int = 3_000
    recovery_dispersion_micros: int = 15_000
    recovery_quote_age_ms: int = 1_500
    recovery_stable_updates: int = 3
    recovery_stale_bookmaker_fraction_ppm: int = 0
    recovery_velocity_micros_per_second: int = 10_000
    reversal_shock_hold_ms: int = 2_000
    widen_dispersion_micros: int = 20_000
    widen_quote_age_ms: int = 2_000
    widen_reaction_latency_ms: int = 1_500
    widen_stale_bookmaker_fraction_ppm: int = 250_000
    widen_velocity_micros_per_second: int = 20_000

    def __post_init__(self) -> None:
        values = asdict(self)
        _require(all(v >= 0 for v in values.values()), "policy values must not be negative")
        _require(self.minimum_fresh_bookmakers >= 1, "quorum must be at least one")
        _require(self.recovery_stable_updates >= 1, "stable updates must be at least one")
        _require(self.pause_stale_bookmaker_fraction_ppm <= PROBABILITY_SCALE, "ppm above one million")
        limits = (
            "quote_age_ms",
            "dispersion_micros",
            "reaction_latency_ms",
            "stale_bookmaker_fraction_ppm",
            "velocity_micros_per_second",
        )
        for limit in limits:
            _require(values[f"widen_{limit}"] < values[f"pause_{limit}"], f"widen {limit} must be below pause")
            recovery = values.get(f"recovery_{limit}")
            _require(recovery is None or recovery <= values[f"widen_{limit}"], f"recovery {limit} above widen")

    def as_json(self) -> dict[str, int]:
        return {camel(k): v for k, v in asdict(self).items()}

    @property
    def configuration_hash(self) -> str:
        return canonical_hash(self.as_json())

    def but(self, **changes) -> "RiskPolicy":
        return replace(self, **changes)


RISK_POLICY_VERSION = "soccer-risk-v1"


@dataclass(frozen=True)
class AdmissionConfig:
    max_quote_age_ms: int = 2_000
    policy_version: str = "market-admission-v1"

    def __post_init__(self) -> None:
        _require(self.max_quote_age_ms > 0, "max_quote_age_ms must be positive")


@dataclass(frozen=True)
class EvaluationConfig:
    convergence_tolerance_micros: int = 5_000
    convergence_window_ms: int = 10_000
    material_move_threshold_micros: int = 50_000
    overlong_pause_grace_ms: int = 5_000
    coverage: str = "spanning"  # or "exact"
    evaluation_version: str = "strategy-evaluation-v1"

    def __post_init__(self) -> None:
        _require(self.material_move_threshold_micros > 0, "material move threshold must be positive")
        _require(self.coverage in ("spanning", "exact"), "unknown coverage rule")

    def as_json(self) -> dict[str, int]:
        return {
            "convergenceToleranceMicros": self.convergence_tolerance_micros,
            "convergenceWindowMs": self.convergence_window_ms,
            "materialMoveThresholdMicros": self.material_move_threshold_micros,
            "overlongPauseGraceMs": self.overlong_pause_grace_ms,
        }


@dataclass(frozen=True)
class ReplayConfig:
    data_mode: str = "historical"
    normalizer_version: str = "normalizer-v3-score-semantics"
    ordering_version: str = "event-order-v1"
    strategy_version: str = RISK_POLICY_VERSION
    strategy: dict = field(default_factory=dict)
    score_path_prefix: str = "scores/"

    @property
    def strategy_hash(self) -> str:
        return canonical_hash(self.strategy)
