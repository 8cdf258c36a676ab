"""Stateful risk fold of a stream: the batch automaton kept per (market, policy).

The stream carries judged features (see `risk.fold_inputs`); state holds the automaton, the
shock hold and the last applied time.  Nothing fires on a timer: a hold expires when the
next input of the market arrives.  A key's state lives on one partition by nature, but it is
a few numbers and each row costs constant time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.automaton import FOLD_LIMITS, STATE_NAMES, Automaton
from tidemark.schemas import ORDER_FIELDS

# processors travel inside the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INPUT_COLUMNS = (
    "market_id", "policy_id", "event_id", "t", "ord", "pause_signal", "reversal", "market_pause",
    "widen", "healthy", "critical_shock_hold_ms", "reversal_shock_hold_ms", *FOLD_LIMITS,
)
OUTPUT_DDL = (
    "market_id STRING, policy_id STRING, event_id STRING, t BIGINT, status STRING, state_version BIGINT, shock_until_ms BIGINT, "
    "previous_state STRING, next_state STRING, action STRING, stable_updates BIGINT, state_change_ms BIGINT, "
    "previous_stable_updates BIGINT, previous_change_ms BIGINT"
)
STATE_DDL = "state STRING, change_ms BIGINT, stable BIGINT, shock_until_ms BIGINT, version BIGINT, last_t BIGINT"
INITIAL_DDL = "market_id STRING, policy_id STRING, " + STATE_DDL
_ORDER = [f"ord_{f}" for f in ORDER_FIELDS]
_OUTPUT = [c.split()[0] for c in OUTPUT_DDL.split(", ")]


class RiskFold(StatefulProcessor):
    """Applies the inputs of one (market, policy) in event order; late ones are reported only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("control", STATE_DDL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        market, policy = key
        # rows of a micro-batch come in any order; only those of one key and batch are sorted
        batch = pd.concat(list(rows)).sort_values(_ORDER)
        stored = self.state.get() if self.state.exists() else None
        auto, shock, version, last_t = None, 0, 0, 0
        if stored is not None:
            state, change, stable, shock, version, last_t = stored
            auto = Automaton(state, change, stable)
        out = []
        for row in batch.itertuples(index=False):
            if row.t < last_t:
                out.append([market, policy, row.event_id, row.t, "late", version, shock] + [None] * len(STATE_NAMES))
                continue
            auto = auto or Automaton("OPEN", row.t, 0)
            if row.reversal:
                shock = row.t + row.reversal_shock_hold_ms
            elif row.pause_signal:
                shock = max(shock, row.t + row.critical_shock_hold_ms)
            was = (auto.state, auto.stable, auto.change_ms)
            pause = bool(row.pause_signal or row.market_pause or shock > row.t)
            limits = [getattr(row, n) for n in FOLD_LIMITS]
            action = auto.step(row.t, pause, bool(row.widen), bool(row.healthy), limits)
            out.append(
                [market, policy, row.event_id, row.t, "applied", version, shock]
                + [was[0], auto.state, action, auto.stable, auto.change_ms, was[1], was[2]]
            )
            version, last_t = version + 1, row.t
        if auto is not None:
            self.state.update((auto.state, int(auto.change_ms), int(auto.stable), int(shock), int(version), int(last_t)))
        yield pd.DataFrame(out, columns=_OUTPUT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update(
            (r["state"], int(r["change_ms"]), int(r["stable"]), int(r["shock_until_ms"]), int(r["version"]), int(r["last_t"]))
        )

    def close(self) -> None:
        pass


def initial_states(restored: DataFrame, policy_id: str) -> DataFrame:
    """Restart table (`risk.state_from_decisions`) in the shape the processor loads."""
    return restored.selectExpr(
        "market_id", f"'{policy_id}' AS policy_id", "state", "last_state_change_ms AS change_ms", "stable_updates AS stable",
        "shock_until_ms", "state_version AS version", "last_logical_ms AS last_t",
    )


def fold_stream(inputs: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Decisions core of a stream of `INPUT_COLUMNS`; needs the RocksDB state store."""
    flat = inputs.select(*INPUT_COLUMNS).select("*", *[F.col(f"ord.{f}").alias(c) for f, c in zip(ORDER_FIELDS, _ORDER)]).drop("ord")
    keyed = flat.groupBy("market_id", "policy_id")
    seed = None if initial is None else initial.groupBy("market_id", "policy_id")
    return keyed.transformWithStateInPandas(
        statefulProcessor=RiskFold(), outputStructType=OUTPUT_DDL, outputMode="Append", timeMode="None", initialState=seed
    )
