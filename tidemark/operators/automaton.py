"""The control automaton of one market; shared by the batch fold and the stream.

This module ships to the executors by value and depends on nothing but pyarrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

FOLD_INPUT = ("seg_key", "entry_state", "entry_change_ms", "entry_stable", "t", "pause", "widen", "healthy")
FOLD_LIMITS = ("minimum_pause_ms", "minimum_widened_ms", "recovery_cooldown_ms", "recovery_stable_updates")
STATE_NAMES = (
    "previous_state",
    "next_state",
    "action",
    "stable_updates",
    "state_change_ms",
    "previous_stable_updates",
    "previous_change_ms",
)
STATE_DDL = (
    "previous_state STRING, next_state STRING, action STRING, stable_updates BIGINT, state_change_ms BIGINT, "
    "previous_stable_updates BIGINT, previous_change_ms BIGINT"
)


class Automaton:
    """Control state of one market between two rows."""

    __slots__ = ("state", "change_ms", "stable")

    def __init__(self, state: str, change_ms: int, stable: int) -> None:
        self.state, self.change_ms, self.stable = state, change_ms, stable

    def step(self, t: int, pause: bool, widen: bool, healthy: bool, limits) -> str:
        """Apply one input and return the action; ``limits`` are the four policy timings."""
        min_pause, min_widened, cooldown, stable_needed = limits
        waited = t - self.change_ms
        if pause:
            if self.state != "PAUSED":
                return self._enter("PAUSED", t, 0, "pause")
            self.stable = 0
        elif self.state == "OPEN":
            if widen:
                return self._enter("WIDENED", t, 0, "widen")
        elif self.state == "RECOVERY":
            self.stable = self.stable + 1 if healthy else 0
            if healthy and self.stable >= stable_needed and waited >= cooldown:
                return self._enter("OPEN", t, 0, "reopen")
        elif healthy and waited >= (min_widened if self.state == "WIDENED" else min_pause):
            return self._enter("RECOVERY", t, 1, "begin_recovery")
        elif self.state == "PAUSED":
            self.stable = 0
        return "none"

    def _enter(self, state: str, t: int, stable: int, action: str) -> str:
        self.state, self.change_ms, self.stable = state, t, stable
        return action


def fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows sorted by segment and order; one automaton is alive at a time."""
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    current, auto = None, None
    for batch in batches:
        where = batch.schema.get_field_index
        cols = [batch.column(where(n)).to_pylist() for n in (*FOLD_INPUT, *FOLD_LIMITS)]
        out: list[list] = [[] for _ in STATE_NAMES]
        for segment, state, change, stable, t, pause, widen, healthy, *limits in zip(*cols):
            if segment != current:
                current = segment
                auto = Automaton(state, t if change is None else change, stable)
            was_state, was_stable, was_change = auto.state, auto.stable, auto.change_ms
            action = auto.step(t, pause, widen, healthy, limits)
            row = (was_state, auto.state, action, auto.stable, auto.change_ms, was_stable, was_change)
            for target, value in zip(out, row):
                target.append(value)
        kept = [batch.column(i) for i in range(batch.num_columns)]
        arrays = kept + [pa.array(v, type=ty) for v, ty in zip(out, types)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *STATE_NAMES])
