"""Streaming digests of ordered JSON lists; ships to the executors by value."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd


def list_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash the JSON arrays of each fixture row by row; input is sorted by fixture and order."""
    names = ["fixture_id", "event_count", "event_sequence_hash", "input_hash"]
    current, ids, facts, count = None, None, None, 0

    def closed() -> pd.DataFrame:
        ids.update(b"]")
        facts.update(b"]")
        return pd.DataFrame([[current, count, ids.hexdigest(), facts.hexdigest()]], columns=names)

    for batch in batches:
        for fixture, event_id, fact in zip(batch["fixture_id"], batch["id_json"], batch["fact_json"]):
            if fixture != current:
                if current is not None:
                    yield closed()
                current, ids, facts, count = fixture, hashlib.sha256(b"["), hashlib.sha256(b"["), 0
            separator = b"," if count else b""
            ids.update(separator + event_id.encode())
            facts.update(separator + fact.encode())
            count += 1
    if current is not None:
        yield closed()
