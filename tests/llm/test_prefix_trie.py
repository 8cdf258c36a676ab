"""Prefix trie: against a dictionary of prefixes, with blocks so small that nearly every node is open."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.oracle import OP12
from tidemark.llm.prefix_trie import KEY, prefix_trie, rebuilt, turns
from tidemark.llm.queries import op12_prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    """Ordered (role, text) turns by conv_id."""
    own = {}
    for r in rows:
        if r[0] is not None:
            role, text = r[2] or "", r[3] or ""
            own.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    return {c: [(t[2], t[4]) for t in sorted(own[c])] for c in own}


def rebuild(own):
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + said[h:]
    return out


def brute(convs):
    nodes = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(c)
    rows = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        parents = {p[:-1] for p in nodes if p}
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        rows.add((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in below), sum(p not in parents for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return rows


def got(frame):
    return [tuple(r[c] for c in COLUMNS) for r in frame.collect()]


def check(frame, want):
    rows = got(frame)
    assert len(rows) == len(want) and set(rows) == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    made = []
    for c in rng.sample(range(160), 110):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 12])):
            made.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "so", "", None, "é" * 9])))
    made += [(200 + c, t, "user", "same opening") for c in range(40) for t in range(3)]  # a hot path
    made += [(7, None, "user", "no number"), (7, None, None, None), (None, 1, "user", "no id"), (9, 1, "user", "twice"), (9, 1, "user", "twice")]
    made += [(2**60 + 1, 0, "user", "x" * 300_000), (-3, 0, "user", "hi"), (500, 0, "user", "z")]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize(("cells", "most"), [(4_000_000, 50_000), (60, 7), (20, 3), (1, 1)])
def test_trie_against_brute_force(spark, rows, cells, most):
    frame = spark.createDataFrame(rows, SCHEMA)
    check(prefix_trie(rebuilt(frame), cells, most), brute(rebuild(sequences(rows))))


def test_plain_turns_and_clashing_columns(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("keys", "sizes", "path", "key", "t", "h", "kind", "n", "base_id", "depth"):
        frame = frame.withColumn(name, F.lit("x"))
    check(prefix_trie(turns(frame), 100, 11), brute(sequences(rows)))
    check(prefix_trie(rebuilt(frame)), brute(rebuild(sequences(rows))))


def test_long_conversation_among_short_ones(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(700)] + [(2, t, "user", f"turn {t}") for t in range(699)] + [(3, 0, "user", "turn 0")]
    found = got(prefix_trie(turns(spark.createDataFrame(rows, SCHEMA)), 1_000, 50))
    assert len(found) == 701 and {r[3] for r in found} == {1, 2, 3}
    assert max(found, key=lambda r: r[1])[:6] == (1, 700, 1, 1, 0, 1)


def test_turnless_and_empty(spark):
    # conversation 4 replaces its first turns by those of conversation 0, which does not exist
    h = zlib.crc32(b"4") % 9
    rows = [(4, t, "user", "a") for t in range(h)]
    assert h and got(prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA)))) == [
        (4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())
    ]
    assert got(prefix_trie(turns(spark.createDataFrame([], SCHEMA)))) == []
    assert KEY == 16


def test_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12})").fetchall()
    check(op12_prefix_trie(spark, folder), set(want))
