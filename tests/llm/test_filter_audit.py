"""Filter audit: against a plain count over documents, and the diagram's own invariants."""

from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F

from tidemark.llm.filter_audit import Diagram, adjacent_swaps, filter_audit
from tidemark.llm.oracle import OP11
from tidemark.llm.queries import op11_filter_audit

LABELS = "doc_id bigint, quality int, toxic int"


def brute(docs, labels):
    """Rows (part, order, step) -> counts, document by document."""
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    least = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    fails = []
    for d in docs:
        t = d["text"] or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": d["doc_id"] is not None and least[t] < d["doc_id"],
        }
        fails.append((d["source"] or "", {k for k, v in f.items() if v}, d["doc_id"]))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(f, i) for p, f, i in fails if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [i for f, i in left if k in f]
                left = [(f, i) for f, i in left if k not in f]
                total[k] += len(gone)
                every = sum(k in f for f, _ in own)
                out[part, "".join(order), step] = [
                    len(left), len(gone), every - len(gone), sum(f == {k} for f, _ in own),
                    sum(i in good for i in gone), sum(i in toxic for i in gone), k,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = total[row[-1]] if isinstance(row[-1], str) else row[-1]
    return {k: tuple(v) for k, v in out.items()}


def got(frame):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in frame.collect()}


def test_adjacent_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in adjacent_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swapped_diagram_equals_counting():
    rng = random.Random(1)
    for _ in range(20):
        masks = {m: (rng.randrange(9), rng.randrange(3)) for m in rng.sample(range(16), rng.randrange(0, 16))}
        diagram = Diagram(4, masks, 2)
        for at in [*adjacent_swaps(4), 0, 2, 1]:
            diagram.swap(at)
            earlier = 0
            for k, kept, removed in diagram.steps():
                bit = 1 << k
                want = [[sum(c[j] for m, c in masks.items() if not m & earlier and (m & bit > 0) == side) for j in range(2)] for side in (False, True)]
                assert [list(kept), list(removed)] == want
                earlier |= bit


def test_odd_rows_against_brute_force(spark, odd_documents):
    rng = random.Random(5)
    words = [*"abcdefgh", "Über", "XYZ", "50%", "a#b", " ", "\x1f"]
    rows = [(100 + k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 199, 200, 250]))), "en", rng.choice(["s", None, "", "t"]), 0) for k in range(60)]
    rows += [(200 + k, rows[k % 5][1], "de", "copy", 0) for k in range(40)] + [rows[3]] * 3
    docs = odd_documents.union(spark.createDataFrame(rows, odd_documents.schema))
    marks = spark.createDataFrame(
        [(100 + k, k % 2, k % 3) for k in range(50)] + [(101, None, 1), (101, None, 1), (None, 1, 1), (3, 1, None), (9_999, 1, 1)], LABELS
    )
    want = brute(docs.collect(), marks.collect())
    clashing = docs.withColumns({c: F.lit("x") for c in ("id", "part", "mask", "n", "digest", "first", "good", "toxic", "quality")})
    assert got(filter_audit(docs, marks)) == want and len(want) == 600 * len({p for p, _, _ in want})
    assert got(filter_audit(clashing, marks.withColumn("text", F.lit("y")))) == want


def test_empty_tables(spark, odd_documents):
    marks = spark.createDataFrame([], LABELS)
    assert filter_audit(odd_documents.limit(0), marks).count() == 0
    rows = got(filter_audit(odd_documents, marks))
    assert rows and all(r[4] == r[5] == 0 for r in rows.values())


def test_own_filters_without_duplicates(spark, odd_documents):
    marks = spark.createDataFrame([], LABELS)
    found = filter_audit(odd_documents, marks, {"en": F.col("lang") != "en", "tiny": F.col("n_chars") < 25}, None)
    assert {(r["filter_order"], r["step"]) for r in found.collect()} == {("entiny", 1), ("entiny", 2), ("tinyen", 1), ("tinyen", 2)}


def test_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    want = set(con.execute(f"SELECT {', '.join(columns)} FROM ({OP11})").fetchall())
    assert {tuple(r[c] for c in columns) for r in op11_filter_audit(spark, folder).collect()} == want
