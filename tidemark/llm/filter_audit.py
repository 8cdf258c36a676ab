"""Filter interaction audit: what each filter removes in every order, from count-weighted decision diagrams.

Spark reduces the documents to counts of failure masks, at most ``2**n`` rows a part.  A part's
counts become a decision diagram: a level per filter, a pass and a fail edge per node, count
vectors as leaves, equal subgraphs shared, and each node weighted with the counts below it.  Swapping
two adjacent levels touches the nodes of these two levels only, so all orders of the filters are
visited by one swap each.  The path of pass edges of the present order gives its steps: the
weight of the fail edge is what the step removes, the weight of the pass edge what it keeps.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Counts = tuple[int, ...]

_RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


class Diagram:
    """A quasi-reduced decision diagram: ``levels[i]`` holds the (pass, fail) nodes of the i-th filter.

    Edges of a level point into the next one, those of the last level into ``leaves``.  The root is
    node 0 of the first level.  Filter k of a mask is its bit k.
    """

    def __init__(self, n_filters: int, masks: Mapping[int, Counts], width: int):
        self.order = list(range(n_filters))
        self.leaves: list[Counts] = []
        self.levels: list[list[tuple[int, int]]] = [[] for _ in self.order]
        known: list[dict] = [{} for _ in range(n_filters + 1)]

        def node(level: int, mask: int) -> int:
            if level == n_filters:
                found, store = masks.get(mask, (0,) * width), self.leaves
            else:
                found = (node(level + 1, mask), node(level + 1, mask | 1 << level))
                store = self.levels[level]
            if found not in known[level]:
                known[level][found] = len(store)
                store.append(found)
            return known[level][found]

        node(0, 0)
        self.weights: list[list[Counts]] = [[] for _ in self.order] + [self.leaves]
        for level in reversed(self.order):
            self._weigh(level)

    def _weigh(self, level: int) -> None:
        below = self.weights[level + 1]
        self.weights[level] = [tuple(a + b for a, b in zip(below[p], below[f], strict=True)) for p, f in self.levels[level]]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and ``level + 1``; nodes of ``level`` keep their numbers."""
        upper, lower = self.levels[level], self.levels[level + 1]
        known: dict[tuple[int, int], int] = {}
        turned = []
        for p, f in upper:
            (pp, pf), (fp, ff) = lower[p], lower[f]
            turned.append((known.setdefault((pp, fp), len(known)), known.setdefault((pf, ff), len(known))))
        self.levels[level], self.levels[level + 1] = turned, list(known)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self._weigh(level + 1)  # the weights of ``level`` and above are sums over the same leaves

    def steps(self) -> Iterator[tuple[int, Counts, Counts]]:
        """(filter, kept, removed) along the path on which every filter passes."""
        at = 0
        for level, which in enumerate(self.order):
            p, f = self.levels[level][at]
            yield which, self.weights[level + 1][p], self.weights[level + 1][f]
            at = p


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions whose exchanges with their right neighbours lead through all orders of n things once."""
    order, direction = list(range(n)), [-1] * n
    while True:
        movable = [
            x for at, x in enumerate(order) if 0 <= at + direction[x] < n and order[at + direction[x]] < x
        ]
        if not movable:
            return
        x = max(movable)
        at = order.index(x)
        to = at + direction[x]
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            direction[y] = -direction[y]
        yield min(at, to)


def _audited(names: list[str]):
    def audited(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
        masks = {int(m): (int(n), int(g), int(t)) for m, n, g, t in rows[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        fails = [sum(c[0] for m, c in masks.items() if m >> k & 1) for k in range(len(names))]
        alone = [masks.get(1 << k, (0,))[0] for k in range(len(names))]
        diagram, shapley, out = Diagram(len(names), masks, 3), [0] * len(names), []
        swaps = adjacent_swaps(len(names))
        while True:
            spelled = "".join(names[k] for k in diagram.order)
            for step, (k, kept, removed) in enumerate(diagram.steps(), 1):
                shapley[k] += removed[0]
                out.append((key[0], spelled, step, kept[0], removed[0], fails[k] - removed[0], alone[k], removed[1], removed[2], k))
            level = next(swaps, None)
            if level is None:
                break
            diagram.swap(level)
        columns = [c.split()[0] for c in _RESULT.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        frame["shapley"] = [shapley[k] for k in frame["shapley"]]
        return frame

    return audited


def text_filters(text: Column) -> dict[str, Column]:
    """The filters of one text alone, true where it fails; words are runs of anything but ASCII white space."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n_words = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 50 * n_words.cast("bigint"),
        "C": 100 * capitals.cast("bigint") > 2 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(documents: DataFrame, labels: DataFrame, filters: Mapping[str, Column], duplicate: bool = True) -> DataFrame:
    """Counts ``n``, ``good`` and ``toxic`` per (``part``, ``mask``): bit k of a mask is set if filter k fails.

    With ``duplicate`` one more bit follows: another row with the same text and a smaller doc_id
    exists.  Texts meet as SHA-256 digests.  Rows of one text are counted per doc_id first, which
    spreads a text that a third of all rows share, and per (text, part) next; only then are the few
    rows left of a text compared with its smallest id.
    """
    text = F.coalesce("text", F.lit(""))
    mask = F.lit(0)
    for k, failing in enumerate(filters.values()):
        mask = mask + F.coalesce(failing.cast("int"), F.lit(0)) * (1 << k)
    rows = (
        documents.select(
            F.col("doc_id").alias("id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            mask.alias("mask"),
        )
        .groupBy("id", "digest", "part", "mask")
        .agg(F.count("*").alias("n"))
    )
    marked = (
        labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(
            F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
            F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
        )
    )
    none = F.lit(0)
    rows = rows.join(marked, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("good", "toxic")})
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    if not duplicate:
        return rows.groupBy("part", "mask").agg(*sums)
    later = 1 << len(filters)
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("first"),
        F.coalesce(F.min_by("n", "id"), none).alias("n_first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), none).alias("n_nameless"),
    )
    smallest = F.min("first").over(Window.partitionBy("digest"))
    passing = F.col("n_nameless") + F.when(F.col("first") == smallest, F.col("n_first")).otherwise(none)
    groups = groups.withColumn("passing", passing)
    split = F.array(
        F.struct(F.col("mask"), F.col("passing").alias("n")),
        F.struct((F.col("mask") + later).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    rows = groups.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "good", "toxic", "s.mask", "s.n")
    return rows.where("n > 0").groupBy("part", "mask").agg(*sums)


def filter_audit(
    documents: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, duplicate: str | None = "E"
) -> DataFrame:
    """A row per part, order of the filters and step: what the step keeps, removes and costs.

    ``filters`` maps short names to conditions over ``documents`` that are true where the filter
    fails (null passes); by default those of ``text_filters``.  ``duplicate`` names the filter that
    fails on a text which a smaller doc_id holds too, anywhere in the table; None leaves it out.
    There are n! orders, so at most seven filters are taken.

    Nulls: a null text is empty, a null source is the part ``""``; a row without doc_id neither
    duplicates another nor is one, and has no label.  Empty texts are equal to each other.  Rows
    that repeat doc_id and text are all counted, and all or none of them are duplicates.  A document
    is good or toxic if any of its labels says so; labels without document do not count.  Very long
    texts are read whole, as one array of words in the executor.  An empty ``documents`` has no parts
    and gives no rows.  Columns other than doc_id, text and source, and those that ``filters`` name,
    are not looked at, whatever their names.  There are no ties: all orders are listed.
    """
    filters = text_filters(F.coalesce(F.col("text"), F.lit(""))) if filters is None else filters
    names = [*filters, *([duplicate] if duplicate else [])]
    if not 0 < len(names) <= 7:
        raise ValueError("between one and seven filters, as every order is listed")
    masks = failure_masks(documents, labels, filters, bool(duplicate))
    return masks.groupBy("part").applyInPandas(_audited(names), _RESULT)
