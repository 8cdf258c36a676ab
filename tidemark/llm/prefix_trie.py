"""Conversation prefix trie: every distinct sequence of first turns, with what a prefix cache would save.

A turn becomes a 16-byte digest and a conversation the string of its digests, its path.  Spark
sorts the paths by range, hot ones split by conversation, and tasks take them block by block: the
digests of a block become a matrix of turn numbers padded with zeros, a lexsort orders its rows, a
change mask that ORs column after column marks where the nodes of each depth start, and ``reduceat``
adds up each depth.  Nodes on the first and the last path of a block may go on in its neighbours:
they leave the block as chains of partial sums, which are sorted and merged by the same code
until one block is left.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = 16  # bytes of a turn's digest
CELLS = 4_000_000  # of a padded matrix
ROWS = 50_000  # of a block
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
_SUMS = ("n", "least", "children", "leaves", "saved")

_OUT = (
    "kind string, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, path binary, sizes array<bigint>, "
    + ", ".join(f"{c} array<bigint>" for c in _SUMS)
    + ", ids string"
)
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_INTEGERS = {c.split()[0] for c in _OUT.split(", ") if c.endswith(" bigint")}


@dataclass
class Depth:
    """The nodes of one depth, in row order: first row, parent among the nodes above, partial sums."""

    first: np.ndarray
    parent: np.ndarray
    open: np.ndarray
    n: np.ndarray
    least: np.ndarray
    children: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    size: np.ndarray
    ends: dict[int, np.ndarray]


def _ragged(rows: list[np.ndarray], shape: tuple[int, int], fill: int = 0) -> np.ndarray:
    out = np.full(shape, fill, dtype=np.int64)
    length = np.array([len(r) for r in rows])
    if length.sum():
        out[np.arange(shape[1]) < length[:, None]] = np.concatenate(rows)
    return out


def depths(paths: list[bytes], sizes: list[np.ndarray], ids: np.ndarray | None, sums: dict[str, list] | None, last: bool):
    """The sorted rows of a block and its nodes, depth by depth; ``last``: no node goes on elsewhere."""
    length = np.array([len(p) // KEY for p in paths])
    deepest = int(length.max())
    turns = np.frombuffer(b"".join(paths), dtype=f"S{KEY}")
    numbers = np.zeros((len(paths), deepest), dtype=np.int32)
    if len(turns):
        numbers[np.arange(deepest) < length[:, None]] = np.unique(turns, return_inverse=True)[1].ravel() + 1
    tie = np.arange(len(paths)) if ids is None else ids
    order = np.lexsort((tie, *numbers.T[::-1]))
    numbers, length = numbers[order], length[order]
    paths, ids = [paths[k] for k in order], None if ids is None else ids[order]
    size = _ragged([sizes[k] for k in order], numbers.shape)
    if sums is None:
        ones, zeros = np.ones(len(paths), dtype=np.int64), np.zeros(len(paths), dtype=np.int64)
        at = {"n": ones, "least": ids, "children": zeros, "leaves": zeros, "saved": zeros}
        column = lambda name, d: at[name]
    else:
        shape = (len(paths), deepest + 1)
        at = {c: _ragged([sums[c][k] for k in order], shape, _NONE if c == "least" else 0) for c in _SUMS}
        column = lambda name, d: at[name][:, d]
    changed = np.zeros(len(paths), dtype=bool)
    changed[0] = True
    above = np.zeros(len(paths), dtype=np.int64)
    levels: list[Depth] = []
    for d in range(deepest + 1):
        if d:
            changed[1:] |= numbers[1:, d - 1] != numbers[:-1, d - 1]
        rows = np.flatnonzero(length >= d)
        starts = np.flatnonzero(changed[rows])
        first = rows[starts]
        add = {c: (np.minimum if c == "least" else np.add).reduceat(column(c, d)[rows], starts) for c in _SUMS}
        node = np.cumsum(changed[rows]) - 1
        parent = above[first]
        above = np.zeros(len(paths), dtype=np.int64)
        above[rows] = node
        going_on = np.zeros(len(first), dtype=bool)
        if not last:
            going_on[0] |= rows[0] == 0
            going_on[-1] |= rows[-1] == len(paths) - 1
        ends: dict[int, np.ndarray] = {}
        if ids is not None:
            ending = length[rows] == d
            own, where = ids[rows[ending]], node[ending]
            cuts = np.flatnonzero(np.diff(where)) + 1
            ends = dict(zip(where[np.r_[0, cuts]].tolist(), np.split(own, cuts), strict=True)) if len(where) else {}
        levels.append(Depth(first, parent, going_on, **add, size=size[first, d - 1] if d else np.zeros(1, dtype=np.int64), ends=ends))
    for d in range(deepest, -1, -1):
        level = levels[d]
        closed = ~level.open
        level.leaves = np.where(closed & (level.children == 0), 1, level.leaves)
        level.saved = level.saved + np.where(closed, (level.n - 1) * level.size, 0)
        if d:
            up, parent = levels[d - 1], level.parent[closed]
            np.add.at(up.children, parent, 1)
            np.add.at(up.leaves, parent, level.leaves[closed])
            np.add.at(up.saved, parent, level.saved[closed])
    return paths, [size[k, : length[k]] for k in range(len(paths))], levels


def _digests(path: bytes) -> list[bytes]:
    """A key for every prefix of ``path``, the empty one first."""
    h, out = hashlib.sha256(), []
    for at in range(0, len(path) + 1, KEY):
        out.append(h.digest())
        h.update(path[at : at + KEY])
    return out


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _rows(values: dict) -> pd.DataFrame:
    """Integers stay integers where other rows of the block have none."""
    return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in _INTEGERS else v for c, v in values.items()})


def _block(paths, sizes, ids, sums, last) -> pd.DataFrame:
    paths, sizes, levels = depths(paths, sizes, ids, sums, last)
    edges = [0] if paths[0] == paths[-1] else [0, len(paths) - 1]
    keys = {k: _digests(paths[k]) for k in edges}
    holder = {  # by depth, the edge row that speaks for an open node
        (d, j): (0 if level.first[j] == 0 else edges[-1]) for d, level in enumerate(levels) for j in np.flatnonzero(level.open).tolist()
    }
    merging = sums is not None
    if merging:
        keys = {int(f): None for level in levels for f in level.first}
        keys = {k: _digests(paths[k]) for k in {*keys, *edges}}
    out = []
    for d, level in enumerate(levels):
        closed = np.flatnonzero(~level.open)
        if len(closed):
            frame = {
                "kind": ["node"] * len(closed),
                "conv_id": level.least[closed],
                "depth": np.full(len(closed), d),
                "n_convs": level.n[closed],
                "n_children": level.children[closed],
                "n_leaves": level.leaves[closed],
                "saved_tokens": level.saved[closed],
            }
            if merging:
                frame["key"] = [keys[k][d] for k in level.first[closed].tolist()]
            else:
                hashed = {j: hashlib.sha256(_joined(own).encode()).hexdigest() for j, own in level.ends.items()}
                frame["ends_sha256"] = [hashed.get(j, _EMPTY) for j in closed.tolist()]
            if d:
                up, parent = levels[d - 1], level.parent[closed]
                unknown = up.open[parent]
                frame["parent_conv_id"] = pd.arrays.IntegerArray(up.least[parent].astype(np.int64), unknown)
                frame["parent_key"] = [
                    keys[holder[d - 1, j]][d - 1] if (d - 1, j) in holder else None for j in parent.tolist()
                ]
            out.append(_rows(frame))
        for j in np.flatnonzero(level.open).tolist():
            if j in level.ends:
                own = level.ends[j]
                out.append(_rows({"kind": ["piece"], "key": [keys[holder[d, j]][d]], "conv_id": own[:1], "ids": [_joined(own)]}))
    if not last:
        for k in edges:
            partial = {c: [] for c in _SUMS}
            for d in range(len(paths[k]) // KEY + 1):
                level = levels[d]
                j = 0 if k == 0 else len(level.first) - 1
                own = holder[d, j] == k
                for c in _SUMS:
                    partial[c].append(int(getattr(level, c)[j]) if own else _NONE if c == "least" else 0)
            chain = {"kind": ["chain"], "path": [paths[k]], "sizes": [sizes[k].tolist()]}
            out.append(_rows(chain | {c: [v] for c, v in partial.items()}))
    frame = pd.concat(out, ignore_index=True).reindex(columns=_COLUMNS).astype({c: "Int64" for c in _INTEGERS})
    for c in frame.columns.difference(_INTEGERS):
        frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
    return frame


def _blocks(merging: bool, last: bool, cells: int, most: int):
    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sizes", *(_SUMS if merging else ["conv_id"])]
        held: list[tuple] = []
        deepest = 1

        def flushed() -> pd.DataFrame:
            taken = dict(zip(columns, map(list, zip(*held, strict=True)), strict=True))
            ids = None if merging else np.array(taken["conv_id"], dtype=np.int64)
            return _block(taken["path"], taken["sizes"], ids, {c: taken[c] for c in _SUMS} if merging else None, last)

        for frame in frames:
            for row in frame[columns].itertuples(index=False, name=None):
                deepest = max(deepest, len(row[0]) // KEY)
                if held and not last and (len(held) >= most or (len(held) + 1) * deepest > cells):
                    yield flushed()
                    held, deepest = [], max(1, len(row[0]) // KEY)
                held.append(row)
        if held:
            yield flushed()

    return blocks


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of each key, which come sorted; one piece is held at a time."""
    key, h = None, None
    for frame in frames:
        done = []
        for k, ids in zip(frame["key"], frame["ids"], strict=True):
            if k == key:
                h.update(b",")
            else:
                if key is not None:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            h.update(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends"])


def turns(conversations: DataFrame) -> DataFrame:
    """A row per conversation: ``conv_id``, the digests of its turns as hex ``keys``, their ``sizes`` in bytes."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    said = F.sha2(text, 256)
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        said.alias("said"),
        F.substring(F.sha2(F.concat(role, said), 256), 1, 2 * KEY).alias("key"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    grouped = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    grouped = grouped.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """``turns`` with the first h turns of each conversation taken from conversation c - c % ``group``.

    h is the crc32 of the decimal c modulo ``most`` + 1.  A conversation without turns of its own
    beyond h keeps what the other one has, possibly nothing.
    """
    own = turns(conversations)
    c = F.col("conv_id")
    other = own.where(c % group == 0).select(
        c.alias("base_id"), F.slice("keys", 1, most).alias("base_keys"), F.slice("sizes", 1, most).alias("base_sizes")
    )
    h = (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int")
    joined = own.join(other, c - c % group == F.col("base_id"), "left").withColumn("h", h)

    def spliced(name: str):
        none = F.array().cast(own.schema[name].dataType)
        head = F.slice(F.coalesce(F.col(f"base_{name}"), none), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.size(name)))

    return joined.select("conv_id", spliced("keys").alias("keys"), spliced("sizes").alias("sizes"))


def prefix_trie(sequences: DataFrame, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """A row per node of the trie over ``sequences`` (``conv_id``, ``keys``, ``sizes``), as ``turns`` gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Tasks hold a block of at most ``rows`` conversations or ``cells``
    padded turns; a conversation with more turns than that is a block of its own, so the longest single
    conversation must fit into a task.  The chains of open nodes, two a block, are merged in levels
    of the same size.  The decimal ids that end in one node are hashed in order by one task, which
    streams over strings that the blocks have put together.

    Nulls: a turn without number comes first, a null role or text is empty; rows without conv_id
    take no part.  Ties: turns of equal number come in the order of role and of the text's SHA-256.
    Repeated rows are repeated turns.  Empty texts are turns of no bytes, very long ones count as
    digests.  An empty table gives no rows, not even a root; other columns are not looked at.
    """
    packed = sequences.select("conv_id", F.unhex(F.array_join("keys", "")).alias("path"), "sizes")
    spread = staged(packed).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = [staged(spread.mapInPandas(_blocks(False, False, cells, rows), _OUT))]
    last, before = False, None
    while not last:
        chains = found[-1].where("kind = 'chain'").select("path", "sizes", *_SUMS)
        n, deepest = chains.agg(F.count("*"), F.max(F.octet_length("path"))).first()
        held = n * max(1, (deepest or 0) // KEY)
        last = held <= cells or n == before  # paths too long to be merged with any other are left to one task
        before = n
        if last:
            merged = chains.coalesce(1).sortWithinPartitions("path")
        else:
            merged = chains.repartitionByRange(2 * held // cells, "path").sortWithinPartitions("path")
        found.append(staged(merged.mapInPandas(_blocks(True, last, cells, rows), _OUT)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = [f.where("kind = 'node'") for f in found]
    pieces = found[0].where("kind = 'piece'").select("key", "conv_id", "ids")
    hashed = pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(_ends, "key binary, ends string")
    merged = reduce(DataFrame.unionAll, nodes[1:]).join(hashed, "key", "left")
    merged = staged(merged.withColumn("ends_sha256", F.coalesce("ends", F.lit(_EMPTY))))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found_parent"))
    whole = nodes[0].select("parent_key", *names)
    pending = whole.where("parent_key is not null").unionAll(merged.select("parent_key", *names))
    pending = pending.join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found_parent"))
    return whole.where("parent_key is null").select(names).unionAll(pending.select(names))
