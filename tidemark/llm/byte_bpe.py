"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

The tree's leaf at a byte position holds the rank of merging the token that starts there with its
right neighbour; its root is the least rank, the leftmost of equal ones.  A merge takes the root,
joins the two tokens and updates three leaves, those of the token, of its left neighbour and
of the one that is gone, each on its way up: n bytes cost n log n, however long the piece.  Short
pieces, nearly all of a text, get their trees as rows of one numpy array and merge side by side.
Vocabulary and pattern are parameters; nothing is trained here.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NEVER = 1 << 62
_CACHED = 250_000  # short pieces in either half of a worker's cache
_SHORT = 64  # bytes of a piece that merges in an array
_GROUP = 1 << 20  # characters whose new pieces merge together
_CODED = "token_ids binary, decoded binary"


def ranks_of(lines: bytes) -> dict[bytes, int]:
    """The vocabulary in lines of a base64 token and its rank, as files of ranks hold it."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary has every single byte")
    return ranks


class Encoder:
    """Encodes and decodes with the ranks in ``lines``; ``pattern`` cuts a text into pieces."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.ranks = ranks_of(lines)
        self.longest = max(map(len, self.ranks))
        get = self.ranks.get
        splits = [
            ((left << 32) | right, rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if (left := get(token[:k])) is not None and (right := get(token[k:])) is not None
        ]
        table = np.array(sorted(splits), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.joined = np.append(table[:, 0], _NEVER), np.append(table[:, 1], _NEVER)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}  # what the cache held before it was last full

    def merged(self, piece: bytes) -> list[int]:
        """The ids of ``piece`` after all merges.

        Leaf ``width + at`` is the rank of merging the token at ``at`` with the next one times n plus
        ``at``, so the minimum of two leaves is the lesser rank and, among equals, the one to the left.
        """
        n, get, longest = len(piece), self.ranks.get, self.longest
        width = 1 << (n - 1).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [_NEVER] * (2 * width)
        for at in range(n - 1):
            rank = get(piece[at : at + 2])
            if rank is not None:
                tree[width + at] = rank * n + at
        if n > 4_096:
            tree = array("q", tree)
        for k in range(width - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left < right else right
        while (least := tree[1]) < _NEVER:
            at = least % n
            gone = after[at]
            end = after[at] = after[gone]
            touched = [gone, at]
            if end < n:
                before[end] = at
            if at:
                touched.append(before[at])
            for leaf in touched:
                value = _NEVER
                if leaf != gone:
                    middle = after[leaf]
                    if middle < n and after[middle] - leaf <= longest:
                        rank = get(piece[leaf : after[middle]])
                        if rank is not None:
                            value = rank * n + leaf
                k = leaf + width
                tree[k] = value
                while k > 1:
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return ids

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of merging tokens ``left`` and ``right``."""
        key = (left << 32) | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], _NEVER)

    def merged_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The packed ids of pieces of 2 to ``width`` bytes, a power of two; a row of ``tree`` each."""
        length = np.array([len(p) for p in pieces])
        places = np.arange(width)
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        token = np.where(places < length[:, None], self.bytes[text], -1)
        after = np.tile(places + 1, (len(pieces), 1))
        before = np.tile(places - 1, (len(pieces), 1))
        tree = np.full((len(pieces), 2 * width), _NEVER, dtype=np.int64)
        row, at = np.nonzero(places[1:] < length[:, None])
        rank = self._pair(token[row, at], token[row, at + 1])
        tree[row, width + at] = np.where(rank < _NEVER, rank * width + at, _NEVER)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        row = np.flatnonzero(tree[:, 1] < _NEVER)
        while len(row):
            least = tree[row, 1]
            at = least % width
            gone = after[row, at]
            end = after[row, gone]
            token[row, at], token[row, gone] = least // width, -1
            after[row, at] = end
            more = end < length[row]
            before[row[more], end[more]] = at[more]
            tree[row, width + gone] = _NEVER
            tree[row[~more], width + at[~more]] = _NEVER
            left = before[row, at]
            has = left >= 0
            # the token itself where it has a right neighbour, and its left neighbour
            which = np.concatenate([row[more], row[has]])
            where = np.concatenate([at[more], left[has]])
            right = np.concatenate([end[more], at[has]])
            rank = self._pair(token[which, where], token[which, right])
            tree[which, width + where] = np.where(rank < _NEVER, rank * width + where, _NEVER)
            which = np.concatenate([row, row, row[has]])
            up = np.concatenate([at, gone, left[has]]) + width
            for _ in range(width.bit_length() - 1):
                up >>= 1
                tree[which, up] = np.minimum(tree[which, 2 * up], tree[which, 2 * up + 1])
            row = row[tree[row, 1] < _NEVER]
        live = token >= 0
        packed = token[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed ids of new pieces; a piece that is a token is that token."""
        found, classes = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            rank = self.ranks.get(raw)
            if rank is not None:
                found[piece] = packed_ids([rank])
            elif len(raw) > _SHORT:
                found[piece] = packed_ids(self.merged(raw))
            else:
                classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, members in classes.items():
            names, raws = zip(*members, strict=True)
            found.update(zip(names, self.merged_rows(list(raws), width), strict=True))
        return found

    def _packed(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of texts that are cut into pieces."""
        cache, earlier = self.cache, self.earlier
        known, new = {}, set()
        for piece in set().union(*texts):
            ids = cache.get(piece) or earlier.get(piece)
            if ids is None:
                new.add(piece)
            else:
                known[piece] = ids
        known |= self.learn(new)
        cache.update((p, ids) for p, ids in known.items() if len(p) <= _SHORT)
        if len(cache) >= _CACHED:
            self.cache, self.earlier = {}, cache
        return [b"".join(map(known.__getitem__, pieces)) for pieces in texts]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0
        for text in texts:
            text = text or ""
            if held + len(text) > _GROUP:
                out += self._packed(group)
                group, held = [], 0
            if len(text) <= _GROUP:
                group.append(self.pattern.findall(text))
                held += len(text)
            else:
                found = self.pattern.finditer(text)
                parts = []
                while pieces := [m.group() for m in islice(found, 100_000)]:
                    parts += self._packed([pieces])
                out.append(b"".join(parts))
        return out + self._packed(group)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes | None) -> bytes:
        """The bytes that packed ids stand for."""
        ids = array("I", packed or b"")
        if sys.byteorder == "big":
            ids.byteswap()
        return b"".join(map(self.tokens.__getitem__, ids))


def packed_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _encoder(vocabulary: str, pattern: str) -> Encoder:
    with open(vocabulary, "rb") as file:
        return Encoder(file.read(), pattern)


def encoded(text: Column, vocabulary: str, pattern: str) -> Column:
    """``text`` as a struct of ``token_ids`` (packed ids) and ``decoded``, the bytes these decode to.

    ``vocabulary`` is a file on the driver; the tables made of it, a few MB, travel with the tasks.
    """
    encoder = _encoder(vocabulary, pattern)

    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ids = encoder.encode_all(texts.tolist())
            yield pd.DataFrame({"token_ids": ids, "decoded": [encoder.decode(i) for i in ids]})

    return F.pandas_udf(coded, _CODED)(text)


def decoded(token_ids: Column, vocabulary: str, pattern: str) -> Column:
    """The text of packed ids; bytes that are no UTF-8 become the replacement character."""
    encoder = _encoder(vocabulary, pattern)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encoder.decode(i).decode("utf-8", "replace") for i in batch], dtype=object)

    return F.pandas_udf(texts, "string")(token_ids)


def byte_bpe(documents: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id``, ``token_ids`` (little-endian unsigned 32-bit integers) and ``decoded`` bytes of every row.

    Special tokens are ordinary text.  A null text is empty; an empty one has no ids.  Repeated
    rows and rows without doc_id give a row each, there are no ties, as equal ranks merge from the left.
    Very long texts are encoded whole; a piece of n bytes takes n log n steps and about 50 n bytes.  An
    empty table gives no rows.  Other columns are not looked at, whatever their names.
    """
    coded = documents.select("doc_id", encoded(F.coalesce("text", F.lit("")), vocabulary, pattern).alias("coded"))
    return coded.select("doc_id", "coded.token_ids", "coded.decoded")
