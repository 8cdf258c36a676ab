"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Every word of the benchmark becomes one character, any other word the character zero, so the
automaton steps once a word and a text is scanned once whatever the number of windows.  Word
positions of hits are mapped back to offsets in the original text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import ALNUM, staged, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
_SPANS = "array<struct<start:bigint,end:bigint>>"
_RESULT = f"n_words bigint, hits {_SPANS}, items array<string>, spans {_SPANS}"


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM).split()


def windows(items: list[tuple[str | None, str | None]], width: int) -> dict[tuple[bytes, ...], set[str]]:
    """The windows of ``items`` with the ids they belong to; an item without id has windows, too."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            found.setdefault(tuple(w[k : k + width]), set()).update([item_id] if item_id is not None else [])
    return found


def automaton(found: dict[tuple[bytes, ...], set[str]]):
    import ahocorasick

    letters: dict[bytes, str] = {}
    for window in found:
        for w in window:
            if w not in letters:
                code = len(letters) + 1
                letters[w] = chr(code if code < 0xD800 else code + 0x800)
    machine = ahocorasick.Automaton()
    for window, ids in found.items():
        machine.add_word("".join(letters[w] for w in window), (len(window), tuple(sorted(ids))))
    machine.make_automaton()
    return letters, machine


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def offsets(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of hit words as code-point offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


def _scan(found: dict[tuple[bytes, ...], set[str]]):
    def scan(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        letters, machine = automaton(found)
        for texts, before, ids in frames:
            rows = []
            for text, old, old_ids in zip(texts, before, ids, strict=True):
                w = words(text)
                spans = [] if old is None else [(x["start"], x["end"]) for x in old]
                items = set() if old_ids is None else set(old_ids)
                if found and w:
                    for end, (length, own) in machine.iter("".join([letters.get(x, "\0") for x in w])):
                        spans.append((end - length + 1, end + 1))
                        items.update(own)
                spans = merged(spans)
                rows.append((len(w), spans, sorted(items), offsets(text, spans) if spans else []))
            yield pd.DataFrame(rows, columns=["n_words", "hits", "items", "spans"])

    return F.pandas_udf(scan, _RESULT)


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 200_000) -> DataFrame:
    """``documents`` with ``found``: n_words, hits (word runs), items (sorted ids), spans (offsets).

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is
    one window.  Null texts and texts without words have no hits.  Repeated items count once;
    items without id hit but are not listed.  An empty benchmark hits nothing.  Column names of
    ``documents`` other than ``text`` and ``found`` are free.

    The benchmark goes to the workers in blocks of about ``block_words`` words (one block for
    any usual benchmark); each further block is a further pass over the staged documents, so
    a worker never holds more than one block's automaton.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    n_words = F.size(F.split("text", r"\s+"))
    total = items.agg(F.coalesce(F.sum(n_words), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-2 * total // block_words)) if total > block_words else 1
    out = documents.withColumn("found", F.lit(None).cast(StructType.fromDDL(_RESULT)))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        scan = _scan(windows([(r["item_id"], r["text"]) for r in block.collect()], width))
        out = out.withColumn("found", scan("text", F.col("found.hits"), F.col("found.items")))
        if k + 1 < blocks:
            out = staged(out)
    return out


def uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of ``benchmark`` occurs."""
    return contamination(documents, benchmark).where(F.size("found.hits") == 0).drop("found")
