"""Personal data by a character-level BiLSTM-CRF beside exact base patterns.

The network learns from spans that the base patterns label on a bounded sample of windows.  It
reads every text around each character that personal data of these kinds cannot do without (a
digit or an @; the rest of the text can hold none).  Windows overlap; the scores of a character
are averaged over its windows, weighted towards their middle, and one decoding runs over the
whole stretch, so a span cut by a window's edge is found once and whole.  A found span counts
if it passes the exact test of its kind and overlaps no base span.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tagger import Tagger, encode

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, CONTEXT = 96, 48, 40
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts, so long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def passes(kind: str, text: str) -> bool:
    """The exact test of a kind, for text of the right shape."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in text.split("."))
    if kind == "card":
        return 13 <= len(number := digits(text)) <= 19 and luhn(number)
    if kind == "phone":
        return 9 <= len(digits(text)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[Span]:
    """The base patterns' spans, by kind as listed, then start."""
    if not text or not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(kind, m.group())]
    return out


def tags(spans: list[Span], start: int, length: int) -> np.ndarray:
    """Begin and inside tags of the first span at each character of a window; 0 is outside."""
    out = np.zeros(length, dtype=np.int64)
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        a, b, tag = max(a - start, 0), min(b - start, length), 1 + 2 * KINDS.index(kind)
        if a < b and not out[a:b].any():
            out[a:b] = tag + 1
            out[a] = tag
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of ``text`` within CONTEXT characters of a trigger."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_starts(a: int, b: int) -> range:
    return range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)


_CENTRED = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])


def _sound(kind: str, text: str) -> bool:
    if kind == "email":
        return "@" in text and _DOMAIN.fullmatch(text.rpartition("@")[2]) is not None
    if kind == "ip":
        return _IP.fullmatch(text) is not None and passes(kind, text)
    return passes(kind, text)


def found_spans(model: Tagger, texts: list[str], block: int = 2048) -> list[list[Span]]:
    """The network's spans of every text that pass their kind's test, by kind, then start."""
    jobs = [(k, a, b) for k, text in enumerate(texts) for a, b in stretches(text)]
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(jobs):  # about ``block`` windows at a time, whole stretches
        upto, n = at, 0
        while upto < len(jobs) and (n == 0 or n < block):
            n += len(window_starts(*jobs[upto][1:]))
            upto += 1
        part, at = jobs[at:upto], upto
        places = [(k, s) for k, a, b in part for s in window_starts(a, b)]
        scores = []
        for x in range(0, len(places), block):  # a stretch of its own may be longer than a block
            codes = np.stack([encode(texts[k][s : s + WINDOW], WINDOW) for k, s in places[x : x + block]])
            scores.append(model.unary(codes))
        unary, row = np.concatenate(scores), 0
        for k, a, b in part:
            total, weight = np.zeros((b - a, model.n_tags)), np.zeros(b - a)
            for s in window_starts(a, b):
                n = min(WINDOW, b - s)
                total[s - a : s - a + n] += unary[row, :n] * _CENTRED[:n, None]
                weight[s - a : s - a + n] += _CENTRED[:n]
                row += 1
            best = model.viterbi(total / weight[:, None])
            start = None
            for x in range(len(best) + 1):
                tag = int(best[x]) if x < len(best) else 0
                if start is not None and (tag == 0 or tag % 2 == 1 or (tag - 1) // 2 != kind):
                    text = texts[k][a + start : a + x]
                    if _sound(KINDS[kind], text):
                        out[k].append((KINDS[kind], a + start, a + x))
                    start = None
                if tag and start is None:
                    start, kind = x, (tag - 1) // 2
    return out


def fit(documents: DataFrame, max_windows: int = 3_000, epochs: int = 6) -> Tagger:
    """Train on at most ``max_windows`` windows around triggers, chosen by a hash of their text.

    The bound is on what the network is fitted on.  Without any window it stays untrained and
    marks nothing.
    """

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                spans = base_spans(text)
                for a, b in stretches(text):
                    for s in window_starts(a, b):
                        rows.append((text[s : s + WINDOW], tags(spans, s, WINDOW).tolist()))
            yield pd.DataFrame(rows, columns=["window", "tags"])

    held = documents.select("text").where(F.col("text").rlike("[0-9@]"))
    sample = held.mapInPandas(windows, "window string, tags array<int>")
    got = sample.orderBy(F.xxhash64("window"), "window").limit(max_windows).toPandas()
    model = Tagger(1 + 2 * len(KINDS))
    if len(got):
        model.fit(np.stack([encode(w, WINDOW) for w in got["window"]]), np.array([list(t) for t in got["tags"]], dtype=np.int64), epochs)
    else:
        model.p["c"][0] = 100.0
    return model


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def personal_data(documents: DataFrame, model: Tagger) -> DataFrame:
    """``documents`` with ``pii``: base (the base patterns' spans) and spans (those and the network's).

    Spans are code points, end exclusive, by kind as listed, then start.  Null and empty texts
    have none; repeated rows get the same spans.  Column names other than ``text`` and ``pii`` are free.
    """

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base = [base_spans(t) for t in texts]
            every = [list(b) for b in base]
            held = [k for k, t in enumerate(texts) if t and _TRIGGER.search(t)]
            for k, spans in zip(held, found_spans(model, [texts.iloc[k] for k in held]), strict=True):
                taken = base[k]
                every[k] += [s for s in spans if all(s[2] <= a or b <= s[1] for _, a, b in taken)]
                every[k].sort(key=lambda s: (KINDS.index(s[0]), s[1]))
            yield pd.DataFrame({"base": base, "spans": every})

    return documents.withColumn("pii", F.pandas_udf(scan, f"base {_SPAN}, spans {_SPAN}")("text"))
