"""Quality by co-training: a text view and a page-metadata view teach each other.

The text view sees which characters a text is made of and how its words repeat.  The metadata
view sees what a crawler knows of a page without reading it: language, source, and the sizes of
text, lines and words.  Each starts from the labelled rows; in every round both score all
unlabelled documents and each hands the other the documents it is most confident of.  The
views are calibrated on labelled rows they were not fitted on, and combined.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from tidemark.llm.common import fit_logistic, labelled, sigmoid, staged, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum()]
_GROUPS = np.full(256, len(_SYMBOLS) + 6)
_GROUPS[_SYMBOLS] = np.arange(len(_SYMBOLS))
for _k, _range in enumerate((range(48, 58), range(65, 91), range(97, 123), (32,), (10, 13), range(128, 256))):
    _GROUPS[list(_range)] = len(_SYMBOLS) + _k
N_GROUPS = len(_SYMBOLS) + 7
N_TEXT = N_GROUPS + 5
_HASHED = 16
N_META = 7 + 2 * _HASHED
_LINE = re.compile(rb"[^\n]+")


def text_view(text: str | None) -> np.ndarray:
    """Shares of character groups, of doubled and tripled symbols, and how words repeat.

    Shares are damped for short texts, which say little.
    """
    data = utf8(text)
    if not data:
        return np.zeros(N_TEXT)
    groups = _GROUPS[np.frombuffer(data, dtype=np.uint8)]
    counts = np.bincount(groups, minlength=N_GROUPS)
    raw = np.frombuffer(data, dtype=np.uint8)
    double = (raw[1:] == raw[:-1]) & (groups[1:] < len(_SYMBOLS))
    triple = double[1:] & double[:-1]
    words = data.split()
    n = len(words) + 5
    same = sum(map(bytes.__eq__, words, words[1:]))
    # Roots keep rare symbols visible beside letters.
    shares = np.sqrt(np.concatenate([counts, [double.sum(), triple.sum()]]) / (len(data) + 40))
    return np.concatenate([shares, [(len(words) - len(set(words))) / n, same / n, min(1.0, len(data) / n / 100)]])


def meta_view(text: str | None, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Sizes on a log scale, and hashed language and source."""
    data = utf8(text)
    lines = [len(x) for x in _LINE.findall(data)] or [0]
    n_words = data.count(b" ") + len(lines)
    n = float(n_chars) if n_chars is not None and n_chars == n_chars and n_chars > 0 else 0.0
    sizes = [n, len(data), len(lines), max(lines), sum(lines) / len(lines), n_words, len(data) / n_words]
    out = np.zeros(N_META)
    out[:7] = np.log1p(sizes)
    out[7 + zlib.crc32(utf8(lang)) % _HASHED] = 1
    out[7 + _HASHED + zlib.crc32(utf8(source)) % _HASHED] = 1
    return out


_COLUMNS = ("text", "lang", "source", "n_chars")


def _views(texts, langs, sources, sizes) -> tuple[np.ndarray, np.ndarray]:
    if not len(texts):
        return np.zeros((0, N_TEXT)), np.zeros((0, N_META))
    a = np.array([text_view(t) for t in texts])
    return a, np.array([meta_view(*row) for row in zip(texts, langs, sources, sizes, strict=True)])


@F.pandas_udf(StructType().add("a", ArrayType(FloatType())).add("b", ArrayType(FloatType())))
def views(texts: pd.Series, langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    a, b = _views(texts, langs, sources, sizes)
    return pd.DataFrame({"a": list(a.astype(np.float32)), "b": list(b.astype(np.float32))})


def _viewed(documents: DataFrame) -> DataFrame:
    missing = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    cols = [F.col(c).cast(missing[c]) if c in documents.columns else F.lit(None).cast(missing[c]) for c in _COLUMNS]
    return documents.select("doc_id", views(*cols).alias("v")).select("doc_id", "v.a", "v.b")


@dataclass(frozen=True)
class View:
    """A standardized ridge logistic classifier."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fitted(x: np.ndarray, y: np.ndarray) -> View:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        return View(mean, scale, fit_logistic(np.clip((x - mean) / scale, -8, 8), y, balance))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


@dataclass(frozen=True)
class QualityModel:
    text: View
    meta: View
    combine_text: np.ndarray  # slope and intercept that calibrate a view's logit
    combine_meta: np.ndarray
    combined: np.ndarray  # weights of both calibrated logits, intercept

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        za = self.text.logit(a) * self.combine_text[0] + self.combine_text[1]
        zb = self.meta.logit(b) * self.combine_meta[0] + self.combine_meta[1]
        w = self.combined
        return sigmoid(za), sigmoid(zb), sigmoid(w[0] * za + w[1] * zb + w[2])


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, width))


def _confident(model_text: View, model_meta: View, k: int):
    """The k most confident rows of each view and class in a batch."""

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            for view, z in (
                ("text", model_text.logit(_matrix(frame["a"], N_TEXT))),
                ("meta", model_meta.logit(_matrix(frame["b"], N_META))),
            ):
                for label, sign in ((1, -1), (0, 1)):
                    at = np.argsort(sign * z, kind="stable")[:k]
                    at = at[(z[at] > 0) == bool(label)]
                    part = frame.iloc[at]
                    yield pd.DataFrame(
                        {"view": view, "label": label, "sure": np.abs(z[at]), "doc_id": part["doc_id"], "a": part["a"], "b": part["b"]}
                    )

    return pick


def fit(
    viewed: DataFrame, labels: DataFrame, rounds: int = 3, per_class: int = 100, max_rows: int = 20_000,
) -> QualityModel:
    """Co-train on ``viewed`` (doc_id, a, b of all documents) and ``labels`` (doc_id, quality).

    At most ``max_rows`` labelled rows are fitted on, chosen by a hash of doc_id; a quarter of
    them, by crc32 of doc_id, only calibrates.  Every round scores all unlabelled documents and
    each view hands over ``per_class`` rows of either class at most.  Without labelled rows of
    both classes every document scores 1.
    """
    known = labelled(viewed, labels, F.col("quality"), F.lit(True), max_rows)
    known = known.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3).toPandas()
    y = known["target"].to_numpy(dtype=np.float64)
    a, b = _matrix(known["a"], N_TEXT), _matrix(known["b"], N_META)
    fold = known["fold"].to_numpy(dtype=bool)
    if len(set(y[~fold])) < 2:
        flat = View(np.zeros(N_TEXT), np.ones(N_TEXT), np.zeros(N_TEXT + 1)), View(np.zeros(N_META), np.ones(N_META), np.zeros(N_META + 1))
        return QualityModel(*flat, np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([0.0, 0.0, 30.0]))
    own_text = [(a[~fold], y[~fold])]
    own_meta = [(b[~fold], y[~fold])]
    pool = viewed.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    best = Window.partitionBy("view", "label").orderBy(F.desc("sure"), "doc_id")
    taken: set[tuple[str, int]] = set()
    for r in range(rounds + 1):
        text = View.fitted(np.vstack([x for x, _ in own_text]), np.concatenate([t for _, t in own_text]))
        meta = View.fitted(np.vstack([x for x, _ in own_meta]), np.concatenate([t for _, t in own_meta]))
        if r == rounds:
            break
        # Rows handed over before come first again, so each round looks that much deeper.
        depth = per_class * (r + 1)
        offers = pool.mapInPandas(_confident(text, meta, depth), "view string, label int, sure double, doc_id bigint, a array<float>, b array<float>")
        offers = offers.withColumn("place", F.row_number().over(best)).where(F.col("place") <= depth).orderBy("view", "label", "place").toPandas()
        for view, other, column, width in (("text", own_meta, "b", N_META), ("meta", own_text, "a", N_TEXT)):
            fresh = []
            for label in (0, 1):
                part = offers[(offers["view"] == view) & (offers["label"] == label)]
                fresh += [x for x in part.itertuples() if (view, x.doc_id) not in taken][:per_class]
            taken.update((view, x.doc_id) for x in fresh)
            if fresh:
                other.append((_matrix(pd.Series([getattr(x, column) for x in fresh]), width), np.array([x.label for x in fresh], dtype=np.float64)))
    held = fold if len(set(y[fold])) == 2 else ~fold
    za, zb, yh = text.logit(a[held]), meta.logit(b[held]), y[held]
    cal_text, cal_meta = fit_logistic(za[:, None], yh, l2=1e-4), fit_logistic(zb[:, None], yh, l2=1e-4)
    both = np.column_stack([za * cal_text[0] + cal_text[1], zb * cal_meta[0] + cal_meta[1]])
    return QualityModel(text, meta, cal_text, cal_meta, fit_logistic(both, yh, l2=1e-4))


def _scored(model: QualityModel, frame_a: np.ndarray, frame_b: np.ndarray) -> pd.DataFrame:
    text, meta, both = model.scores(frame_a, frame_b)
    return pd.DataFrame({"text_score": text, "meta_score": meta, "score": both})


_SCORES = "text_score double, meta_score double, score double"


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """doc_id, text_score, meta_score, score and keep (score >= threshold) for every document.

    Null texts count as empty; missing language, source or size are a value of their own; absent
    columns are null.  Repeated rows score alike; an empty table gives an empty result.
    """
    viewed = staged(_viewed(documents))
    model = fit(viewed, labels, **fitting)

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield _scored(model, _matrix(a, N_TEXT), _matrix(b, N_META))

    out = viewed.select("doc_id", F.pandas_udf(scored, _SCORES)("a", "b").alias("s"))
    return out.select("doc_id", "s.*").withColumn("keep", F.col("score") >= threshold)


def kept(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """The documents that co-training scores at ``threshold`` or more, whole rows."""
    model = fit(staged(_viewed(documents)), labels, **fitting)

    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield _scored(model, *_views(*columns))["score"]

    missing = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    cols: list[Column] = [F.col(c).cast(missing[c]) if c in documents.columns else F.lit(None).cast(missing[c]) for c in _COLUMNS]
    return documents.where(F.pandas_udf(scored, "double")(*cols) >= threshold)
