"""Operator 1: quality classifier, a generalised additive model with pairwise interactions.

Features of the whole text are binned by quantiles of the training sample.
Boosting goes round the features in turn: each step fits a tree of a few leaves
to one feature's bins and adds it, shrunk, to that feature's lookup table. Then
the pairs of features with the strongest remaining interaction get tables of
their own, boosted in turn by trees of depth two. A score is the logistic of the
intercept plus one entry from each table: vectorised additions by bin.

The model is fitted on the driver from a sample of labelled documents whose
expected size is a parameter (`bound`); labels are drawn by a hash of the id, so
the sample is the same on every run. Scoring reads each document once, where it
lies, without a shuffle.

Defined results: a null or empty text has zero for every feature and is scored;
without a usable label every score is 0.5, with labels of one class it is their
shrunk rate; repeated rows each give a row; a null doc_id is never held out and
never labelled; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import sparing

FEATURES = (
    "log_bytes", "upper", "digit", "space", "stop", "comma", "mark", "symbol", "bar", "other_punct", "high",
    "word_bytes", "distinct_words", "repeated_lines", "log_lines", "top_word", "marked_words", "long_words",
)


def _class_table() -> tuple[np.ndarray, list[str]]:
    sets = {
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "stop": b".", "comma": b",;:",
        "mark": b"!?", "symbol": b"#$%&*@^~<>=+_{}[]\\/", "bar": b"|", "other_punct": b"'\"()`-", "high": bytes(range(128, 256)),
    }
    table = np.zeros(256, np.uint8)
    for k, chars in enumerate(sets.values(), 1):
        table[np.frombuffer(chars, np.uint8)] = k
    return table, list(sets)


CLASSES, CLASS_NAMES = _class_table()


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    at = {n: i for i, n in enumerate(FEATURES)}
    for r, text in enumerate(texts):
        if not text:
            continue
        data = text.encode()
        n = len(data)
        counts = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=len(CLASS_NAMES) + 1)
        row = out[r]
        row[at["log_bytes"]] = np.log1p(n)
        for k, name in enumerate(CLASS_NAMES, 1):
            row[at[name]] = counts[k] / n
        words = text.split()
        if words:
            seen: dict[str, int] = {}
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            row[at["word_bytes"]] = (n - counts[CLASS_NAMES.index("space") + 1]) / len(words)
            row[at["distinct_words"]] = len(seen) / len(words)
            row[at["top_word"]] = max(seen.values()) / len(words)
            row[at["marked_words"]] = sum(c for w, c in seen.items() if not w[-1].isalnum()) / len(words)
            row[at["long_words"]] = sum(c for w, c in seen.items() if len(w) > 12) / len(words)
        lines = [x for x in text.split("\n") if x.strip()]
        row[at["log_lines"]] = np.log1p(len(lines))
        if lines:
            row[at["repeated_lines"]] = 1 - len(set(lines)) / len(lines)
    return out


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, total = self.bins(x), np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _best_split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = _gain(left_g, left_h, ridge) + _gain(right_g, right_h, ridge) - _gain(g.sum(), h.sum(), ridge)
    gain[(left_h < least) | (right_h < least)] = 0.0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> float:
    return float(g.sum() / (h.sum() + ridge))


def _tree_1d(g: np.ndarray, h: np.ndarray, ridge: float, least: float, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree with so many leaves, grown best first."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        found = [(*_best_split(g[a:b], h[a:b], ridge, least), a, b) for a, b in spans]
        gain, cut, a, b = max(found)
        if gain <= 1e-9:
            break
        spans.remove((a, b))
        spans += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(g[a:b], h[a:b], ridge)
    return out


def _tree_2d(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, float]:
    """Values by cell of a tree of depth two that cuts one feature, then the other in each part; and its gain."""
    best, best_gain = np.zeros(g.shape), 0.0
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            total, out = -float(_gain(g.sum(), h.sum(), ridge)), np.zeros(gg.shape)
            for rows in (slice(0, cut), slice(cut, None)):
                cg, ch = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                gain, at = _best_split(cg, ch, ridge, least)
                total += gain + float(_gain(cg.sum(), ch.sum(), ridge))
                for cols in (slice(0, at), slice(at, None)) if gain > 0 else (slice(None),):
                    out[rows, cols] = _leaf(cg[cols], ch[cols], ridge)
            if total > best_gain:
                best, best_gain = out.T if flip else out, total
    return best, best_gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 4, max_bins: int = 32, rate: float = 0.1, ridge: float = 1.0, least: float = 1.0) -> AdditiveModel:
    """Cyclic boosting of the features' tables, then of the strongest pairs' tables."""
    model = AdditiveModel()
    if not len(y):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins, total = model.bins(x), np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = gradients()
            step = rate * _tree_1d(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), ridge, least)
            table += step
            total += step[bins[:, j]]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.tables[a]), len(model.tables[b]))
        g, h = gradients()
        flat = bins[:, a] * shape[1] + bins[:, b]
        return tuple(np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = [(_tree_2d(*cells(a, b), ridge, least)[1], a, b) for a, b in combinations(range(x.shape[1]), 2)]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            step = rate * _tree_2d(*cells(a, b), ridge, least)[0]
            table += step
            total += step[bins[:, a], bins[:, b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on about `bound` labelled documents at most, none of them held out."""
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).where(~held_out(F.col(id_col))).select(F.col(id_col).alias("told_id"), F.col(label_col).cast("int").alias("told"))
    share = min(1.0, bound / max(told.count(), 1))
    drawn = told.where(F.pmod(F.xxhash64("told_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about `bound` rows of two numbers
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("told_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "told", "x"])

    made = sample.select("doc_id", "text", "told").mapInArrow(sparing(run), "doc_id long, told int, x array<double>")
    # repeated rows count once, so the driver gets no more rows than there are labels drawn
    rows = made.groupBy("doc_id", "told").agg(F.min("x").alias("x")).toPandas()
    rows = rows.sort_values(["doc_id", "told"], kind="stable")
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES))
    return fit(x, rows["told"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(sparing(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score the threshold or more."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at).to_pylist())) >= threshold))

    return docs.mapInArrow(sparing(run), docs.schema)
