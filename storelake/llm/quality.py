"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. What is seen of a line are its own features and those of the
lines before and after it; neighbouring labels attract or repel each other. The field is
trained in numpy on a bounded number of labelled documents, whose lines all take their
document's label. Forward and backward sums give each line's probability of being good,
and the mean over lines, weighted by their length, is read by a logistic curve fitted on
the same documents.

The sums over a chain are products of two-by-two matrices. They are taken for all lines
of a slice at once by doubling the stretch that each line has summed up, so a text of a
million lines takes twenty steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelake.llm.text import Hasher, buffers, lowered, slices, spans_of_words
from storelake.llm.toxicity import labelled_sample, not_held_out, with_scores

#: At most so many labelled texts of either label are collected, none longer than this.
SAMPLE_OF_LABEL = 1000
LONGEST_SAMPLE = 100_000
STEPS = 150
OWN_FEATURES = 16


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (bytes) of each line, and the row it is in; each row has a line."""
    breaks = np.flatnonzero(data == 10) + 1
    rows = len(offsets) - 1
    begin = np.concatenate([offsets[:-1], breaks])
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks - 1, "right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    end = np.append(begin[1:] - 1, len(data))
    last = np.append(row[1:] != row[:-1], True)
    end[last] = offsets[row[last] + 1]
    return begin, np.maximum(end, begin), row


#: Classes of bytes, by their code.
CLASSES = np.full(256, 4, np.int8)
CLASSES[[9, 11, 12, 13, 32]] = 0
CLASSES[97:123] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3
CLASSES[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
CLASSES[128:] = 6


def features(data: np.ndarray, offsets: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (own, the line's before, the line's after), length, row."""
    begin, end, row = lines_of(data, offsets)
    size = end - begin
    kinds = CLASSES[data]
    share = np.maximum(size, 1)

    def counted(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit)])
        return (sums[end] - sums[begin]).astype(np.float64)

    own = [np.log1p(size) / 8, size == 0]
    own += [counted(kinds == kind) / share for kind in range(7)]
    first, last, _ = spans_of_words(data, offsets)
    line = np.searchsorted(begin, first, "right") - 1
    words = np.bincount(line, minlength=len(begin)).astype(np.float64)
    each = np.maximum(words, 1)
    odd = kinds[last - 1] == 4
    short = last - first == 1
    ends = data[last - 1]
    own += [np.bincount(line, last - first, len(begin)) / each / 10,
            np.bincount(line, odd, len(begin)) / each,
            np.bincount(line, short, len(begin)) / each,
            np.bincount(line, (ends == 33), len(begin)) / each,
            np.isin(data[np.maximum(end - 1, 0)] if len(data) else size, [33, 46, 58, 63])]
    hasher = Hasher(lowered(data))
    named = hasher(first, last)
    again = np.append(False, (named[1:] == named[:-1]) & (line[1:] == line[:-1]))[:len(first)]
    own += [np.bincount(line, again, len(begin)) / each]
    key = hasher(begin, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    own += [(times[back] > 1) & (size > 0)]
    own = np.column_stack([np.asarray(x, np.float64) for x in own])
    same = row[1:] == row[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return np.column_stack([own, before, after, np.ones(len(own))]), size, row


def _products(steps: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Product of the matrices from the row's first line to each, up to a factor."""
    out, span, n = steps.copy(), 1, len(row)
    while span < n:
        inside = np.flatnonzero(row[span:] == row[:-span]) + span
        if not len(inside):
            break
        a, b = out[inside - span], out[inside]
        both = a[:, :, :1] * b[:, :1, :] + a[:, :, 1:] * b[:, 1:, :]
        out[inside] = both / both.reshape(-1, 4).max(1)[:, None, None]
        span *= 2
    return out


@dataclass
class Field:
    """Weights of good against bad, of each pair of neighbouring labels, and of the curve."""

    weights: np.ndarray
    pairs: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def steps(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        """For each line: from the label before to its own; a first line has no before."""
        energy = np.zeros((len(row), 2, 2))
        energy[:, :, 1] = np.clip(x @ self.weights, -30, 30)[:, None]
        inner = np.append(False, row[1:] == row[:-1])
        energy[inner] += self.pairs
        return np.exp(energy - energy.max(axis=(1, 2), keepdims=True))

    def marginals(self, x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each label of a line, and of each pair with the line before."""
        if not len(row):
            return np.zeros((0, 2)), np.zeros((0, 2, 2))
        steps = self.steps(x, row)
        ahead = _products(steps, row).sum(1)  # over the (meaningless) label before the first
        back = steps[::-1].transpose(0, 2, 1)
        tail = _products(back, row[::-1]).sum(1)[::-1]  # includes the line's own step
        after = np.ones((len(row), 2))
        inner = row[1:] == row[:-1]
        after[:-1][inner] = tail[1:][inner]
        single = ahead * after
        single /= single.sum(1, keepdims=True)
        before = np.ones((len(row), 2))
        before[1:][inner] = ahead[:-1][inner]
        double = before[:, :, None] * steps * after[:, None, :]
        return single, double / double.sum(axis=(1, 2), keepdims=True)

    def quality(self, x: np.ndarray, size: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Length-weighted mean of the probability of a good line."""
        good = self.marginals(x, row)[0][:, 1]
        weight = size + 1.0
        return np.bincount(row, good * weight, rows) / np.bincount(row, weight, rows)

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = buffers(column)
        parts = [np.zeros(0)]
        for i, j in slices(offsets):
            found = self.quality(*features(data[offsets[i]:offsets[j]],
                                           offsets[i:j + 1] - offsets[i]), j - i)
            parts.append(sigmoid(self.curve[0] * logit(found) + self.curve[1]))
        return np.concatenate(parts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Adam:
    def __init__(self, *values: np.ndarray) -> None:
        self.values, self.t = values, 0
        self.m, self.v = ([np.zeros_like(x) for x in values] for _ in range(2))

    def step(self, rate: float, *grads: np.ndarray) -> None:
        self.t += 1
        for x, m, v, g in zip(self.values, self.m, self.v, grads, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-8)


def fit(texts: list[str], labels: np.ndarray, prior: float, steps: int = STEPS) -> Field:
    """The most likely weights for the lines of the texts, then the curve for the texts."""
    width = OWN_FEATURES * 3 + 1
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros(width), np.zeros((2, 2)), (0.0, float(logit(np.array(prior)))))
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    parts = [(i, features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
             for i, j in slices(offsets)]
    x, size, row = (np.concatenate(y) for y in zip(
        *[(a, b, r + i) for i, (a, b, r) in parts], strict=True))
    lines = np.bincount(row, minlength=len(texts))
    y = labels[row]
    # Every text counts the same, and both labels do.
    share = np.bincount(labels, minlength=2)
    weight = (0.5 / share[labels] / lines)[row]
    inner = np.append(False, row[1:] == row[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (np.append(0, y[:-1])[inner], y[inner]), weight[inner])
    field = Field(np.zeros(width), np.zeros((2, 2)))
    adam = Adam(field.weights, field.pairs)
    for step in range(steps):
        single, double = field.marginals(x, row)
        slope = x.T @ ((single[:, 1] - y) * weight) + 1e-4 * field.weights
        pairs = (double[inner] * weight[inner, None, None]).sum(0) - seen + 1e-2 * field.pairs
        adam.step(0.1 * (1 - step / steps) + 0.005, slope, pairs)
    z = logit(field.quality(x, size, row, len(texts)))
    own = np.where(labels == 1, prior / share[1], (1 - prior) / share[0])
    curve = np.array([1.0, 0.0])
    adam = Adam(curve)
    for step in range(600):
        error = (sigmoid(curve[0] * z + curve[1]) - labels) * own
        adam.step(0.05 * (1 - step / 600) + 0.001, np.array([error @ z, error.sum()]))
    field.curve = (float(curve[0]), float(curve[1]))
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", learn: Column | None = None,
          most: int = SAMPLE_OF_LABEL, longest: int = LONGEST_SAMPLE) -> Field:
    """A field from the labelled texts that ``learn`` (on label_id) lets through.

    Without texts of both labels all texts get the share of label 1 as their score.
    """
    learn = not_held_out("label_id", 3, 1) if learn is None else learn
    rows, prior = labelled_sample(docs, labels, id_col, text_col, label_col, learn, most, longest)
    return fit([r["text"] for r in rows], np.array([r["label"] for r in rows], np.int64), prior)


def score(docs: DataFrame, field: Field, text_col: str = "text", name: str = "quality_score"
          ) -> DataFrame:
    """The given columns and a score from 0 (bad) to 1.

    Null texts are empty; an empty text is one empty line. An input column of the same
    name is replaced. An empty table gives an empty result.
    """
    return with_scores(docs, text_col, field.scores).select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c != name], F.col("score").alias(name))


def line_marginals(docs: DataFrame, field: Field, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, line (from 0), n_bytes and good (probability) of every line of every text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                x, size, row = features(data[offsets[i]:offsets[j]],
                                        offsets[i:j + 1] - offsets[i])
                first = np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row + i)),
                    pa.array(np.arange(len(row)) - first), pa.array(size.astype(np.int64)),
                    pa.array(field.marginals(x, row)[0][:, 1])],
                    ["doc_id", "line", "n_bytes", "good"])

    return rows.mapInArrow(run, f"doc_id {kind}, line long, n_bytes long, good double")
