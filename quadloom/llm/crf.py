"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad.  Its features are figures of the line and
of its two neighbours.  Only documents are labelled, so training has two steps on
a bounded sample: a logistic model of lines that take their document's label,
whose verdicts then mark the lines of bad documents (good documents have good
lines only); and the field itself, by gradient ascent on the log-likelihood of
those line labels.  Forward-backward gives each line's probability; a document's
quality is their mean, weighted by line length and calibrated on the sample.

Defined cases: a null or blank text has no lines and gets the calibrated score
of a document whose lines are all bad; a sample without both labels gives score
1 (0) to every text; other columns are ignored or carried; repeated rows are
scored each.  Training documents with more than ``max_lines`` lines, and those
beyond ``max_total_lines`` in all, are left out of the sample (they are scored
like all others).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadloom.functions.frames import carry, pick
from quadloom.llm import bytescan as B
from quadloom.llm.samples import labelled_sample, within
from quadloom.plans.scratch import materialize

#: Classes of bytes that are counted in each line.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~=+_\\/{}[]",
    "bar": b"|",
    "bang": b"!?",
    "stop": b".,;:",
    "other": b"'\"()-`",
}
OWN = len(CLASSES) + 9


def lines_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x OWN), row, length and start byte of each line with a word."""
    starts, ends, _ = B.words(buf, offs)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    newline = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offs[:-1][full], newline + 1]))
    stop = np.sort(np.concatenate([offs[1:][full], newline]))
    ok = begin <= stop
    begin, stop = begin[ok], stop[ok]
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    ok = last > first
    begin, stop, first, last = begin[ok], stop[ok], first[ok], last[ok]
    row = np.searchsorted(offs, begin, "right") - 1
    n_words = (last - first).astype(float)
    size = (ends - starts).astype(float)
    total = np.concatenate([[0], np.cumsum(size)])
    chars = total[last] - total[first]
    columns = []
    for members in CLASSES.values():
        table = np.zeros(256, np.int32)
        table[list(members)] = 1
        count = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(table[buf], out=count[1:])
        columns.append((count[stop] - count[begin]) / chars)
    letters = columns[0] + columns[1]
    key = B.span_hash(B.LOWER[buf], starts, ends)
    again = np.zeros(len(starts))
    again[1:] = key[1:] == key[:-1]
    repeats = np.concatenate([[0], np.cumsum(again)])
    # words that the line has seen before
    line_of = np.repeat(np.arange(len(first)), last - first)
    mine = B.fold(key, line_of)  # every word is in one of these lines, in order
    order = np.argsort(mine, kind="stable")
    seen = np.zeros(len(mine))
    seen[order[1:]] = mine[order[1:]] == mine[order[:-1]]
    dup_words = np.bincount(line_of, seen, len(first)) / np.maximum(n_words, 1)
    same_line = B.repeated(B.fold(B.span_hash(buf, begin, stop), row)).astype(float) if len(begin) else np.zeros(0)
    columns += [
        np.log1p(n_words),
        np.log1p(chars / n_words),
        (repeats[last] - repeats[np.minimum(first + 1, last)]) / n_words,
        dup_words,
        same_line,
        (columns[0] > 0.5 * np.maximum(letters, 1e-9)).astype(float),
        (n_words < 3).astype(float),
        (columns[4] > 0).astype(float),
        np.minimum(columns[3] * 10, 1),
    ]
    return np.stack(columns, 1) if len(begin) else np.zeros((0, OWN)), row, np.maximum(chars, 1), begin


def with_neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Bias, own, previous and next line's features; zeros beyond a document's ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        same = (row[1:] == row[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.concatenate([np.ones((len(own), 1)), own, before, after], 1)


def _chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each document's lines, longest first."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    length = np.diff(np.r_[starts, len(row)])
    order = np.argsort(-length, kind="stable")
    return starts[order], length[order]


def forward_backward(emit: np.ndarray, move: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of state 1 at each line, summed pair probabilities (2 x 2), log-partition.

    ``emit`` is each line's score for state 1 over state 0; all documents advance
    together, one line at a time.
    """
    starts, length = _chains(row)
    n = len(emit)
    score = np.zeros((n, 2))
    score[:, 1] = emit
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    deep = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, deep + 1), "right")
    for t in range(deep):
        at = starts[: active[t]] + t
        if t == 0:
            a[at] = score[at]
        else:
            prev = a[at - 1]
            a[at, 0] = np.logaddexp(prev[:, 0] + move[0, 0], prev[:, 1] + move[1, 0])
            a[at, 1] = np.logaddexp(prev[:, 0] + move[0, 1], prev[:, 1] + move[1, 1]) + score[at, 1]
    for t in range(deep - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        ahead = b[at + 1] + score[at + 1]
        b[at, 0] = np.logaddexp(ahead[:, 0] + move[0, 0], ahead[:, 1] + move[0, 1])
        b[at, 1] = np.logaddexp(ahead[:, 0] + move[1, 0], ahead[:, 1] + move[1, 1])
    z = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    p = np.exp(a[:, 1] + b[:, 1] - z)
    inner = np.flatnonzero(row[1:] == row[:-1]) if n > 1 else np.zeros(0, np.int64)
    pair = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pair[i, j] = np.exp(a[inner, i] + move[i, j] + score[inner + 1, j] + b[inner + 1, j] - z[inner]).sum()
    return p, pair, float(z[starts].sum())


def ascend(grad, x: np.ndarray, steps: int) -> np.ndarray:
    """Resilient gradient ascent: each parameter's step follows the sign of its slope."""
    size, last = np.full_like(x, 0.05), np.zeros_like(x)
    for _ in range(steps):
        g = grad(x)
        turn = g * last
        size = np.clip(np.where(turn > 0, size * 1.2, np.where(turn < 0, size * 0.5, size)), 1e-6, 1.0)
        g = np.where(turn < 0, 0, g)
        x = x + np.sign(g) * size
        last = g
    return x


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclasses.dataclass
class Model:
    """Weights of the features (after scaling), moves between states, and the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    calibration: tuple[float, float]
    constant: float | None = None

    def line_marginals(self, own: np.ndarray, row: np.ndarray) -> np.ndarray:
        x = with_neighbours((own - self.mean) / self.scale, row)
        return forward_backward(x @ self.weights, self.move, row)[0]

    def score(self, p: np.ndarray, row: np.ndarray, length: np.ndarray, rows: int) -> np.ndarray:
        """Documents' quality from their lines' probability to be bad."""
        if self.constant is not None:
            return np.full(rows, self.constant)
        bad = np.bincount(row, p * length, rows) / np.maximum(np.bincount(row, length, rows), 1e-9)
        bad[np.bincount(row, minlength=rows) == 0] = 1.0
        return sigmoid(self.calibration[0] + self.calibration[1] * bad)


def _features(texts: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, buf, offs in B.chunks(texts):
        own, row, length, _ = lines_of(buf, offs)
        yield lo, hi, own, row, length


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, per_class: int = 2000, max_lines: int = 2000, max_total_lines: int = 400_000, steps: int = 60, l2: float = 1e-3) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, outside fold ``held_out``, that have ``max_total_lines`` lines together.

    A line takes some 600 bytes on the driver.
    """
    sample = labelled_sample(docs, labels, label, folds, held_out, per_class)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, own, row, length in _features(batch.column("text")):
                count = np.bincount(row, minlength=hi - lo)
                edge = np.concatenate([[0], np.cumsum(count)])
                part = batch.slice(lo, hi - lo)
                short = np.flatnonzero(count <= max_lines)
                cells = [np.concatenate([own[edge[i] : edge[i + 1]], length[edge[i] : edge[i + 1], None]], 1).astype("<f4").tobytes() for i in short]
                at = pa.array(short)
                columns = [*[part.column(c).take(at) for c in ("at", "label", "weight")], pa.array(count[short].astype(np.int64)), pa.array(cells, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["at", "label", "weight", "size", "lines"])

    # at most 2 * per_class documents, max_total_lines lines of (OWN + 1) * 4 bytes
    rows = materialize(sample.mapInArrow(measured, "at long, label int, weight double, size long, lines binary"), "quality-lines")
    rows = within(rows, max_total_lines).toArrow()
    # a defined order, whatever order the tasks ended in
    rows = sorted(zip(rows["label"].to_pylist(), rows["weight"].to_pylist(), rows["lines"].to_pylist(), strict=True))
    classes = {r[0] for r in rows}
    if classes != {0, 1}:
        return Model(np.zeros(OWN), np.ones(OWN), np.zeros(1 + 3 * OWN), np.zeros((2, 2)), (0, 0), float(0 not in classes))
    bad = np.array([1 - r[0] for r in rows])
    weight = np.array([r[1] for r in rows])
    cells = [np.frombuffer(r[2], "<f4").reshape(-1, OWN + 1) for r in rows]
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    table = np.concatenate(cells).astype(float)
    own, length = table[:, :-1], table[:, -1]
    mean, scale = own.mean(0), own.std(0) + 1e-3
    x = with_neighbours((own - mean) / scale, row)
    y = bad[row].astype(float)
    # each document counts once, whatever its number of lines
    share = (1 / np.bincount(row, minlength=len(bad)).clip(1))[row]
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 0
    simple = ascend(lambda w: x.T @ ((y - sigmoid(x @ w)) * share) / len(bad) - ridge * w, np.zeros(x.shape[1]), steps)
    verdict = sigmoid(x @ simple)
    worst = np.zeros(len(bad))
    np.maximum.at(worst, row, verdict)
    y = ((bad[row] == 1) & ((verdict > 0.5) | (verdict >= worst[row]))).astype(float)
    inner = np.flatnonzero(row[1:] == row[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1)

    def slope(params: np.ndarray) -> np.ndarray:
        w, move = params[:-4], params[-4:].reshape(2, 2)
        p, pair, _ = forward_backward(x @ w, move, row)
        return np.r_[x.T @ (y - p) / len(y) - ridge * w, (seen - pair).ravel() / len(y) - l2 * move.ravel()]

    params = ascend(slope, np.r_[simple, np.zeros(4)], steps)
    model = Model(mean, scale, params[:-4], params[-4:].reshape(2, 2), (0.0, 0.0))
    p = model.line_marginals(own, row)
    share_bad = np.bincount(row, p * length, len(bad)) / np.maximum(np.bincount(row, length, len(bad)), 1e-9)
    share_bad[np.bincount(row, minlength=len(bad)) == 0] = 1.0
    z = np.stack([np.ones(len(bad)), share_bad], 1)
    good = 1 - bad
    fit = ascend(lambda c: z.T @ (weight * (good - sigmoid(z @ c))) / weight.sum() - np.array([0, 1e-3]) * c, np.zeros(2), 300)
    model.calibration = (float(fit[0]), float(fit[1]))
    return model


def score_quality(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` plus the quality in column ``into``; columns that clash, but for case, give way."""
    kept = carry(docs, (text,), (into,))
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(model.line_marginals(own, row), row, length, hi - lo) for lo, hi, own, row, length in _features(batch.column(text))]
            if parts:
                score = pa.array(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, into])

    return kept.mapInArrow(scan, schema)


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (from 0, among lines with a word), start (byte), p_bad, bad for every line."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.chunks(batch.column("text")):
                own, row, _, begin = lines_of(buf, offs)
                p = model.line_marginals(own, row)
                first = np.searchsorted(row, row)
                columns = [batch.column("doc_id").slice(lo, hi - lo).take(pa.array(row)), pa.array(np.arange(len(row)) - first), pa.array(begin - offs[row]), pa.array(p), pa.array(p >= 0.5)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "start", "p_bad", "bad"])

    return pick(docs, "doc_id", "text").mapInArrow(scan, "doc_id long, line long, start long, p_bad double, bad boolean")
