"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths measure, for each whole text, which
share of its word characters lies inside n-grams that occur more than once
(every occurrence but the first counts towards coverage, as the first is the
text itself) and inside repeated lines.  A text is kept if it passes the base
rules and no share exceeds its limit.

Defined cases: null and empty texts have no words and fail the base rules;
texts with fewer words than an n-gram have coverage 0; other columns are
ignored; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadloom.functions.frames import pick
from quadloom.llm import bytescan as B

#: Largest share of word characters inside repeated n-grams, by n, and inside repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
#: Symbols counted by the base rules.
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
#: Bytes that begin a code point.
HEADS = (np.arange(256) & 0xC0) != 0x80

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("dup_line_chars", "long")]


def _later(keys: np.ndarray) -> np.ndarray:
    """True where a key equals one further ahead in the array."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in the n-word windows that start at ``at``."""
    edge = np.zeros(total + 1, np.int32)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(buf: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The figures of each row of one chunk."""
    rows = len(offs) - 1
    starts, ends, row = B.words(buf, offs)
    n = len(starts)
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(HEADS[buf], out=heads[1:])
    size = heads[ends] - heads[starts]
    symbols = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SYMBOLS[buf], out=symbols[1:])
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": B.per_row(size, row, rows), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}
    # lines: the rows' own bounds and every newline
    full = np.flatnonzero(offs[1:] > offs[:-1])
    newline = np.flatnonzero(buf == 10)
    begin = np.sort(np.concatenate([offs[:-1][full], newline + 1]))
    stop = np.sort(np.concatenate([offs[1:][full], newline]))
    inside = begin <= stop
    begin, stop = begin[inside], stop[inside]
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[has], stop[has]
    line_row = np.searchsorted(offs, begin, "right") - 1
    again = _later(B.fold(B.span_hash(buf, begin, stop), line_row))
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    chars = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=chars[1:])
    in_line = chars[np.searchsorted(starts, stop)] - chars[np.searchsorted(starts, begin)]
    out["dup_line_chars"] = B.per_row(in_line[again], line_row[again], rows)
    hashes = B.span_hash(buf, starts, ends)
    both = B.windows(hashes, row, 8)
    hit = both[1][B.repeated(B.fold(both[0], row[both[1]]))]
    out["n_repeat_words"] = B.per_row(_covered(hit, 8, n), row, rows)
    # a repeated n-gram begins with a repeated shorter one, so each length looks only where the last found some
    where = None
    for k in sorted(lengths):
        key, at = B.windows(hashes, row, k)
        if where is not None:
            some = where[at]
            key, at = key[some], at[some]
        key = B.fold(key, row[at])
        where = np.zeros(n, bool)
        where[at[B.repeated(key)]] = True
        out[f"dup_{k}gram_chars"] = B.per_row(size * _covered(at[_later(key)], k, n), row, rows)
    return out


def repetition_rules(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """doc_id, the base figures, ``dup_line_chars``, ``dup_{n}gram_chars``, base_failed and kept for each row."""
    limits = dict(NGRAM_LIMITS if ngram_limits is None else ngram_limits)
    lengths = tuple(sorted(limits))
    names = [f for f, _ in FIELDS] + [f"dup_{k}gram_chars" for k in lengths]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, buf, offs in B.chunks(batch.column("text")):
                m = measure(buf, offs, lengths)
                bad = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                over = m["dup_line_chars"] > line_limit * m["word_chars"]
                for k in lengths:
                    over |= m[f"dup_{k}gram_chars"] > limits[k] * m["word_chars"]
                columns = [ids.slice(lo, hi - lo), *[pa.array(m[c].astype(np.int64)) for c in names], pa.array(bad), pa.array(~bad & ~over)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept"])

    return pick(docs, "doc_id", "text").mapInArrow(judge, schema)
