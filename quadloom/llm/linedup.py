"""Line deduplication by pairwise alignment.

1. A line's key is a hash of its trimmed bytes.  A line is rare if 2 to ``rare``
   documents have it: it links each of these with every earlier one.  Such pairs
   have all common blocks with a rare line in them, however short the line.
2. Blocks of frequent lines only are found by runs: the shortest runs of frequent
   lines with ``min_words`` words, from each line on and up to each line, are keyed,
   and each run names the earliest document that holds it (a pre-aggregated minimum:
   a run that a third of all documents share costs one row a task).  Every line of
   such a block is in a run inside the block, and the run's earliest holder has it
   whole.  So no block of any earlier document is lost, and no frequent line or run
   lists its holders: pairs never outnumber ``rare`` a line and two runs a line.
3. Each pair is aligned by patience diff: lines that occur once in both, in their
   longest increasing order, are anchors; between anchors the same again; equal
   lines next to the ends of a gap are matched.
4. Runs of matched lines that follow each other in both documents are common
   blocks; those of ``min_words`` words or more go from the later document.  Blocks
   that the diff cannot match, as they stand twice or in another order, go too:
   the earlier document's runs of ``min_words`` words are looked up one by one.

So a line goes exactly if it is in a run of lines with ``min_words`` words or more
that some earlier document has too.
The earlier document of a pair is the one with the smaller doc_id.

Defined cases: null texts stay null; lines without a word are never compared and
stay; rows with a null doc_id stay unchanged; rows of one doc_id are not compared
with each other, and equal rows get the same result; a document that repeats an
earlier one becomes an empty text; an empty table gives no rows; other columns
are carried, and those named, but for case, like a needed or an added one
(n_lines, removed_lines, removed_words) give way.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions.frames import carry, pick
from quadloom.llm import bytescan as B
from quadloom.plans.scratch import materialize

ADDED = ("n_lines", "removed_lines", "removed_words")
LINES = 1 << 17  # lines whose runs are keyed at a time


def line_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, words and row of each line with a word."""
    starts, ends, _ = B.words(buf, offs)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    newline = np.flatnonzero(buf == 10)
    stop = np.sort(np.concatenate([offs[1:][full], newline]))
    line = np.searchsorted(stop, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)][: len(first)]
    row = np.searchsorted(offs, starts[first], "right") - 1
    return B.span_hash(buf, starts[first], ends[last - 1]), last - first, row


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, keys and words (8 and 4 bytes a line) of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.chunks(batch.column("text")):
                key, words, row = line_keys(buf, offs)
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                ranges = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                words = words.astype("<i4")
                part = batch.slice(lo, hi - lo)
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array([key[i:j].tobytes() for i, j in ranges], pa.binary()), pa.array([words[i:j].tobytes() for i, j in ranges], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "keys", "words"])

    return docs.mapInArrow(scan, "doc_id long, text_hash long, keys binary, words binary")


def line_postings(lines: DataFrame) -> DataFrame:
    """(key, doc_id, text_hash) for the distinct lines of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(k.as_buffer(), np.int64)) for k in batch.column("keys")]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            keys = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("doc_id").take(at), batch.column("text_hash").take(at)], ["key", "doc_id", "text_hash"])

    return lines.mapInArrow(scan, "key long, doc_id long, text_hash long")


def shared_lines(lines: DataFrame) -> DataFrame:
    """(key, doc_id, text_hash, n) of the lines that n > 1 documents have."""
    p = line_postings(lines)
    count = p.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # read back, so that the join shuffles both sides and can split a hot line
    count = materialize(count, "line-counts").hint("merge")
    return materialize(p.join(count, "key"), "shared-lines")


def rare_pairs(shared: DataFrame, rare: int) -> DataFrame:
    """doc_id, text_hash, a_id, a_hash: the pairs of documents with a line that no more than ``rare`` have."""
    holder = F.struct("doc_id", "text_hash")
    # at most ``rare`` in a list
    lists = shared.filter(F.col("n") <= rare).groupBy("key").agg(F.collect_list(holder).alias("all"))
    pairs = lists.select(F.explode("all").alias("later"), "all").select("later", F.explode("all").alias("earlier"))
    pairs = pairs.filter("earlier.doc_id < later.doc_id")
    return pairs.select("later.doc_id", "later.text_hash", F.col("earlier.doc_id").alias("a_id"), F.col("earlier.text_hash").alias("a_hash"))


def run_keys(keys: np.ndarray, words: np.ndarray, edge: np.ndarray, min_words: int, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of the shortest runs of ``min_words`` words or more from each line on and up to each line.

    Row r has the lines from ``edge[r]`` to ``edge[r + 1]``; runs with a line that is not ``usable`` are left out.
    """
    n = len(keys)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    row = np.searchsorted(edge, np.arange(n), "right") - 1
    least = max(min_words, 1)
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    on, up = np.flatnonzero(stop <= edge[row + 1]), np.flatnonzero(start >= edge[row])
    starts, stops, row = np.concatenate([on, start[up]]), np.concatenate([stop[on], up + 1]), np.concatenate([row[on], row[up]])
    if usable is not None:
        barred = np.concatenate([[0], np.cumsum(~usable)])
        whole = np.flatnonzero(barred[stops] == barred[starts])
        starts, stops, row = starts[whole], stops[whole], row[whole]
    powers, inverse = B.powers(n + 1)
    rolling = np.zeros(n + 1, B.U64)
    np.cumsum(B.mix64(keys) * powers[:n], out=rolling[1:])
    found = B.mix64((rolling[stops] - rolling[starts]) * inverse[starts] + (stops - starts).astype(B.U64))
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return found[new], row[new]


def run_postings(lines: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id, text_hash) for the distinct shortest runs of ``min_words`` words or more; ``frequent``: keys of the lines they may have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, words, usable = (batch.column(c).to_pylist() for c in ("keys", "words", "frequent"))
            edge = np.concatenate([[0], np.cumsum([len(k) // 8 for k in raw], dtype=np.int64)])
            lo = 0
            while lo < len(raw):
                # rows of a bounded number of lines; a longer document is a part of its own
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + LINES, "right")) - 1)
                keys = np.frombuffer(b"".join(raw[lo:hi]), B.U64)
                ok = [np.isin(np.frombuffer(k, np.int64), np.array(f, np.int64)) for k, f in zip(raw[lo:hi], usable[lo:hi], strict=True)]
                found, row = run_keys(keys, np.frombuffer(b"".join(words[lo:hi]), "<i4"), edge[lo : hi + 1] - edge[lo], min_words, np.concatenate(ok))
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column("doc_id").take(at), batch.column("text_hash").take(at)], ["key", "doc_id", "text_hash"])
                lo = hi

    return lines.mapInArrow(scan, "key long, doc_id long, text_hash long")


def run_pairs(lines: DataFrame, shared: DataFrame, rare: int, min_words: int) -> DataFrame:
    """doc_id, text_hash, a_id, a_hash: each document with the earliest holders of its runs of frequent lines."""
    # no more keys than the document has lines
    frequent = shared.filter(F.col("n") > rare).groupBy("doc_id", "text_hash").agg(F.collect_list("key").alias("frequent"))
    p = run_postings(lines.join(frequent, ["doc_id", "text_hash"]), min_words)
    holders = p.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("doc_id").alias("_last"))
    holders = holders.filter("first.doc_id < _last").select("key", F.col("first.doc_id").alias("a_id"), F.col("first.text_hash").alias("a_hash"))
    # read back, so that the join shuffles both sides and can split a hot run
    holders = materialize(holders, "holders").hint("merge")
    return p.join(holders, "key").filter("a_id < doc_id").select("doc_id", "text_hash", "a_id", "a_hash")


def _rising(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence of distinct values."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
        before[i] = top_at[pile - 1] if pile else -1
    out = []
    i = top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (in ``a``, in ``b``), rising in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, m, j, n = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        here, there = Counter(a[i:m]), Counter(b[j:n])
        once = {x: p for p, x in enumerate(a[i:m], i) if here[x] == 1 and there.get(x) == 1}
        common = [(p, once[x]) for p, x in enumerate(b[j:n], j) if x in once]
        anchors = [common[k] for k in _rising([p for _, p in common])]
        if not anchors:
            continue
        for q, p in anchors:
            gaps.append((i, p, j, q))
            found.append((p, q))
            i, j = p + 1, q + 1
        gaps.append((i, m, j, n))
    return sorted(found)


def _shortest(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """Start and end of the shortest runs of ``min_words`` words or more from each line on and up to each line.

    They cover every line of every run of ``min_words`` words or more without leaving it.
    """
    least = max(min_words, 1)
    total = [0, *accumulate(words)]
    out = set()
    for i in range(len(words)):
        end = bisect_left(total, total[i] + least)
        if end < len(total):
            out.add((i, end))
        start = bisect_right(total, total[i + 1] - least) - 1
        if start >= 0:
            out.add((start, i + 1))
    return out


def common_lines(a: list, b: list, words: list[int], min_words: int) -> list[int]:
    """Positions in ``b`` of the lines in common blocks of ``min_words`` words or more.

    What the diff leaves unmatched (passages that stand twice, or in another order)
    is looked up by its shortest runs, so no common block remains.
    """
    out: set[int] = set()
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= min_words:
                out.update(run)
            run = []
        run.append(j)
        last = (i, j)
    there = set(a)
    if any(x in there for j, x in enumerate(b) if j not in out):
        size = dict(zip(b, words, strict=True))
        # a line that only ``a`` has ends a run, whatever its size
        held = {tuple(a[i:j]) for i, j in _shortest([size.get(x, min_words) or 1 for x in a], min_words)}
        for i, j in _shortest(words, min_words):
            if tuple(b[i:j]) in held:
                out.update(range(i, j))
    return sorted(out)


def overlaps(lines: DataFrame, min_words: int, rare: int) -> DataFrame:
    """doc_id, text_hash and ``hits``: for each partner the positions of lines to remove (4 bytes each)."""
    known = lines.filter("doc_id is not null")
    shared = shared_lines(known)
    pairs = rare_pairs(shared, rare).unionAll(run_pairs(known, shared, rare, min_words)).distinct()
    pairs = materialize(pairs, "pairs").join(lines, ["doc_id", "text_hash"])
    earlier = lines.select(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash"), F.col("keys").alias("a_keys"))
    pairs = pairs.join(earlier, ["a_id", "a_hash"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hits = [], []
            for n, (a, b, w) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("a_keys", "keys", "words")], strict=True)):
                found = common_lines(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist(), np.frombuffer(w, "<i4").tolist(), min_words)
                if found:
                    at.append(n)
                    hits.append(np.array(found, "<i4").tobytes())
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(hits, pa.binary())], ["doc_id", "text_hash", "hits"])

    found = pairs.select("doc_id", "text_hash", "a_keys", "keys", "words").mapInArrow(scan, "doc_id long, text_hash long, hits binary")
    # a document has no more than ``rare`` partners and two runs a line
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list("hits").alias("hits"))


def drop_common_blocks(docs: DataFrame, min_words: int = 25, rare: int = 8) -> DataFrame:
    """``docs`` without the lines that repeat blocks of earlier documents, plus n_lines, removed_lines, removed_words.

    ``rare`` says which of two exact ways finds a block; the result is the same for any.
    """
    if min_words < 1 or rare < 1:
        raise ValueError("min_words and rare are 1 or more")
    docs = carry(docs, ("doc_id", "text"), (*ADDED, "_hash", "_hit_id", "_hit_hash", "_hits"))
    d = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    lines = materialize(line_table(d), "lines").dropDuplicates(["doc_id", "text_hash"])
    lines = materialize(lines, "documents-lines")
    hits = materialize(overlaps(lines, min_words, rare), "overlaps")
    names, at = docs.columns, docs.columns.index("text")
    hits = hits.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), F.col("hits").alias("_hits"))
    # the texts are shuffled by their documents at every size, and sorted, so that memory can spill
    joined = docs.withColumn("_hash", F.xxhash64("text")).join(hits.hint("merge"), (F.col("doc_id") == F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_hash")), "left")
    joined = joined.drop("_hit_id", "_hit_hash", "_hash")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in ADDED]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            n = len(texts)
            n_lines, gone, gone_words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lo, hi, buf, offs in B.chunks(texts):
                n_lines[lo:hi] = np.bincount(line_keys(buf, offs)[2], minlength=hi - lo)
            hits = batch.column("_hits")
            change = np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if change:
                out = texts.to_pylist()
                for i in change:
                    remove = set(np.frombuffer(b"".join(hits[i].as_py()), "<i4").tolist())
                    kept, k = [], 0
                    for line in out[i].split("\n"):
                        words = len(line.encode().split())
                        if words and k in remove:
                            gone[i] += 1
                            gone_words[i] += words
                        else:
                            kept.append(line)
                        k += words > 0
                    out[i] = "\n".join(kept)
                texts = pa.array(out, texts.type)
            columns = batch.columns[: len(names)]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(gone), pa.array(gone_words)], [*names, *ADDED])

    return joined.mapInArrow(cut, schema)
