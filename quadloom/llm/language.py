"""Language of whole texts, and of the spans of mixed ones.

Words are runs of letters.  The script of a word, by code point ranges, leaves
the languages that were seen in that script; each of these scores the word by
log-probabilities of its letters in context (the letter with its neighbours or
the word's edge).  Viterbi then labels all words of a text at the least total
cost, where a change of language between neighbours costs ``penalty``.  The
text's language is the one with most letters; its score is that share.

Defined cases: null texts and texts without letters are ``und`` with score 0; a
script that no language was seen in leaves all of them; with nothing to learn
from every text is ``und``; ties go to the language first in code point order;
a doc_id with several languages or texts teaches each row's text under its own;
other columns are ignored; repeated rows are labelled each.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.frames import pick
from quadloom.llm import bytescan as B
from quadloom.llm.samples import SEED, fold

# First and last code point of the main blocks of scripts, by the Unicode standard.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
]
NAMES = list(dict.fromkeys(n for n, _, _ in SCRIPTS))
BUCKETS = 1 << 16
#: Bytes of text that advance through Viterbi together, and that are scored at once.
TOGETHER, AT_ONCE = 8 << 20, 1 << 20
#: No word speaks against a language more strongly than this.
MOST = 12.0


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script's number (last: another)."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    low = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter[:0x20000]).tolist():
        c = chr(i).lower()
        if len(c) == 1:
            low[i] = ord(c)
    script = np.full(0x110000, len(NAMES), np.int8)
    for name, lo, hi in SCRIPTS:
        script[lo : hi + 1] = NAMES.index(name)
    return letter, low, script


@dataclasses.dataclass
class Words:
    """Words of a run of rows: row, start and end in code points of the row, script, and letters in context."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    bucket: np.ndarray
    first: np.ndarray


def scan_words(buf: np.ndarray, offs: np.ndarray) -> Words:
    letter, low, script = _tables()
    heads = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=heads[1:])
    at = heads[offs]
    cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    edge = np.zeros(len(cps) + 1, bool)
    edge[at] = True
    is_letter = letter[cps]
    begins = is_letter.copy()
    begins[1:] &= ~is_letter[:-1] | edge[1:-1]
    ends = is_letter.copy()
    ends[:-1] &= ~is_letter[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(at, starts, "right") - 1
    x = low[cps].astype(np.uint64) + np.uint64(1)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[begins] = 0
    after[ends] = 0
    spot = np.flatnonzero(is_letter)
    key = B.mix64(before[spot] | (x[spot] << np.uint64(21)) | (after[spot] << np.uint64(42)))
    bucket = (key & np.uint64(BUCKETS - 1)).astype(np.int64)
    return Words(row, starts - at[row], stops - at[row], script[cps[starts]], bucket, np.searchsorted(spot, starts))


@dataclasses.dataclass
class Model:
    """Languages, log-probabilities (buckets x languages), and the languages seen in each script."""

    langs: list[str]
    logp: np.ndarray
    seen: np.ndarray
    penalty: float = 6.0

    def word_scores(self, words: Words) -> np.ndarray:
        """Words x languages, best 0."""
        if not len(words.row):
            return np.zeros((0, len(self.langs)), np.float32)
        total = np.add.reduceat(self.logp[words.bucket], words.first, axis=0)
        total = np.where(self.seen[words.script], total, -np.inf)
        return np.maximum(total - total.max(1, keepdims=True), -MOST).astype(np.float32)


def viterbi(scores: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; all texts advance together, a word at a time."""
    n, states = scores.shape
    kind = np.int8 if states <= 127 else np.int32
    path = np.zeros(n, kind)
    if not n:
        return path
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[starts, n])
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    back = np.zeros((n, states), kind)
    own = np.arange(states, dtype=kind)
    best = scores[starts].copy()
    for t in range(1, length[0]):
        k = active[t]
        now = best[:k]
        top = now.argmax(1)
        least = now[np.arange(k), top] - penalty
        stay = now >= least[:, None]
        at = starts[:k] + t
        back[at] = np.where(stay, own, top[:, None])
        best[:k] = np.maximum(now, least[:, None]) + scores[at]
    state = best.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        path[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return path


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, max_docs: int = 8000, penalty: float = 6.0, least_share: float = 0.001, per_lang: int = 500) -> Model:
    """Learn from ``max_docs`` documents with a language, and ``per_lang`` of each language if those have fewer, outside fold ``held_out``.

    Each language's counts are normalized on their own, so the sizes of the samples need no weights.

    A language counts as seen in a script that holds ``least_share`` of its letters.
    """
    d = pick(docs, "doc_id", "lang", "text")
    ids = d.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    ids = ids.select("doc_id", "lang", F.xxhash64(F.lit(SEED), "doc_id").alias("_at"))
    # by its hash a document is among the first few of all or of its language or not, so that few rows are ranked;
    # a language's first is always there, also where rows repeat doc_ids
    size = ids.groupBy("lang").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    size = size.withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    share = F.col("_at") / F.lit(2.0**64) + 0.5
    ids = ids.join(F.broadcast(size), "lang")
    first = ids.filter((share * F.col("_n") < 2 * per_lang + 100) | (F.col("_at") == F.col("_first")))
    first = first.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_at", "doc_id"))).filter(F.col("_rank") <= per_lang)
    ids = ids.filter(share * F.col("_all") < 2 * max_docs + 100).orderBy("_at", "doc_id").limit(max_docs)
    ids = ids.select("doc_id", "lang").unionAll(first.select("doc_id", "lang")).distinct()
    # at most max_docs short rows, and per_lang of each language
    sample = d.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, buf, offs in B.chunks(batch.column("text"), AT_ONCE):
                w = scan_words(buf, offs)
                letters = w.end - w.start
                name, of = np.unique(lang[lo:hi], return_inverse=True)
                of = of[w.row]
                key = np.concatenate([np.repeat(of, letters) * (2 * BUCKETS) + w.bucket, np.repeat(of * (2 * BUCKETS) + BUCKETS + w.script, letters)])
                key, times = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name[key // (2 * BUCKETS)], pa.string()), pa.array(key % (2 * BUCKETS)), pa.array(times)], ["lang", "bucket", "n"])

    # at most BUCKETS rows and a few more for each language
    table = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(table["lang"].to_pylist(), object)
    langs = sorted(set(lang))
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    at = np.array([langs.index(x) for x in lang], np.int64)
    counts = np.zeros((BUCKETS, len(langs)))
    seen = np.zeros((len(NAMES) + 1, len(langs)))
    ngram = bucket < BUCKETS
    counts[bucket[ngram], at[ngram]] = n[ngram]
    seen[bucket[~ngram] - BUCKETS, at[~ngram]] = n[~ngram]
    seen = seen >= least_share * np.maximum(seen.sum(0), 1)
    seen[~seen.any(1)] = True
    total = counts.sum(0) if langs else np.zeros(0)
    distinct = max(1, int((counts.sum(1) > 0).sum()))
    logp = np.log((counts + 0.1) / (total + 0.1 * distinct + 1e-9)).astype(np.float32)
    return Model(langs, logp, seen, penalty)


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ``spans``: (start, end, lang) in code points, end exclusive."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    langs = pa.array(model.langs or ["und"], pa.string())

    def label(texts: pa.Array) -> list[pa.Array]:
        rows = len(texts)
        parts = [(lo, scan_words(buf, offs)) for lo, _, buf, offs in B.chunks(texts, AT_ONCE)] if model.langs else []
        scores = [model.word_scores(w) for _, w in parts]
        if not sum(map(len, scores)):
            return [pa.array(["und"] * rows, pa.string()), pa.array(np.zeros(rows)), pa.array([[]] * rows, kind)]
        row = np.concatenate([w.row + lo for lo, w in parts])
        start, end = (np.concatenate([getattr(w, f) for _, w in parts]) for f in ("start", "end"))
        path = viterbi(np.concatenate(scores), row, model.penalty).astype(np.int64)
        k = len(model.langs)
        letters = np.bincount(row * k + path, end - start, rows * k).reshape(rows, k)
        whole = letters.sum(1)
        best = letters.argmax(1)
        none = whole == 0
        pred = langs.take(pa.array(best, mask=none)).fill_null("und")
        new = np.r_[True, (row[1:] != row[:-1]) | (path[1:] != path[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(row)] - 1
        items = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(end[last]), langs.take(pa.array(path[first]))], ["start", "end", "lang"])
        edge = np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32)
        return [pred, pa.array(letters.max(1) / np.maximum(whole, 1)), pa.ListArray.from_arrays(pa.array(edge), items).cast(kind)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in B.chunks(batch.column("text"), TOGETHER):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *label(part.column("text"))], ["doc_id", "lang_pred", "score", "spans"])

    return pick(docs, "doc_id", "text").mapInArrow(scan, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")
