"""Toxicity by multiple-instance learning with noisy-or.

A document is toxic if any of its sentences is.  A sentence's probability is
logistic in the weights of its words; the document's is one minus the product of
its sentences' complements.  Weights are trained from document labels alone, by
gradient ascent on the likelihood of a bounded sample, and then name the
sentences at fault.

Words are runs of ASCII letters, digits and bytes beyond ASCII, lower-cased in
A-Z; a word's signs are itself and its first 4, 5 and 6 characters, so that one
stem stands for its inflected forms.  Sentences end at ``. ! ?`` and line ends.
Only signs that are found far more often in toxic documents than in others, by
documents or by their sentences, get a weight: what is not a sign must not make a
long or repetitive text suspicious.

Defined cases: null, blank or wordless texts have no sentence and score 0; a
sample without both labels gives score 1 (0) to every text with a word; unknown
signs weigh nothing; other columns are ignored; repeated rows are scored each.
Training documents of more than ``max_words`` words, and those beyond ``max_hits``
signs in all, are left out of the sample (they are scored like all others).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.frames import pick
from quadloom.llm import bytescan as B
from quadloom.llm.crf import ascend, sigmoid
from quadloom.llm.samples import labelled_sample, within
from quadloom.plans.scratch import materialize

GAP = np.ones(256, bool)
GAP[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = False
GAP[128:] = False
END = np.zeros(256, np.int64)
END[list(b".!?\n\r")] = 1


#: Lengths, in code points, of the beginnings that count as signs.
PREFIXES = (4, 5, 6)
HEADS = (np.arange(256) & 0xC0) != 0x80


def sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of signs and the sentence of each; of each sentence the row, first and past-the-last byte."""
    starts, ends, row = B.words(buf, offs, GAP)
    ended = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(END[buf], out=ended[1:])
    place = ended[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)][: len(first)] - 1
    low = B.LOWER[buf]
    signs, owners = [B.span_hash(low, starts, ends)], [sentence]
    head = np.r_[np.flatnonzero(HEADS[buf]), len(buf)]
    at = np.searchsorted(head, starts)
    for k in PREFIXES:
        stop = head[np.minimum(at + k, len(head) - 1)]
        long_ = np.flatnonzero((stop <= ends) & (at + k < len(head)))
        signs.append(B.span_hash(low, starts[long_], stop[long_]) ^ np.uint64(k))
        owners.append(sentence[long_])
    return np.concatenate(signs), np.concatenate(owners), row[first], starts[first], ends[last]


@dataclasses.dataclass
class Model:
    """Sorted hashes of signs, their weights, and the bias of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def sentence_scores(self, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        total = np.full(n, self.bias)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = np.flatnonzero(self.words[at] == hashes)
            total += np.bincount(sentence[known], self.weights[at[known]], n)
        return sigmoid(total) if self.constant is None else np.full(n, self.constant)


def noisy_or(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), rows))


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, per_class: int = 3000, max_words: int = 20000, max_hits: int = 8_000_000,
    least_docs: int = 3, least_z: float = 4.0, sentence_z: float = 5.5, support_z: float = 2.0, lift: float = 4.0, steps: int = 150, l2: float = 3e-3,
) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, outside fold ``held_out``.

    A sign gets a weight if it is in ``least_docs`` documents of the sample and its share
    among toxic ones exceeds that among others by ``least_z`` standard errors (of equal shares).
    A sign of two toxic documents may still stand out in them: ``support_z`` errors are
    enough if its share of their sentences exceeds that of others by ``sentence_z`` errors
    and is at least ``lift`` times as large.
    ``l2`` is the weights' penalty beside the likelihood of the whole sample.
    """
    sample = materialize(labelled_sample(docs, labels, label, folds, held_out, per_class), "toxic-sample")

    def short(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Signs, their sentences and rows, without rows of too many words; and how many sentences each row has."""
        signs, sentence, owner, _, _ = sentences(buf, offs)
        row = owner[sentence]
        rows = len(offs) - 1
        fits = np.bincount(B.words(buf, offs, GAP)[2], minlength=rows) <= max_words
        count = np.where(fits, np.bincount(owner, minlength=rows), 0)
        first = np.searchsorted(owner, np.arange(rows))
        keep = np.flatnonzero(fits[row])
        return signs[keep], (sentence - first[row])[keep], row[keep], count

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labelled = batch.column("label").to_numpy()
            for lo, _, buf, offs in B.chunks(batch.column("text")):
                signs, sentence, row, count = short(buf, offs)
                order = np.lexsort([sentence, signs, row])
                signs, sentence, row = signs[order], sentence[order], row[order]
                new = np.ones(len(signs), bool)
                new[1:] = (signs[1:] != signs[:-1]) | (row[1:] != row[:-1])
                held = new.copy()
                held[1:] |= sentence[1:] != sentence[:-1]
                first = np.flatnonzero(new)
                times = np.add.reduceat(held.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                full = np.flatnonzero(count)  # each document itself, as the null sign
                sign = pa.concat_arrays([pa.array(signs[new].view(np.int64)), pa.nulls(len(full), pa.int64())])
                label_of = labelled[lo + np.r_[row[new], full]].astype(np.int64)
                times = np.r_[times, count[full]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([sign, pa.array(label_of), pa.array(times), pa.array(times * label_of)], ["sign", "label", "sentences", "toxic_sentences"])

    counts = sample.mapInArrow(listed, "sign long, label long, sentences long, toxic_sentences long").groupBy("sign")
    counts = counts.agg(F.sum("label").alias("toxic"), F.count("*").alias("n"), F.sum("sentences").alias("sentences"), F.sum("toxic_sentences").alias("toxic_sentences"))
    counts = materialize(counts, "signs")
    whole = counts.filter("sign is null").first()
    n_toxic, n_clean = (whole.toxic, whole.n - whole.toxic) if whole else (0, 0)
    none = np.zeros(0, np.uint64)
    if not (n_toxic and n_clean):
        return Model(none, np.zeros(0), -40.0, float(bool(n_toxic)))

    def errors(hits: Column, toxic_hits: Column, size: int, toxic_size: int) -> Column:
        """By how many standard errors of equal shares the share of toxic units with the sign exceeds that of others."""
        pooled = hits / size
        error = F.sqrt(pooled * (1 - pooled) * (1 / toxic_size + 1 / (size - toxic_size)))
        return F.try_divide(toxic_hits / toxic_size - (hits - toxic_hits) / (size - toxic_size), error)

    by_docs = errors(F.col("n"), F.col("toxic"), whole.n, n_toxic)
    by_sentences = errors(F.col("sentences"), F.col("toxic_sentences"), whole.sentences, whole.toxic_sentences)
    often = (F.col("n") >= least_docs) & (by_docs > least_z)
    rates = F.col("toxic_sentences") / whole.toxic_sentences, (F.col("sentences") - F.col("toxic_sentences")) / (whole.sentences - whole.toxic_sentences)
    stands_out = often | ((F.col("toxic") >= 2) & (by_docs > support_z) & (by_sentences > sentence_z) & (rates[0] >= lift * rates[1]))
    # of the sample's signs only those that are found in several toxic documents of at most per_class
    found = counts.filter(F.col("sign").isNotNull() & stands_out).select("sign").toArrow()
    word = np.sort(found["sign"].to_numpy().view(np.uint64))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.chunks(batch.column("text")):
                signs, sentence, row, count = short(buf, offs)
                at = np.minimum(np.searchsorted(word, signs), max(0, len(word) - 1))
                hit = np.flatnonzero(word[at] == signs) if len(word) else np.zeros(0, np.int64)
                hit = hit[np.lexsort([at[hit], sentence[hit], row[hit]])]
                pairs = np.stack([at[hit], sentence[hit]], 1).astype("<i4")
                edge = np.searchsorted(row[hit], np.arange(hi - lo + 1))
                cells = [pairs[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
                full = pa.array(np.flatnonzero(count))
                part = batch.slice(lo, hi - lo)
                size = pa.array(np.diff(edge) + count)
                columns = [part.column("at"), part.column("label"), part.column("weight"), pa.array(count), size, pa.array(cells, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.take(full) for c in columns], ["at", "label", "weight", "count", "size", "hits"])

    # at most 2 * per_class documents, of each the occurrences of the chosen signs, max_hits and as many sentences in all
    rows = materialize(sample.mapInArrow(measured, "at long, label int, weight double, count long, size long, hits binary"), "toxic-hits")
    rows = within(rows, max_hits).toArrow()
    # a defined order, whatever order the tasks ended in
    rows = sorted(zip(*[rows[c].to_pylist() for c in ("label", "weight", "count", "hits")], strict=True))
    y = np.array([r[0] for r in rows], float)
    if len(set(y)) < 2:
        return Model(none, np.zeros(0), -40.0, float(bool(y.sum())))
    weight = np.array([r[1] for r in rows])
    weight /= weight.sum()
    count = np.array([r[2] for r in rows])
    pairs = [np.frombuffer(r[3], "<i4").reshape(-1, 2).astype(np.int64) for r in rows]
    at = np.concatenate([x[:, 0] for x in pairs])
    sentence = np.concatenate([x[:, 1] + o for x, o in zip(pairs, np.cumsum(count) - count, strict=True)])
    owner = np.repeat(np.arange(len(rows)), count)
    m, n = len(word), int(count.sum())

    def slope(x: np.ndarray) -> np.ndarray:
        p = sigmoid(x[0] + np.bincount(sentence, x[1:][at], n))
        doc = np.clip(noisy_or(p, owner, len(rows)), 1e-9, 1 - 1e-9)
        # d log-likelihood / d sentence score: (y / doc - 1) * p for a noisy-or of logistic parts
        g = (weight * (y / doc - 1))[owner] * p
        return np.r_[g.sum(), np.bincount(at, g[sentence], m) - l2 / len(rows) * x[1:]]

    # a start at which a document without signs has about the toxic share
    start = np.r_[np.log(max(1e-6, (weight * y).sum()) / max(1.0, float(np.median(count)))), np.zeros(m)]
    x = ascend(slope, start, steps)
    return Model(word, x[1:], float(x[0]))


def toxic_sentences(docs: DataFrame, model: Model, at_least: float = 0.3) -> DataFrame:
    """doc_id, score, and ``offending``: (start, end, p) of sentences of probability ``at_least``, in bytes of the UTF-8 text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            for lo, hi, buf, offs in B.chunks(batch.column("text")):
                hashes, sentence, row, first, last = sentences(buf, offs)
                p = model.sentence_scores(hashes, sentence, len(row))
                score = np.clip(noisy_or(p, row, hi - lo), 0, 1)
                hit = np.flatnonzero(p >= at_least)
                edge = np.searchsorted(row[hit], np.arange(hi - lo + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(first[hit] - offs[row[hit]]), pa.array(last[hit] - offs[row[hit]]), pa.array(p[hit])], ["start", "end", "p"])
                found = pa.ListArray.from_arrays(pa.array(edge), items).cast(kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(score), found], ["doc_id", "score", "offending"])

    return pick(docs, "doc_id", "text").mapInArrow(scan, "doc_id long, score double, offending array<struct<start:long,end:long,p:double>>")
