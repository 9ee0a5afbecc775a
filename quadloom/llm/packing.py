"""Pack tokenised documents into sequences of bounded length by sum-of-squares.

Documents become token ids (plus an end id); longer ones than a sequence are cut
into full pieces and a rest.  Pieces are dealt by hash into groups of bounded
size; each group packs its pieces, longest first, where the sum of squares of
the counts of open bins per residual gap becomes smallest.  As the group's total
is known, no bin beyond the fewest possible is opened while one with room is open.

Defined cases: null text is the empty text, one end id; an empty table makes no
pieces; repeated rows are documents of their own; other columns are ignored, or
carried by ``pack`` (those named sequence_id or offset give way).  Rows that differ
in map columns only, which have no order, may change places between reruns.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions.frames import carry, hashable, pick
from quadloom.llm import bytescan as B

#: Parts of words whose ids a worker remembers before it starts anew.
PARTS = 1_000_000
#: Marks that may end a word; a run of them is a part of its own to the tokenizer.
TAIL = np.zeros(256, bool)
TAIL[list(b".,;:!?%$&*#|")] = True
#: ASCII bytes that are no letters: a word with one before its tail is not cut.
ODD = np.ones(256, bool)
ODD[list(b"abcdefghijklmnopqrstuvwxyz")] = False
ODD[128:] = False
ODD[B.SPACE] = False
HEAD = (np.arange(256) & 0xC0) != 0x80
#: Stands between parts that are encoded together; a part that holds it is encoded alone.
MARK = b"\x00"
TOGETHER = 2000

# How the tokenizers whose words can be looked up apart normalise and split texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _state(part) -> dict | None:
    return None if part is None else json.loads(part.__getstate__())


class Known:
    """A worker's tokenizer, and the ids of the parts it has met, by hash of the part's bytes.

    The hashes are an open-addressing table in numpy arrays, so a part costs some
    40 bytes and all parts of a chunk are looked up at once.
    """

    def __init__(self, path: str):
        # tasks are the parallel unit; threads inside one would contend for its core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
        #: whether a text's ids are those of its words' parts
        self.apart = _state(self.tokenizer.normalizer) == NORMALIZER and _state(self.tokenizer.pre_tokenizer) == SPLITTER
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.n, self.used = 0, 0
        self.key, self.at = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.first, self.count = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.ids = np.zeros(1 << 18, "<u4")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 for unknown ones; a hash of 0 stands for 1."""
        mask = np.uint64(len(self.key) - 1)
        hashes = np.maximum(hashes, np.uint64(1))
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        slot = hashes & mask
        while len(left):
            there = self.key[slot]
            hit = there == hashes[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask
        return out

    def _insert(self, hashes: np.ndarray, at: np.ndarray) -> None:
        mask = np.uint64(len(self.key) - 1)
        hashes = np.maximum(hashes, np.uint64(1))
        slot = hashes & mask
        while len(hashes):
            free = self.key[slot] == 0
            self.key[slot[free]], self.at[slot[free]] = hashes[free], at[free]
            # of several that chose one free slot the last has it
            on = self.key[slot] != hashes
            hashes, at, slot = hashes[on], at[on], (slot[on] + np.uint64(1)) & mask

    def _add(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        k = len(hashes)
        while 2 * (self.n + k) > len(self.key):
            old, places = self.key, self.at
            self.key, self.at = np.zeros(2 * len(old), np.uint64), np.zeros(2 * len(old), np.int32)
            self.first, self.count = np.concatenate([self.first, self.first]), np.concatenate([self.count, self.count])
            self._insert(old[old != 0], places[old != 0])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.n : self.n + k], self.count[self.n : self.n + k] = self.used + starts, ends - starts
        self._insert(hashes, np.arange(self.n, self.n + k, dtype=np.int32))
        self.used += len(ids)
        self.n += k

    def learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """Encode new parts: many in one call, told apart by the mark's one id."""
        together = np.array([self.mark is not None and MARK not in w for w in parts])
        for i in np.flatnonzero(~together):
            ids = np.array(self.tokenizer.encode(parts[i].decode(), add_special_tokens=False).ids, "<u4")
            self._add(ids, np.array([0]), np.array([len(ids)]), hashes[i : i + 1])
        hashes, parts = hashes[together], [w for w, t in zip(parts, together, strict=True) if t]
        between = b" " + MARK + b" "
        runs = [slice(i, i + TOGETHER) for i in range(0, len(parts), TOGETHER)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([between.join(parts[r]).decode() for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            self._add(ids, np.append(0, ends[:-1] + 1), ends, hashes[run])

    def places(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, buf: np.ndarray) -> np.ndarray:
        """The place of each of the distinct parts, learning those that are new."""
        at = self.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.n and self.n + len(new) > PARTS:
                self.forget()
                new = np.arange(len(hashes))
            raw = buf.tobytes()
            self.learn(hashes[new], [raw[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = self.find(hashes)
        return at


@functools.lru_cache(maxsize=4)
def _known(path: str) -> Known:
    return Known(path)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _ends_in_letter(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the code point before each end, one beyond ASCII, is a letter."""
    at = ends - 1
    for _ in range(3):
        at = at - ~HEAD[buf[at]]
    size = ends - at
    byte = lambda i: buf[np.minimum(at + i, len(buf) - 1)].astype(np.int64)
    lead = byte(0) & np.choose(np.clip(size, 1, 4) - 1, [0x7F, 0x1F, 0x0F, 0x07])
    cp = lead
    for i in (1, 2, 3):
        cp = np.where(size > i, (cp << 6) | (byte(i) & 0x3F), cp)
    return _letters()[np.minimum(cp, 0x10FFFF)]


def parts_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and row of the parts of words, in order.

    The tokenizer drops white space, lower-cases, and never joins a letter with a
    mark after it; so a word's ids are those of its beginning and of the run of
    marks that ends it, where a letter stands between and no ASCII byte of the
    beginning is another sign.  Other words are one part.
    """
    starts, ends, row = B.words(buf, offs)
    low = B.LOWER[buf]
    cut = ends.copy()
    marked = np.flatnonzero(TAIL[low[ends - 1]]) if len(ends) else ends
    while len(marked):  # one mark further back each time
        cut[marked] -= 1
        marked = marked[cut[marked] > starts[marked]]
        marked = marked[TAIL[low[cut[marked] - 1]]]
    whole = np.zeros(len(starts), bool)
    odd = np.flatnonzero(ODD[low])
    if len(starts):
        word = np.searchsorted(starts, odd, "right") - 1
        whole[word[(word >= 0) & (odd < cut[word])]] = True
    high = np.flatnonzero(~whole & (cut > starts) & (cut < ends))
    high = high[low[cut[high] - 1] >= 128]
    if len(high):
        whole[high[~_ends_in_letter(low, cut[high])]] = True
    cut[whole] = ends[whole]
    two = (cut > starts) & (cut < ends)
    place = np.arange(len(starts)) + np.cumsum(two) - two
    n = len(starts) + int(two.sum())
    s, e, r = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    s[place], e[place], r[place] = starts, np.where(two, cut, ends), row
    s[place[two] + 1], e[place[two] + 1], r[place[two] + 1] = cut[two], ends[two], row[two]
    return low, s, e, r


def encode(buf: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a chunk of texts, one after the other, and how many each row has.

    Each distinct part of a word is looked up once a chunk, and encoded once a worker.
    A tokenizer that splits texts in another way encodes each whole.
    """
    known = _known(path)
    if not known.apart:
        raw = buf.tobytes()
        found = known.tokenizer.encode_batch([raw[i:j].decode() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], add_special_tokens=False)
        return np.concatenate([np.array(e.ids, "<u4") for e in found]), np.array([len(e.ids) for e in found], np.int64)
    low, starts, ends, row = parts_of(buf, offs)
    if not len(starts):
        return np.zeros(0, "<u4"), np.zeros(len(offs) - 1, np.int64)
    hashes, first, which = np.unique(B.span_hash(low, starts, ends), return_index=True, return_inverse=True)
    at = known.places(hashes, starts[first], ends[first], low)
    count = known.count[at].astype(np.int64)[which]
    begin = np.cumsum(count) - count
    ids = known.ids[np.repeat(known.first[at][which] - begin, count) + np.arange(int(count.sum()))]
    return ids, B.per_row(count, row, len(offs) - 1)


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length and ids (binary, 4 bytes each) of every document, after the columns named in ``keep``."""
    end, full = int(end_id).to_bytes(4, "little"), 4 * max_tokens

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in B.chunks(batch.column("text")):
                ids, count = encode(buf, offs, tokenizer_path)
                raw, edge = ids.tobytes(), np.r_[0, np.cumsum(4 * count)].tolist()
                at, piece, start, cut = [], [], [], []
                for i in range(hi - lo):
                    code = raw[edge[i] : edge[i + 1]] + end
                    for k, j in enumerate(range(0, len(code), full)):
                        at.append(lo + i)
                        piece.append(k)
                        start.append(j // 4)
                        cut.append(code[j : j + full])
                carried = [batch.column(c).take(pa.array(at, pa.int64())) for c in (*keep, "doc_id")]
                columns = [*carried, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(c) // 4 for c in cut], pa.int64()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    d = pick(docs, *keep, "doc_id", "text")
    fields = [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()))]
    schema = T.StructType([*d.select(*keep).schema.fields, *fields])
    return d.mapInArrow(scan, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, packed in the given order; lengths are 1 to ``capacity``."""
    open_ = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is closed and never counts
    cost = np.zeros(capacity + 1, np.int64)  # 2 * open_ + 1: what one more bin of that gap adds
    cost[1:] = 1
    gain = np.full(capacity + 1, 1 << 40, np.int64)  # 1 - 2 * open_: what one fewer adds; huge where there is none
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fewest = -(-int(lengths.sum()) // capacity)
    out_bin, out_off, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        change = gain[s:] + cost[: capacity + 1 - s]
        best = int(change.argmin())
        change_best = int(change[best])
        left = best
        if change_best >= 1 << 39 or (used < fewest and cost[capacity - s] < change_best):
            b, used, left = used, used + 1, capacity - s
        else:
            b = bins[best + s].pop()
            open_[best + s] -= 1
            n = int(open_[best + s])
            cost[best + s], gain[best + s] = 2 * n + 1, 1 - 2 * n if n else 1 << 40
        out_bin[i], out_off[i] = b, capacity - left - s
        if left:
            bins[left].append(b)
            open_[left] += 1
            n = int(open_[left])
            cost[left], gain[left] = 2 * n + 1, 1 - 2 * n
    return out_bin, out_off


def pack(pieces: DataFrame, max_tokens: int = 4096, group_size: int = 32768, seed: int = 17) -> DataFrame:
    """``pieces`` (with doc_id, piece, length) plus sequence_id and offset.

    A full piece is a sequence of its own.  ``group_size`` bounds the mean number
    of pieces that one task packs together.
    """
    p = carry(pieces, ("doc_id", "piece", "length"), ("sequence_id", "offset", "_tie", "_group"))
    n = p.count()
    groups = max(1, -(-n // group_size))
    schema = T.StructType([*p.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = p.columns

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        group = int(key[0].as_py())
        length = rows.column("length").to_numpy()
        order = np.lexsort([rows.column("_tie").to_numpy(), -length])
        b, o = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        b[order], o[order] = sum_of_squares(length[order], max_tokens)
        out = rows.select(names)
        return out.append_column("sequence_id", pa.array(b * groups + group)).append_column("offset", pa.array(o))

    tie = F.xxhash64(F.lit(seed), *hashable(p))
    p = p.withColumn("_tie", tie).withColumn("_group", F.pmod("_tie", F.lit(groups)))
    return p.groupBy("_group").applyInArrow(fill, schema)
