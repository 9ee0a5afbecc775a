import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import bytescan as B

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("ab é中😀 \t\n\x0b\x0c\r\x1c\x85\xa0")), max_size=40)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words(texts, limit):
    rows = []
    for lo, hi, buf, offs in B.chunks(pa.array(texts, pa.string()), limit):
        s, e, r = B.words(buf, offs)
        h = B.span_hash(buf, s, e)
        raw = buf.tobytes()
        found = [raw[i:j].decode() for i, j in zip(s, e, strict=True)]
        assert len({w for w in found}) == len(set(h.tolist()))
        rows += [[w for w, k in zip(found, r, strict=True) if k == i] for i in range(hi - lo)]
    assert rows == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=5), st.integers(1, 4))
def test_windows(rows, n):
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    h = B.mix64(np.array([x for r in rows for x in r], np.uint64) + np.uint64(1))
    key, at = B.windows(h, row, n)
    flat = [x for r in rows for x in r]
    want = [(int(row[i]), tuple(flat[i : i + n])) for i in at]
    every = [(i, tuple(r[j : j + n])) for i, r in enumerate(rows) for j in range(len(r) - n + 1)]
    assert want == every
    folded = B.fold(key, row[at])
    assert len(set(folded.tolist())) == len(set(every))
    assert B.repeated(folded).tolist() == [every.count(x) > 1 for x in every]


def test_slices_of_arrays():
    a = pa.array(["x y", None, "zz", "é"]).slice(1, 3)
    got = [(hi - lo, bytes(buf), offs.tolist()) for lo, hi, buf, offs in B.chunks(a)]
    assert got == [(3, "zzé".encode(), [0, 0, 2, 4])]
