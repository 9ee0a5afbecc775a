import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quadloom.llm import bytescan as B
from quadloom.llm import neardup


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            n = len(x & y)
            if x and y and 100 * n >= 75 * (len(x) + len(y) - n):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    r = random.Random(seed)
    fresh = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(8):  # groups of copies with few and with many changes, short and long
        base = fresh(r.choice([8, 30, 150, 600]))
        texts += [" ".join(base).upper(), "  ".join(base)]
        texts += [edited(r, base, r.randrange(0, max(2, len(base) // 25))) for _ in range(8)]
    chain = fresh(120)  # each is near the last, the ends are far apart
    for i in range(12):
        texts.append(" ".join(chain))
        chain = [*chain[8:], *fresh(8)]
    passage = fresh(40)  # shared by many that are not near
    texts += [" ".join([*passage, *fresh(r.randrange(20, 90))]) for _ in range(60)]
    texts += ["All rights reserved . x", "all rights reserved . X", "a b", "A B", "a", "", None, " ", "é b", "É b"]
    texts += [" ".join(fresh(r.randrange(1, 60))) for _ in range(60)]
    r.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(documents, seed):
    rows = corpus(seed)
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in neardup.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)


def test_hub_far_from_some_of_its_group(documents, monkeypatch):
    """Copies whose links pass only through each other, in blocks of few rows."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SETS", 3)
    r = random.Random(9)
    base = [f"w{i}" for i in range(140)]
    rows = [(i, edited(r, base, r.randrange(2, 7))) for i in range(40)]
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in neardup.near_duplicates(documents(rows)).collect()}
    want = brute(rows)
    assert got == want and len({c for _, c in want.values()}) > 1


def test_rows_of_one_doc_id_are_linked_each_by_its_text(documents):
    r = random.Random(2)
    x, y, z = ([f"{c}{i}" for i in range(90)] for c in "xyz")
    rows = [(5, " ".join(x)), (5, " ".join(y)), (3, edited(r, x, 1)), (9, edited(r, y, 1)), (7, edited(r, z, 1)), (7, " ".join(z)), (7, " ".join(z)), (8, "lone words here")]
    got = sorted((g.doc_id, g.component_id, g.kept) for g in neardup.near_duplicates(documents(rows)).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True), (7, 7, True), (7, 7, True), (8, 8, True), (9, 5, False)]
    kept = sorted((g.doc_id, g.text) for g in neardup.keep_one(documents(rows)).collect())
    assert [i for i, _ in kept] == [3, 5, 7, 8] and kept[1][1] == rows[1][1]


def test_tiny_sets(documents):
    """Three of four shingles shared: all pairs are found, wherever their hashes lie."""
    rows = []
    for i in range(400):
        w = [f"t{i}x{j}" for j in range(8)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:7]))]
    got = {g.doc_id: g.component_id for g in neardup.near_duplicates(documents(rows)).collect()}
    assert got == {i: i // 2 * 2 for i in got}


def test_larger_bands_in_larger_blocks(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "PARTS", 3)
    rows = corpus(5)
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in neardup.near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)


def test_registers_keep_the_smallest_hash():
    r = np.random.default_rng(1)
    key = r.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    owner = np.sort(r.integers(0, 3, 400))
    got = neardup.registers(key, owner, 3)
    for i in range(3):
        for j in range(neardup.REGISTERS):
            own = [int(k) >> 7 for k in key[owner == i] if int(k) % neardup.REGISTERS == j]
            if not own:
                assert got[i, j] == neardup.EMPTY
                continue
            bits = format(min(own), "057b")
            zeros = len(bits) - len(bits.lstrip("0"))
            rest = (bits[zeros + 1 :] + "0" * neardup.MANTISSA)[: neardup.MANTISSA]
            assert got[i, j] == (zeros << neardup.MANTISSA) | int(rest, 2)


def test_estimate_is_near_the_truth():
    r = np.random.default_rng(2)
    for n, share in ((50, 0.8), (1000, 0.5), (1000, 0.0), (20000, 0.75)):
        errors = []
        for _ in range(30):
            all_ = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            common = int(n * share)
            sets = [all_[:n], np.concatenate([all_[:common], all_[n : 2 * n - common]])]
            x, y = (neardup.registers(B.mix64(s), np.zeros(len(s), np.int64), 1) for s in sets)
            est, _ = neardup._compare(x, y, np.array([n]), np.array([n]), 0.75)
            errors.append(est[0] - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.03


def test_shingles_of_short_rows():
    (lo, hi, buf, offs), = B.chunks(pa.array(["A b", "a  B", "a b c d e f", "", None, "a b c d e"]))
    key, owner = neardup.shingles(buf, offs, 5)
    sets = [set(key[owner == i].tolist()) for i in range(6)]
    assert [len(s) for s in sets] == [1, 1, 2, 0, 0, 1] and sets[0] == sets[1] and sets[5] < sets[2]


def test_odd_rows(odd, clashing, empty):
    for d in (odd, clashing):
        got = neardup.near_duplicates(d).collect()
        assert len(got) == 11
        by = {}
        for g in got:
            by.setdefault(g.doc_id, []).append((g.n_shingles, g.component_id, g.kept))
        assert by[4] == [(1, 4, True)] and by[7] == [(1, 4, False)] and by[6] == [(1, 6, True)] * 2 and by[1] == [(0, 1, True)]
        assert [c for _, c, _ in by[None]] == [None, None]
    assert neardup.near_duplicates(empty).count() == 0
    assert sorted(x.doc_id or 0 for x in neardup.keep_one(odd).collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 8]
