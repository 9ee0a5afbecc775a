import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.llm import bytescan as B
from quadloom.llm import packing
from quadloom.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


LETTERS = st.one_of(st.sampled_from(list("aAzZéÉßΣςİı'’.,!|#$%&*— \t\n\x00\x1c\x85\xa0ệfi1२中한ㄱ🙂<>|endoftext")), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=30), min_size=1, max_size=6))
def test_ids_are_the_tokenizers(tokenizer, texts):
    for lo, hi, buf, offs in B.chunks(pa.array(texts)):
        ids, count = packing.encode(buf, offs, PATH)
        edge = np.concatenate([[0], np.cumsum(count)])
        for k, text in enumerate(texts[lo:hi]):
            assert ids[edge[k] : edge[k + 1]].tolist() == tokenizer(text)


def test_another_tokenizer_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert packing.Known(PATH).apart and not packing.Known(path).apart
    texts = ["Two words, Three", "", "  é中😀 a\x00b <|endoftext|>", "it's  spaced\n\nout!!"]
    (_, _, buf, offs), = B.chunks(pa.array(texts))
    ids, count = packing.encode(buf, offs, path)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_full_memory_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PARTS", 50)
    r = random.Random(2)
    texts = ["".join(r.choice("abcd. ") for _ in range(200)) for _ in range(30)]
    for _, _, buf, offs in B.chunks(pa.array(texts), 600):
        ids, _ = packing.encode(buf, offs, PATH)
        assert ids.tolist() == [i for a, b in zip(offs, offs[1:], strict=False) for i in tokenizer(bytes(buf[a:b]).decode())]


def brute_force(lengths, capacity):
    """Each item where the sum of squares of open bins per gap becomes smallest, all sums counted."""
    gaps, where = [], []
    fewest = -(-sum(lengths) // capacity)
    for s in lengths:
        def total(g):
            n = {}
            for x in g:
                if x:
                    n[x] = n.get(x, 0) + 1
            return sum(v * v for v in n.values())

        # of equal sums the one that leaves the smallest gap
        options = [(total([*gaps[:b], g - s, *gaps[b + 1 :]]), g - s, b) for b, g in enumerate(gaps) if g >= s]
        best = min(options, default=None)
        if best is None or (len(gaps) < fewest and total([*gaps, capacity - s]) < best[0]):
            gaps.append(capacity - s)
            where.append(len(gaps) - 1)
        else:
            gaps[best[2]] -= s
            where.append(best[2])
    return gaps, where


@pytest.mark.parametrize("seed", range(12))
def test_sum_of_squares(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 12, 30])
    lengths = [r.randint(1, capacity) for _ in range(60)]
    b, off = packing.sum_of_squares(np.array(lengths), capacity)
    gaps, where = brute_force(lengths, capacity)
    fill = np.bincount(b, weights=lengths)
    # of bins with equal gaps any may be taken, so gaps are compared and not bins
    assert sorted((capacity - fill).tolist()) == sorted(gaps)
    for k in set(b.tolist()):
        at = sorted((o, n) for o, n, x in zip(off, lengths, b, strict=True) if x == k)
        assert [o for o, _ in at] == np.cumsum([0, *[n for _, n in at]])[:-1].tolist()


def test_pieces_and_places(documents, tokenizer):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["the", "Übung.", "xyzzy!!", "A-b"]) for _ in range(r.choice([0, 3, 40, 400])))) for i in range(80)]
    cut = packing.pieces(documents(rows), PATH, max_tokens=64)
    got = packing.pack(cut.withColumn("crc", F.crc32("ids")), max_tokens=64).collect()
    want = {}
    for i, t in rows:
        ids = [*tokenizer(t), 1]
        for k, j in enumerate(range(0, len(ids), 64)):
            want[i, k] = (j, len(ids[j : j + 64]), zlib.crc32(np.array(ids[j : j + 64], "<u4").tobytes()))
    assert {(g.doc_id, g.piece): (g.start, g.length, g.crc) for g in got} == want
    rows_of = {}
    for g in got:
        rows_of.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for at in rows_of.values():
        at.sort()
        assert [o for o, _ in at] == np.cumsum([0, *[n for _, n in at]])[:-1].tolist() and sum(n for _, n in at) <= 64
    assert len(rows_of) <= 1.03 * sum(g.length for g in got) / 64 + 1
    named = packing.pieces(documents(rows), PATH, max_tokens=64, keep=("lang", "n_chars"))
    assert named.columns == ["lang", "n_chars", *cut.columns] and sorted(map(str, named.drop("lang", "n_chars").collect())) == sorted(map(str, cut.collect()))
    # several groups, and another layout of the rows, still place everything
    a = packing.pack(cut.repartition(5).drop("ids"), max_tokens=64, group_size=40)
    assert a.count() == len(want) and a.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 64").count() == 0
    b = packing.pack(cut.repartition(2).drop("ids"), max_tokens=64, group_size=40)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_odd_rows(odd, clashing, empty):
    for d in (odd, clashing):
        cut = packing.pieces(d, PATH)
        assert cut.filter("doc_id in (1, 2, 3)").agg(F.sum("length")).first()[0] == 3
        assert cut.filter("doc_id = 6").groupBy("piece").count().filter("count <> 2").count() == 0
        assert packing.pack(cut.withColumn("OFFSET", F.lit(1))).count() == cut.count()
    assert packing.pack(packing.pieces(empty, PATH)).count() == 0
    with_map = packing.pieces(odd, PATH).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    assert packing.pack(with_map).count() == with_map.count()
