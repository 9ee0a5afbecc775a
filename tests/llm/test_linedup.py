import random
import re

from quadloom.llm import linedup, queries


def test_patience_is_a_rising_common_subsequence():
    r = random.Random(3)
    for _ in range(300):
        a = [r.choice("abcdefghij") for _ in range(r.randrange(0, 14))]
        b = [r.choice("abcdefghij") for _ in range(r.randrange(0, 14))]
        got = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:], strict=False))
        # what is unique in both and in rising order is found, also after the common ends are taken
        start = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[:start] == [(k, k) for k in range(start)]
        x, y = a[start:], b[start:]
        while x and y and x[-1] == y[-1]:
            x, y = x[:-1], y[:-1]
        places = [x.index(v) for v in y if x.count(v) == 1 and y.count(v) == 1]
        assert len(got) >= start + (len(a) - start - len(x)) + naive_rising(places)


def test_known_alignment():
    a, b = list("abcXdefYgh"), list("abcdeZfgQh")
    assert [(a[i], b[j]) for i, j in linedup.patience(a, b)] == [(c, c) for c in "abcdefgh"]


def naive_rising(v):
    best = 0
    for mask in range(1 << len(v)):
        s = [x for k, x in enumerate(v) if mask >> k & 1]
        if s == sorted(s):
            best = max(best, len(s))
    return best


def test_rising():
    r = random.Random(1)
    for _ in range(60):
        v = r.sample(range(20), r.randrange(0, 9))
        at = linedup._rising(v)
        assert [v[i] for i in at] == sorted(v[i] for i in at) and len(at) == naive_rising(v)


def test_against_brute_force(documents):
    r = random.Random(8)
    line = lambda n=12: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    passage, common = [line() for _ in range(4)], "this line is in very many texts"
    rows = []
    for i in range(120):
        own = [line(r.randrange(1, 20)) for _ in range(r.randrange(1, 10))]
        if r.random() < 0.5:
            own.insert(r.randrange(len(own) + 1), common)
        if r.random() < 0.4:
            at = r.randrange(len(own) + 1)
            own[at:at] = passage[r.randrange(3) :]
        if r.random() < 0.2 and rows:
            own += rows[r.randrange(len(rows))][1].split("\n")[: r.randrange(8)]
        if r.random() < 0.1:
            own.insert(0, "")
        rows.append((i, "\n".join(own)))
    rows += [(500, rows[3][1]), (501, rows[3][1] + "\n" + line())]
    want = brute_all(rows)
    assert sum(w[2] for w in want.values()) > 50
    for rare in (1, 3, 8, 1000):  # which way finds a block does not matter
        got = {g.doc_id: (g.text, g.n_lines, g.removed_lines, g.removed_words) for g in linedup.drop_common_blocks(documents(rows), rare=rare).collect()}
        assert got == want


def test_odd_rows(odd, clashing, empty, documents):
    for d in (odd, clashing):
        got = linedup.drop_common_blocks(d).collect()
        assert len(got) == 11 and sum(g.removed_lines for g in got) == 0
        assert {g.doc_id: g.text for g in got if g.doc_id}[8] == "\n\n\nx\n"
    assert linedup.drop_common_blocks(empty).count() == 0
    text = "\n".join(f"l{i} " + "a b c d e f" for i in range(5))
    got = {g.doc_id: g.text for g in linedup.drop_common_blocks(documents([(1, text), (2, text), (None, text)])).collect()}
    assert got == {1: text, 2: "", None: text}


def every_run(a, b, words, min_words):
    """Lines of ``b`` in a run of ``min_words`` words or more that ``a`` holds anywhere, by trying all starts."""
    gone = set()
    for p in range(len(a)):
        for q in range(len(b)):
            n = 0
            while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                n += 1
            if sum(words[q : q + n]) >= min_words:
                gone.update(range(q, q + n))
    return sorted(gone)


def test_repeated_and_swapped_passages_go():
    p, q = ["p1", "p2"], ["q1", "q2", "q3"]
    for a, b in ((["x", *p, "y", *p, "z"], ["u", *p, "v"]), (["x", *p, "y"], ["u", *p, "v", *p, "w"]), ([*p, "x", *q], ["u", *q, "v", *p, "w"])):
        words = [15] * len(b)
        assert linedup.common_lines(a, b, words, 25) == [j for j, x in enumerate(b) if x[0] in "pq"]
    r = random.Random(6)
    for _ in range(2000):
        size = {c: r.randrange(1, 12) for c in "abcde"}
        a, b = ([r.choice("abcde"[: r.randrange(1, 6)]) for _ in range(r.randrange(0, 16))] for _ in "ab")
        words = [size[x] for x in b]
        assert linedup.common_lines(a, b, words, 15) == every_run(a, b, words, 15)


def brute_all(rows, min_words=25):
    """By doc_id: the text without the lines in a run of ``min_words`` words or more that any earlier document holds, and counts.

    Compares all pairs of documents line by line, without the module.
    """
    lines = {i: [x.strip(" \t\r\v\f") for x in t.split("\n") if x.split()] for i, t in rows}
    out = {}
    for i, own in lines.items():
        words = [len(x.split()) for x in own]
        gone = set().union(*[every_run(lines[a], own, words, min_words) for a in lines if a < i])
        kept, k = [], 0
        for x in dict(rows)[i].split("\n"):
            if not (x.split() and k in gone):
                kept.append(x)
            k += bool(x.split())
        out[i] = ("\n".join(kept), len(own), len(gone), sum(words[k] for k in gone))
    return out


def removed(rows, min_words=25):
    return {i: w[2] for i, w in brute_all(rows, min_words).items()}


def test_whole_query_against_all_pairs(spark):
    """op6 over the smallest documents; the pairs that share no line are left out of the comparison, nothing else."""
    path = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    lines = {i: [x.strip(" \t\r\v\f") for x in t.split("\n") if x.strip(" \t\r\v\f")] for i, t in rows.items()}
    has = {}
    for i, own in lines.items():
        for x in set(own):
            has.setdefault(x, set()).add(i)
    got = {g.doc_id: g for g in queries.op6_patience_line_dedup(spark, path).collect()}
    assert set(got) == set(rows)
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    total = 0
    for i, own in lines.items():
        size = [words(x) for x in own]
        gone = set()
        for a in set().union(*[has[x] for x in own]):
            if a < i:
                where = {}
                for p, x in enumerate(lines[a]):
                    where.setdefault(x, []).append(p)
                for q, x in enumerate(own):
                    for p in where.get(x, ()):
                        n = 0
                        while p + n < len(lines[a]) and q + n < len(own) and lines[a][p + n] == own[q + n]:
                            n += 1
                        if sum(size[q : q + n]) >= 25:
                            gone.update(range(q, q + n))
        g = got[i]
        assert (g.n_lines, g.removed_lines, g.removed_words) == (len(own), len(gone), sum(size[k] for k in gone)), i
        total += g.removed_words
    assert total > 20000


def test_blocks_of_lines_that_stand_alone_before(documents):
    r = random.Random(4)
    line = lambda n=10: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    passage = [line() for _ in range(6)]
    rows = [(i, "\n".join([line(), x, line()])) for i, x in enumerate(passage)]
    rows += [(i, "\n".join([line(), *passage, line()])) for i in (10, 11)]
    pool = [line(r.randrange(5, 30)) for _ in range(12)]
    rows += [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 8)))) for i in range(20, 60)]
    got = {g.doc_id: g.removed_lines for g in linedup.drop_common_blocks(documents(rows)).collect()}
    assert got == removed(rows) and got[10] == 0 and got[11] == 6


def test_blocks_of_short_lines(documents):
    r = random.Random(5)
    line = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    verse, pool = [line(4) for _ in range(20)], [line(r.randrange(1, 5)) for _ in range(6)]
    rows = [(1, "\n".join(verse)), (2, "\n".join([line(3), *verse, line(30)])), (3, "\n".join(verse[5:11]))]
    rows += [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 30)))) for i in range(10, 40)]
    got = {g.doc_id: g.removed_lines for g in linedup.drop_common_blocks(documents(rows)).collect()}
    assert got == removed(rows) and (got[1], got[2], got[3]) == (0, 20, 0)
