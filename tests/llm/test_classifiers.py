"""Trained operators: held-out accuracy on the smallest tables, parts against brute force, odd rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadloom.llm import bytescan as B
from quadloom.llm import crf, language, queries, toxicity
from quadloom.llm.samples import fold, labelled_sample, within

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet").cache() for n in ("documents", "labels"))
    return docs, labels


def test_fold_and_sample(spark, tables, documents):
    got = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(g.f == zlib.crc32(str(g.id).encode()) % 4 for g in got)
    docs, labels = tables
    s = labelled_sample(docs, labels, "quality", 3, 1, 20)
    rows = s.collect()
    assert sum(r.label == 0 for r in rows) == 20 and sum(r.label == 1 for r in rows) == 20
    known = labels.filter(fold(F.col("doc_id"), 3) != 1).groupBy("quality").count().collect()
    assert {(r.label, round(r.weight * 20)) for r in rows} == {(k.quality, k["count"]) for k in known}
    none = labels.filter("false")
    assert labelled_sample(docs, none, "quality", 3, 1, 20).count() == 0


def test_quality_held_out(spark, tables):
    got = queries.op8_line_crf_quality(spark, SF).join(tables[1], "doc_id").filter("held_out").collect()
    right = [(g.predicted == g.quality) for g in got]
    assert len(got) > 90 and np.mean(right) > 0.97
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)


def test_toxicity_held_out(spark, tables):
    got = queries.op1_noisy_or_toxicity(spark, SF).join(tables[1], "doc_id").filter("held_out").collect()
    assert np.mean([g.predicted for g in got if g.toxic]) >= 0.9
    assert not any(g.predicted for g in got if not g.toxic)


def test_language_held_out(spark, tables):
    got = queries.op9_viterbi_language(spark, SF).join(tables[0].select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and np.mean([g.lang_pred == g.lang for g in got if g.held_out]) > 0.98


def test_whole_scores_against_a_plain_noisy_or(spark, tables):
    """Every document's score from the trained weights, by regular expressions and dictionaries."""
    docs, labels = tables
    model = toxicity.train(docs, labels)
    got = {g.doc_id: g for g in toxicity.toxic_sentences(docs, model).collect()}
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    known = {}

    def value(sign, k):
        if (sign, k) not in known:
            raw = np.frombuffer(sign.encode(), np.uint8)
            h = int(B.span_hash(raw, np.array([0]), np.array([len(raw)]))[0])
            known[sign, k] = weight.get(h ^ k, 0.0)
        return known[sign, k]

    for i, text in rows.items():
        clean = 1.0
        for part in re.split(r"[.!?\n\r]", (text or "").translate(low)):
            words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", part)
            if words:
                total = model.bias + sum(value(w, 0) + sum(value(w[:k], k) for k in toxicity.PREFIXES if len(w) >= k) for w in words)
                clean *= 1 - 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        assert np.isclose(got[i].score, 1 - clean, atol=1e-6), i


def test_samples_stay_within_their_budget(spark, tables):
    docs, labels = tables
    small = toxicity.train(docs, labels, max_hits=3000)
    assert small.constant is None and len(small.words) > 0
    assert np.isfinite(crf.train(docs, labels, max_total_lines=200, steps=10).weights).all()
    rows = spark.createDataFrame([(5, 10), (1, 4), (3, 4), (9, 1)], "at long, size long")
    assert {r.at for r in within(rows, 8).collect()} == {1, 3} and within(rows, 3).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (crf.train(docs, x, steps=10) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.calibration == b.calibration


@pytest.mark.parametrize("seed", range(6))
def test_forward_backward(seed):
    r = np.random.default_rng(seed)
    lengths = [3, 1, 5, 4]
    row = np.repeat(np.arange(4), lengths)
    emit, move = r.normal(size=len(row)), r.normal(size=(2, 2))
    p, pair, z = crf.forward_backward(emit, move, row)
    want_z, want_pair, at = 0.0, np.zeros((2, 2)), 0
    for n in lengths:
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = np.exp(sum(emit[at + k] * y[k] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
        total = sum(weight.values())
        want_z += np.log(total)
        for k in range(n):
            assert np.isclose(p[at + k], sum(w for y, w in weight.items() if y[k]) / total)
        for k in range(n - 1):
            for y, w in weight.items():
                want_pair[y[k], y[k + 1]] += w / total
        at += n
    assert np.isclose(z, want_z) and np.allclose(pair, want_pair)


@pytest.mark.parametrize("seed", range(8))
def test_viterbi(seed):
    r = np.random.default_rng(seed)
    lengths = [4, 1, 6, 2]
    row = np.repeat([0, 2, 3, 7], lengths)
    scores = r.normal(size=(len(row), 3)).astype(np.float32)
    path = language.viterbi(scores, row, 0.8)
    at = 0
    for n in lengths:
        value = lambda y, at=at: sum(scores[at + k, s] for k, s in enumerate(y)) - 0.8 * sum(a != b for a, b in itertools.pairwise(y))
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert np.isclose(value(best), value(path[at : at + n].tolist()))
        at += n


def test_mixed_language_spans(spark, tables):
    docs, _ = tables
    model = language.train(docs)
    parts = {r.lang: " ".join(r.text.split()[:40]) for r in docs.filter("n_chars > 600").select("lang", "text").collect()}
    text = parts["de"] + " " + parts["es"]
    (g,) = language.languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [s.lang for s in g.spans] == ["de", "es"]
    assert abs(g.spans[0].end - len(parts["de"])) < 25 and g.spans[1].end <= len(text)


def test_scripts_narrow_the_candidates(documents):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("abc def", "en"), ("где это", "ru"), ("что там", "ru"), ("the thing", "en"), ("это там", "ru"), ("ab the", "en")] * 4)]
    model = language.train(documents(rows))
    assert model.langs == ["en", "ru"]
    got = {g.doc_id: g for g in language.languages(documents([(1, "qqq zzz"), (2, "щщщ"), (3, "щщщ ъъъ xyz"), (4, "12 !")]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "ru", "ru", "und"]
    assert got[3].score == pytest.approx(2 / 3) and [s.lang for s in got[3].spans] == ["ru", "en"]


def test_noisy_or_names_the_sentence(documents, spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    def sentence(bad):
        return " ".join([*r.choices(words, k=6), *(["vile"] if bad else [])])

    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        parts = [sentence(False) for _ in range(5)]
        if toxic:
            parts[r.randrange(5)] = sentence(True)
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(toxic)))
    model = toxicity.train(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {g.doc_id: g for g in toxicity.toxic_sentences(documents(rows), model).collect()}
    for i, text in rows:
        assert (got[i].score >= 0.3) == (i % 3 == 0)
        hits = [text.encode()[o.start : o.end].decode() for o in got[i].offending]
        assert all("vile" in h for h in hits) and len(hits) == (i % 3 == 0)
    p, row = np.array([0.2, 0.5, 0.1]), np.array([0, 0, 2])
    assert np.allclose(toxicity.noisy_or(p, row, 3), [1 - 0.8 * 0.5, 0, 0.1])


def test_odd_rows(odd, clashing, empty, spark, tables):
    docs, labels = tables
    quality, toxic, lang = crf.train(docs, labels, steps=15), toxicity.train(docs, labels, steps=15), language.train(docs)
    for d in (odd, clashing):
        rows = crf.score_quality(d, quality).collect()
        assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
        assert len(crf.line_labels(d, quality).collect()) == 7
        t = {r.doc_id: r for r in toxicity.toxic_sentences(d, toxic).collect()}
        assert t[1].score == t[2].score == t[3].score == 0 and t[1].offending == []
        n = language.languages(d, lang).collect()
        assert len(n) == 11 and {r.lang_pred for r in n if r.doc_id in (1, 2, 3)} == {"und"}
    for rows in (crf.score_quality(empty, quality), crf.line_labels(empty, quality), toxicity.toxic_sentences(empty, toxic), language.languages(empty, lang)):
        assert rows.count() == 0
    # nothing, or one class only, to learn from
    none = labels.filter("false")
    assert {r.score for r in crf.score_quality(odd, crf.train(docs, none)).collect()} == {1.0}
    assert max(r.score for r in toxicity.toxic_sentences(odd, toxicity.train(docs, none)).collect()) == 0
    bad = labels.withColumn("quality", F.lit(0)).withColumn("toxic", F.lit(1))
    assert {r.score for r in crf.score_quality(odd, crf.train(docs, bad)).collect()} == {0.0}
    t = {r.doc_id: r.score for r in toxicity.toxic_sentences(odd, toxicity.train(docs, bad)).collect()}
    assert t[4] > 0.99 and t[1] == 0
    unknown = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.languages(odd, unknown).collect()} == {"und"}


def test_lines():
    (_, _, buf, offs), = B.chunks(pa.array(["A b\n\n|x| y\n", "", "same\nsame"]))
    own, row, length, begin = crf.lines_of(buf, offs)
    assert row.tolist() == [0, 0, 2, 2] and begin.tolist() == [0, 5, 11, 16] and length.tolist() == [2, 4, 4, 4]
    assert own.shape == (4, crf.OWN) and own[0, 0] == 0.5 and own[1, 4] == 0.5


def test_a_rare_language_is_learned(documents):
    r = random.Random(3)
    text = lambda words: " ".join(r.choice(words) for _ in range(20))
    often, rare = ["the", "house", "which", "stands"], ["zkouq", "vyqax", "jorzz"]
    rows = [(i, text(often), "en", "s") for i in range(600)] + [(1000 + i, text(rare), "xx", "s") for i in range(6)]
    d = documents(rows)
    model = language.train(d, max_docs=20)
    assert model.langs == ["en", "xx"] and language.train(d, max_docs=20, per_lang=1).langs == ["en", "xx"]
    got = {g.doc_id: g.lang_pred for g in language.languages(d, model).collect()}
    assert got == {i: lang for i, _, lang, _ in rows}


def test_viterbi_of_many_languages():
    scores = np.full((3, 300), -20.0, np.float32)
    scores[:, 250] = 0
    assert language.viterbi(scores, np.zeros(3, np.int64), 6.0).tolist() == [250] * 3


def test_rows_of_one_doc_id_teach_their_own_language(documents):
    rows = [(i // 2, ["ab cd ef", "uvw xyz"][i % 2], ["aa", "bb"][i % 2]) for i in range(40)]
    a, b = (language.train(documents(rows, n)) for n in (1, 5))
    assert a.langs == ["aa", "bb"] and np.array_equal(a.logp, b.logp)
    got = language.languages(documents([(1, "cd ab"), (2, "xyz")]), a).collect()
    assert {g.doc_id: g.lang_pred for g in got} == {1: "aa", 2: "bb"}


def naive_lines(text):
    """Features, length of each line with a word, straight from their definition, by bytes."""
    words_of = lambda raw: [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    low = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    lines = [x for x in (text or "").encode().split(b"\n") if words_of(x)]
    out = []
    for x in lines:
        words = words_of(x)
        chars, n = sum(map(len, words)), len(words)
        share = [sum(x.count(bytes([b])) for b in members) / chars for members in crf.CLASSES.values()]
        lows = [low(w) for w in words]
        letters = share[0] + share[1]
        own = [*share, np.log1p(n), np.log1p(chars / n), sum(a == b for a, b in itertools.pairwise(lows)) / n, (n - len(set(lows))) / n]
        own += [float(lines.count(x) > 1), float(share[0] > 0.5 * max(letters, 1e-9)), float(n < 3), float(share[4] > 0), min(share[3] * 10, 1)]
        out.append((own, max(chars, 1)))
    return out


def test_whole_quality_scores_against_plain_chains(spark, tables):
    """op8 at sf0.01: features, field and aggregation again, a line and a state at a time."""
    docs, labels = tables
    model = crf.train(docs, labels)
    got = {g.doc_id: g.score for g in crf.score_quality(docs, model).collect()}
    add = lambda a, b: max(a, b) + np.log1p(np.exp(-abs(a - b)))
    for r in docs.select("doc_id", "text").collect():
        lines = naive_lines(r.text)
        bad = 1.0
        if lines:
            own = [(np.array(f) - model.mean) / model.scale for f, _ in lines]
            none = np.zeros(crf.OWN)
            padded = [none, *own, none]
            emit = [model.weights @ np.r_[1.0, padded[k + 1], padded[k], padded[k + 2]] for k in range(len(own))]
            ahead, back = [(0.0, emit[0])], [(0.0, 0.0)]
            for e in emit[1:]:
                a = ahead[-1]
                ahead.append(tuple(add(a[0] + model.move[0, j], a[1] + model.move[1, j]) + j * e for j in (0, 1)))
            for e in emit[:0:-1]:
                b = back[-1]
                back.append(tuple(add(b[0] + model.move[i, 0], b[1] + e + model.move[i, 1]) for i in (0, 1)))
            p = [1 / (1 + np.exp(np.clip(a[0] + b[0] - a[1] - b[1], -700, 700))) for a, b in zip(ahead, back[::-1], strict=True)]
            size = [n for _, n in lines]
            bad = float(np.dot(p, size) / sum(size))
        want = 1 / (1 + np.exp(-np.clip(model.calibration[0] + model.calibration[1] * bad, -40, 40)))
        assert np.isclose(got[r.doc_id], want, atol=1e-6), r.doc_id


def test_whole_languages_against_a_plain_viterbi(spark, tables):
    """op9 at sf0.01: words, scores, spans and shares again, a letter at a time."""
    docs, _ = tables
    model = language.train(docs)
    got = {g.doc_id: g for g in language.languages(docs, model).collect()}
    _, low, script = language._tables()
    bucket = {}

    def place(a, b, c):
        if (a, b, c) not in bucket:
            key = np.array([a | b << 21 | c << 42], np.uint64)
            bucket[a, b, c] = int(B.mix64(key)[0]) % language.BUCKETS
        return bucket[a, b, c]

    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        words, at = [], 0
        while at < len(text):
            end = at
            while end < len(text) and text[end].isalpha():
                end += 1
            if end > at:
                words.append((at, end))
            at = max(end, at + 1)
        g = got[r.doc_id]
        if not words:
            assert (g.lang_pred, g.score, g.spans) == ("und", 0, [])
            continue
        best, back = None, []
        for s, e in words:
            x = [0, *[int(low[ord(c)]) + 1 for c in text[s:e]], 0]
            total = model.logp[[place(*x[k : k + 3]) for k in range(e - s)]].sum(0)
            total = np.where(model.seen[script[ord(text[s])]], total, -np.inf)
            total = np.maximum(total - total.max(), -language.MOST)
            if best is None:
                best = total
                continue
            top = int(best.argmax())
            moved = best[top] - model.penalty
            back.append([k if best[k] >= moved else top for k in range(len(best))])
            best = np.maximum(best, moved) + total
        path = [int(best.argmax())]
        for b in back[::-1]:
            path.append(b[path[-1]])
        path.reverse()
        letters = np.bincount(path, [e - s for s, e in words], len(model.langs))
        assert np.isclose(g.score, letters.max() / letters.sum(), atol=0.01), r.doc_id
        if np.sort(letters)[-1] > np.sort(letters)[-2] + 30:
            assert g.lang_pred == model.langs[int(letters.argmax())]
        assert sum(s.end - s.start > 0 for s in g.spans) == len(g.spans)
