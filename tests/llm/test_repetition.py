import random
import re
from collections import Counter

from quadloom.llm import repetition


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def windows(n, first):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        count, seen, cover = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if count[g] > 1 and (first or g in seen):
                cover.update(range(i, i + n))
            seen.add(g)
        return cover

    seen, dup, chars = set(), 0, 0
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if words and line in seen:
            dup += 1
            chars += sum(map(len, words))
        seen.add(line)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(windows(8, True)), "dup_line_chars": chars}
    for n in repetition.NGRAM_LIMITS:
        out[f"dup_{n}gram_chars"] = sum(len(w[i]) for i in windows(n, False))
    out["base_failed"] = out["n_words"] < 20 or 100 * out["n_repeat_words"] > 30 * out["n_words"]
    over = chars > repetition.LINE_LIMIT * out["word_chars"] or any(out[f"dup_{n}gram_chars"] > x * out["word_chars"] for n, x in repetition.NGRAM_LIMITS.items())
    out["kept"] = not out["base_failed"] and not over
    return out


def test_against_brute_force(documents, odd, clashing, empty):
    r = random.Random(6)
    texts = []
    for _ in range(120):
        words = [r.choice(["a", "bé", "c|c", "#d", "😀"]) if r.random() < 0.7 else f"w{r.randrange(900)}" for _ in range(r.randrange(0, 120))]
        if r.random() < 0.4:
            words += words[r.randrange(30) :][: r.randrange(40)]
        texts.append("".join(w + r.choice([" ", " ", " ", "\n", "\t"]) for w in words))
    got = {g.doc_id: g.asDict() for g in repetition.repetition_rules(documents(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert {k: v for k, v in got[i].items() if k != "doc_id"} == brute(t)
    assert any(g["kept"] for g in got.values()) and not all(g["kept"] for g in got.values())
    by_id = {}
    for g in repetition.repetition_rules(odd).collect():
        by_id.setdefault(g.doc_id, []).append(g.asDict())
    for i, t in ((2, ""), (3, " \t\n "), (5, "é中😀 \x1c\x85 a\x00b"), (8, "\n\n\nx\n")):
        assert {k: v for k, v in by_id[i][0].items() if k != "doc_id"} == brute(t)
    assert len(by_id[6]) == 2 and by_id[6][0]["n_repeat_words"] == 30000 and by_id[1][0]["n_words"] == 0
    assert repetition.repetition_rules(clashing).count() == 11 and repetition.repetition_rules(empty).count() == 0
