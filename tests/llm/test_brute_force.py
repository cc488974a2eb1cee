"""The results of op2, op3 and op9 against plain loops over characters, lines, labellings and paths."""

import itertools
import math
import random

import pytest

from quillmere.llm import langid, quality, toxicity

MASK = 0xFFFFFFFF


def plain_language(text, trained):
    codes = [ord(c) if c.isalpha() else 0 for c in f" {(text or '').lower()} "] + [0, 0]
    counts = {}
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if a:
            mixed = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & MASK
            two = (a * 0x27D4EB2F + b * 0x165667B1) & MASK
            for h in (((mixed ^ mixed >> 15) * 0x2C1B3C6D & MASK) >> 19, ((two ^ two >> 15) * 0x297A2D39 & MASK) >> 19):
                counts[h] = counts.get(h, 0) + 1
    if not counts:
        return "und", 0.0
    size = math.sqrt(sum(counts.values()))
    w, code = trained["w"], trained["code"]
    margins = [sum(math.sqrt(n) / size * float(w[h, k]) for h, n in counts.items()) + float(w[-1, k]) for k in range(code.shape[1])]
    losses = [sum(math.log1p(math.exp(-m * y)) for m, y in zip(margins, row, strict=True)) for row in code]
    low = min(losses)
    share = [math.exp(low - x) for x in losses]
    return trained["langs"][losses.index(low)], max(share) / sum(share)


def test_language_against_loops(spark):
    rng = random.Random(1)
    stems = {"en": "the thing house which water", "de": "der schnell über nicht straße", "fr": "le chien être où avec", "es": "el niño perro según mañana"}
    text = lambda lang, n: " ".join(rng.choice(stems[lang].split()) for _ in range(n))
    trained = langid.train(spark.createDataFrame([(text(lang, 12), lang) for lang in stems for _ in range(12)], "text string, lang string"))
    ask = [(k, t) for k, t in enumerate([*(text(lang, n) for lang in stems for n in (1, 3, 9)), "12 34", None, "", "ß", "THE über ñ 9", text("en", 4) + " " + text("de", 4)])]
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(ask, "doc_id long, text string"), trained).collect()}
    for k, t in ask:
        lang, score = plain_language(t, trained)
        assert got[k].lang_pred == lang and got[k].score == pytest.approx(score, abs=1e-4)


def plain_kind(c):
    if c.isspace():
        return 0
    if c.isupper():
        return 2
    if c.isalpha():
        return 1
    if c.isdigit():
        return 3
    return 4 if c in ".,;:?'\"-()’“”¿¡" else 6 if c in "|\t" else 5


def plain_line(line, again):
    kinds = [plain_kind(c) for c in line]
    n = len(line)
    letters = sum(k in (1, 2) for k in kinds)
    words = max(1, len(line.split()))
    share = lambda k: kinds.count(k) / n
    in_a_row = sum(a == b == 5 for a, b in zip(kinds, kinds[1:], strict=False))
    return [1, math.log1p(n) / 5, kinds.count(2) / max(1, letters), share(3), share(4), share(5), in_a_row / words, min(letters / words, 20) / 10, min(words, 200) / 100, kinds[-1] == 4, kinds[0] == 2, again, share(6)]


def plain_quality(text, trained):
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return 0.0
    own = [plain_line(x, x in lines[:k]) for k, x in enumerate(lines)]
    zero = [0.0] * len(own[0])
    rows = [own[k] + (own[k - 1] if k else zero) + (own[k + 1] if k + 1 < len(own) else zero) for k in range(len(own))]
    emit = [sum(a * b for a, b in zip(row, trained["w"], strict=True)) for row in rows]
    weight = {}
    for y in itertools.product((0, 1), repeat=len(lines)):
        weight[y] = math.exp(sum(e for e, v in zip(emit, y, strict=True) if v) + sum(trained["trans"][a][b] for a, b in itertools.pairwise(y)))
    z = sum(weight.values())
    good = [sum(v for y, v in weight.items() if y[k]) / z for k in range(len(lines))]
    mean = sum(p * len(x) for p, x in zip(good, lines, strict=True)) / sum(map(len, lines))
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(trained["slope"] * math.log(mean / (1 - mean)) + trained["bias"])))


def test_quality_against_all_labellings(spark):
    rng = random.Random(2)
    words = "house street water people | morning 12 letter PAPER ## ok".split()
    line = lambda good: " ".join(rng.choice(words[:4] if good and rng.random() < 0.9 else words) for _ in range(rng.randrange(2, 9))) + ("." if good else " !!")
    taught = [("\n".join(line(k % 3 > 0) for _ in range(rng.randrange(1, 5))), int(k % 3 > 0)) for k in range(150)]
    trained = quality.train(spark.createDataFrame(taught, "text string, quality int"))
    texts = ["\n".join(line(rng.random() < 0.5) for _ in range(rng.randrange(1, 7))) for _ in range(25)]
    texts += [None, "", "\n \n", "One.\nOne.\n\nOne.", "x", "Ünï | ça\tva\n##", "a\n" * 6]
    got = {r.doc_id: r.score for r in quality.quality_score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), trained).collect()}
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(plain_quality(t, trained), abs=1e-4), t


def plain_restore(model, shown):
    """The cheapest way through the lattice, by trying all."""
    found = []

    def go(k, a, b, last, cost, word):
        if k == len(shown):
            found.append((cost + model.rows[a][b][0], word))
            return
        c = shown[k]
        options = [(x, toxicity.SUBSTITUTE) for x in toxicity.SIGNS.get(c, "")] + ([(c, 0.0)] if c.isalpha() else [])
        for x, extra in options:
            kind = toxicity.char_class(x)
            go(k + 1, b, kind, x, cost + extra + model.rows[a][b][kind], word + x)
        if c == last and c.isalpha():
            go(k + 1, a, b, last, cost + toxicity.REPEAT, word)
        elif c in toxicity.SEPARATORS:
            go(k + 1, a, b, last, cost + toxicity.SEPARATE, word)
        elif c in toxicity.SIGNS and not c.isalpha():
            go(k + 1, a, b, last, cost + toxicity.REPEAT * 4, word)

    go(0, 0, 0, "", 0.0, "")
    least = min(cost for cost, _ in found)
    return min(w for cost, w in found if cost <= least + 1e-9)


def test_toxicity_against_all_paths(spark):
    rng = random.Random(3)
    plain, bad = "garden river window letter morning paper".split(), "idiot moron loser".split()
    rows = []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(15)]
        if k % 4 == 0:
            words[rng.randrange(15)] = rng.choice(bad)
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    trained = toxicity.train(df, df)
    shown = "1d10t m0r0n l0$er i.d.i.o.t g4rd3n w1nd0w idiiot m-o-r-o-n p@per l0sser r1ver 1!d".split()
    for token in shown:
        assert trained["model"].restore(token)[0] == plain_restore(trained["model"], token)
    texts = [f"{rng.choice(plain)} {t} {rng.choice(plain)}" for t in shown] + ["garden river", None, "", "idiot moron", "idiot idiot"]
    got = {r.doc_id: r.score for r in toxicity.toxicity_score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), trained).collect()}
    for k, t in enumerate(texts):
        restored = {w if w.isalpha() else plain_restore(trained["model"], w) for w in (t or "").split()}
        odds = trained["prior"] + sum(v for w, v in trained["words"].items() if w in restored)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, odds)))), abs=1e-9), t
