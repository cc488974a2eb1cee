"""Base spans against the contract's expressions, reliabilities on votes with known truth, added spans, and the query."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmere.llm import pii


def plain_luhn(digits):
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and plain_luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PIECES = st.sampled_from(["a@b.c", "x.y", "@", ".", "..", "+", "-", " ", "1", "25", "255", "256", "0001", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 555-0100", "é", "\U0001f600", "(", "\n", "mail", "10.0.0.1", "%", "_", "٣"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_base_is_the_contracts(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_base(text)


def test_base_on_odd_texts():
    for text in ["@a.b@c.d", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3.x4.5.6.7", "0000255.1.1.1", "9" * 5000 + ".1.1.1", "+1 ", "a@b", "4111-1111-1111-1111-", "+1.........2345678901"]:
        assert pii.base_spans(text) == (plain_base(text) if len(text) < 4000 else [])


def test_long_runs_take_linear_time():
    for text in ["a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" + " " * 2_000_000, "a." * 1_000_000 + "@", "Aa" * 1_000_000, "1 " * 1_000_000, "(1" * 1_000_000, "AB12" * 500_000, "dot " * 300_000]:
        began = time.time()
        pii.base_spans(text), pii.wide_spans(text)
        assert time.time() - began < 20, text[:10]


def test_reliabilities_are_recovered():
    """Three labelers of known accuracy vote on spans of known class: their chances come out, and the posterior beats each of them."""
    rng, right = random.Random(0), (0.9, 0.8, 0.7)
    truth = [rng.random() < 0.4 for _ in range(20_000)]
    votes = ["".join("0" if rng.random() < 0.2 else "+" if (rng.random() < r) == t else "-" for r in right) for t in truth]
    patterns = sorted({v: votes.count(v) for v in set(votes)}.items())
    chance, rel = pii.learn_reliabilities(patterns)
    for k, r in enumerate(right):
        assert rel[k]["+"][0] == pytest.approx(0.8 * r, abs=0.03) and rel[k]["-"][1] == pytest.approx(0.8 * r, abs=0.03)
    hits = sum((chance[v] >= 0.5) == t for v, t in zip(votes, truth)) / len(truth)
    assert hits > max(sum((v[k] == "+") == t for v, t in zip(votes, truth)) / len(truth) for k in range(3))
    assert pii.learn_reliabilities([]) == ({}, [])


def test_classifier_learns_words_that_no_labeler_knows():
    said = lambda word: pii.candidate(f"{word} 555 123 4567 end", (len(word) + 1, pii.KINDS.index("local_phone"), len(word) + 13)).window
    windows = [said("dring")] * 30 + [said("kiste")] * 30
    w = pii.fit(windows, [0.95] * 30 + [0.05] * 30)
    assert pii.probability(w, said("dring")) > 0.8 > 0.2 > pii.probability(w, said("kiste"))
    assert pii.probability(pii.fit([], []), said("x")) == 0.5


CLEAN = ["Prose about nothing at all, with a number 12 and a dot here.", "Version 1.2.3 of 2024-01-01, page 12, total 1234.", 'token = "87e15d78b9d8ef29b6c10061e3551a60fa07e990"', "THE THTHLYEA!! WH!! 12 34"]
FOUND = {
    "Write to jane dot doe (at) example (dot) com please": "hidden_email",
    "call 555-123-4567 today": "local_phone",
    "SSN 123-45-6789 on file": "id_number",
    "IBAN GB82 WEST 1234 5698 7654 32 for the transfer": "iban",
    "Dear Maria Lopez, hello": "name",
    "lives at address 12 Baker Street now": "street",
}


def test_added_spans(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([*CLEAN, *FOUND, "mail me: bob@example.com", "+1 (555) 555-0100 or 555-123-9999"]), "x", 1) for k in range(400)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string, base int")).collect()}
    seen = {}
    for k, text, *_ in rows:
        spans = [(s.start, s.kind, s.end) for s in got[k].spans]
        assert [tuple(s) for s in got[k].base] == plain_base(text) and set(plain_base(text)) <= set(spans) and len(got[k].likely) == len(spans)
        assert all(a[2] <= b[0] or b[1] < 4 for a, b in zip(spans, spans[1:]))
        seen[text] = {pii.KINDS[s[1]] for s in spans}
    for text in CLEAN:
        assert not seen.get(text), text
    for text, kind in FOUND.items():
        assert kind in seen[text], text


def test_query(spark, tmp_path):
    texts = [None, "", "a@b.c and 10.0.0.1", "é\U0001f600 4111 1111 1111 1111, +1 (555) 555-0100", *CLEAN, "x" * 100_000 + " q@r.st"]
    rows = [(k, t, "fr") for k, t in enumerate(texts)] + [(2, texts[2], "again"), (None, texts[3], None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, ((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.op13_personal_data(spark, str(tmp_path)).collect())))
    want = []
    for k, t, _ in rows:
        base = plain_base(t or "")
        listed = ",".join(f"{pii.KINDS[kind]}:{s}:{e}" for s, kind, e in base)
        want.append(repr((k, *(sum(x[1] == i for x in base) for i in range(4)), hashlib.sha256(listed.encode()).hexdigest(), listed)))
    assert got == sorted(want)


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
