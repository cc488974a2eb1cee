"""Runs against every stretch of short texts, the Lyndon array against all suffixes, and the query against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from pathlib import Path

import pytest

from quillmere.llm import periodic_runs as pr


def all_runs(w, least, times):
    """Every stretch by its definition."""
    out = []
    for q in range(1, len(w)):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                out.append((start, i - start + q, q))
                start = None
    smallest = lambda s, n, q: not any(all(w[i] == w[i + p] for i in range(s, s + n - p)) for p in range(1, q))
    return sorted((s, n, q) for s, n, q in out if n >= max(least, times * q) and smallest(s, n, q))


def all_suffixes(w):
    n = len(w)
    after, match = [], []
    for i in range(n):
        j = next(j for j in range(i + 1, n + 1) if w[j:] < w[i:])
        m = 0
        while j + m < n and w[i + m] == w[j + m]:
            m += 1
        after.append(j)
        match.append(m)
    return after, match


def drawn(rng):
    n, k = rng.randrange(1, 60), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randrange(1, 9)
        for i in range(a, n):
            w[i] = w[a + (i - a) % p]
    return w


def test_lyndon_array():
    rng = random.Random(3)
    for _ in range(4000):
        w = drawn(rng)
        assert pr.lyndon_array(w) == all_suffixes(w), w
    assert pr.lyndon_array([]) == ([], [])


@pytest.mark.parametrize(("least", "times"), [(2, 2), (2, 3), (24, 3), (6, 4)])
def test_runs(least, times):
    rng = random.Random(least * times)
    for _ in range(1500):
        w = [f"w{x}" for x in drawn(rng)]
        assert pr.runs_of(w, least, times) == all_runs(w, least, times), w


class Counted(int):
    met = 0

    def __eq__(self, other):
        Counted.met += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Counted.met += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("kind", ["one word", "two words", "long period", "fibonacci", "squares"])
def test_comparisons_are_linear(kind):
    n, a, b = 20_000, [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    w = {"one word": [0] * n, "two words": [0, 1] * (n // 2), "long period": [*range(n // 4)] * 4, "fibonacci": b[:n], "squares": ([0] * 50 + [1]) * (n // 51)}[kind]
    for sign in (1, -1):
        Counted.met = 0
        pr.lyndon_array([Counted(sign * x) for x in w])
        assert Counted.met < 8 * n


def plain_query(doc_id, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = all_runs(words, 24, 3)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(words) if i not in drop)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a " * 30, "x y z " * 9, "a b " * 20 + "c " * 40, "é ü \U0001f600 " * 12, "one"] + [" ".join(f"w{x}" for x in drawn(rng) * 3) for _ in range(150)]
    rows = [(k, t, "fr", 3) for k, t in enumerate(texts)] + [(3, "a " * 30, "repeated", 1), (None, "b " * 50, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    got = pr.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    found = sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in got.collect() if r.n_runs) + sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in got.where("n_runs = 0").collect())
    want = [(k is None, k or 0, *plain_query("no" if k is None else k, t)) for k, t, *_ in rows]
    assert zlib.crc32(b"no") % 10  # so that the plain version leaves the null id's text alone
    key = lambda r: (r[2] == 0, r[:2])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("the standard tables are not here")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    short = {k for k, t in docs.items() if len((t or "").split()) < 300}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in pr.op11_periodic_runs(spark, folder).collect()}
    assert len(short) > 50 and set(got) == set(docs)
    for k in short:
        assert got[k] == plain_query(k, docs[k])


def test_general_interface(spark):
    df = spark.createDataFrame([("a", "go " * 6 + "on", 1), ("b", None, 2)], "name string, text string, doc_id int")
    got = {r.name: r for r in pr.periodic_runs(df, 4, 2, "name").collect()}
    assert got["a"].collapsed == "go on" and [tuple(r) for r in got["a"].runs] == [(0, 6, 1)] and got["a"].n_words == 7
    assert got["b"].runs == [] and got["b"].collapsed == "" and pr.periodic_runs(df.limit(0), identity="name").count() == 0
