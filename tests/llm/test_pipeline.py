"""The pipeline against plain Python on a small fixture written as tables."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillmere.llm.secrets import python_spans  # noqa: E402


def test_against_plain(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "ba be bi bo da de di do ka ke".split() for b in "lan ren sin ton mar".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    toxic = ["vilefool", "nastyoaf"]
    bench = [(k, text(25)) for k in range(5)]
    docs, labels = [], []
    for k in range(300):
        t = text(60).split()
        if k % 4 == 0:
            t[rng.randrange(60)] = rng.choice(toxic)
        docs.append([k, " ".join(t)])
        labels.append((k, 1, int(k % 4 == 0)))
    for k in range(300, 310):
        docs.append([k, docs[2 * k - 599][1]])  # copies of clean ones
    for k in range(310, 315):
        docs.append([k, text(40) + " " + bench[k - 310][1] + " " + text(40)])
    docs.append([315, text(30) + " password=hunter2hunter2 " + text(30)])
    docs += [[316, None], [317, ""]]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in docs if not any(w in (t or "") for w in toxic)]
    seen, kept = set(), []
    for i, t in left:
        if not t or t not in seen:
            kept.append((i, t))
        seen.add(t)
    kept = [(i, t) for i, t in kept if not any(b in (t or "") for _, b in bench)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in kept:
        for _, a, b in reversed(python_spans(t)):
            t = t[:a] + "[secret]" + t[b:]
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "secrets", "bpe"]


def tables(spark, tmp_path, docs, schema):
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def test_repeats_nulls_long_texts_and_clashing_columns(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long, plain = text(60_000), text(40)
    docs = [
        (1, plain, "en", "s", 1, "x", 2.0), (1, plain, "en", "s", 1, "y", 3.0), (2, None, None, None, None, None, None), (2, None, None, None, None, "z", None),
        (None, text(30), "de", "s", 3, "x", 1.0), (3, "", "en", "t", 0, "x", 1.0), (4, long, "en", "t", 5, None, 0.0), (5, long + " more", "en", "t", 5, None, 0.0),
        (6, text(20) + " one two three four five six seven eight nine ten " + text(20), "en", "t", 5, None, 0.0), (7, "token=" + "a" * 40 + " " + text(30), "fr", "u", 5, None, 0.0),
    ]
    tables(spark, tmp_path, docs, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of the repeated row one stays, of the near copies the smaller id, the benchmark's document goes, empty rows all stay
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == [-1, 1, 2, 2, 3, 4, 7]
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_redact_keeps_repeated_rows(spark):
    from quillmere.llm.secrets import redact

    rows = [(1, "a password=hunter2hunter2 b", "x")] * 2 + [(1, "a password=hunter2hunter2 b", "y"), (None, "token=abcdefgh1", "x")]
    got = sorted((r.text, r.spans) for r in redact(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect())
    assert got == [("[secret]", "x"), ("a [secret] b", "x"), ("a [secret] b", "x"), ("a [secret] b", "y")]
