import itertools

import numpy as np
import pytest

from quillmere.llm.langid import codewords, decode, features, language_id, train

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then they think that this is the thing",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann denken sie dass dies das ding ist",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis ils pensent que c'est la chose",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y luego piensan que esta es la cosa",
}


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(" ".join(np.roll(t.split(), k)[: 8 + k % 5]), lang) for lang, t in SAMPLES.items() for k in range(16)]
    return train(spark.createDataFrame([*rows, (None, "en"), ("text", None)], "text string, lang string"))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 20])
def test_codewords_apart(n):
    code = codewords(n)
    least = min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2))
    assert least >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 8)
    assert all(abs(c.sum()) < n for c in code.T)


def test_decoding_corrects_a_wrong_bit():
    code = codewords(4)
    for k in range(4):
        for wrong in range(code.shape[1]):
            margin = code[k] * 3.0
            margin[wrong] *= -1
            assert decode(margin[None], code)[0][0].argmax() == k


def test_features_split_alike():
    """A text's vector does not depend on what stands beside it."""
    texts = ["abc", "", "Ünïcode text 123", "x" * 1000]
    for t, v in zip(texts, features(texts), strict=True):
        assert np.allclose(v, next(features([t])))


def test_predicts(spark, trained):
    assert trained["langs"] == ["de", "en", "es", "fr"]
    rows = [(k, t, "zz") for k, t in enumerate(SAMPLES.values())] + [(10, None, None), (11, "", None), (12, "123 !?", None), (0, SAMPLES["en"], "zz"), (13, SAMPLES["es"] * 3000, "x"), (14, "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = language_id(df, trained).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.lang_pred for r in got}
    assert [found[k] for k in range(4)] == list(SAMPLES) and found[13] == "es"
    assert all(r.lang_pred == "und" and r.score == 0 and r.ambiguous for r in got if r.doc_id in (10, 11, 12))
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id(df.limit(0), trained).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    empty = spark.createDataFrame([], "text string, lang string")
    assert language_id(df, train(empty)).first().lang_pred == "und"
