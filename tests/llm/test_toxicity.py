import random

import pytest

from quillmere.llm.toxicity import CharacterModel, Deobfuscator, toxicity_score, train, trigram_counts

WORDS = "garden river window letter morning paper market winter idiot moron loser scum".split()


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        toxic = k % 5 == 0
        words = [rng.choice(WORDS[:8]) for _ in range(30)]
        if toxic:
            for w in rng.sample(WORDS[8:], 2):
                words[rng.randrange(30)] = w
        rows.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return train(df, df)


def test_counts_against_plain(spark):
    df = spark.createDataFrame([(1, "ab a"), (2, None), (3, "é")], "doc_id long, text string")
    n = {r.trigram: r.n for r in trigram_counts(df).collect()}
    assert n[(0 * 28 + 1) * 28 + 2] == 1  # boundary, a, b
    assert n[(0 * 28 + 27) * 28 + 0] == 1  # another letter alone
    assert n[(0 * 28 + 1) * 28 + 0] == 1


@pytest.mark.parametrize("shown, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("idiooot", "idiot"), ("$cum", "scum"), ("l0$er", "loser"), ("s-c-u-m", "scum")])
def test_restores(trained, shown, word):
    reader = Deobfuscator(trained["model"])
    assert word in reader.words(f"the {shown}, here")
    assert word not in reader.words("the garden, here")


def test_viterbi_is_the_best_path(trained):
    """Against all paths of a small lattice of substitutions alone."""
    import itertools

    from quillmere.llm.toxicity import SIGNS, SUBSTITUTE, char_class

    model = trained["model"]
    for shown in ("1e7", "g4rd3n", "p4p3r", "w1nd"):
        best = None
        for path in itertools.product(*(SIGNS.get(c, c) for c in shown)):
            cost, a, b = sum(SUBSTITUTE for c in shown if c in SIGNS), 0, 0
            for x in path:
                cost, a, b = cost + model.rows[a][b][char_class(x)], b, char_class(x)
            cost += model.rows[a][b][0]
            best = min(best, (cost, "".join(path))) if best else (cost, "".join(path))
        word, per_letter = model.restore(shown)
        assert per_letter * len(word) <= best[0] + 1e-9
        if len(word) == len(shown):
            assert word == best[1]


def test_scores(spark, trained):
    assert {"idiot", "moron", "loser", "scum"} == set(trained["words"])
    rows = [(1, "you 1d10t garden", "x"), (2, "garden river", None), (3, None, "x"), (4, "", "x"), (1, "you 1d10t garden", "x"), (None, "s c u m " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity_score(df, trained).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert sorted((r.doc_id or 0, r.predicted) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0)]
    assert toxicity_score(df.limit(0), trained).count() == 0


def test_nothing_labelled(spark):
    df = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    empty = spark.createDataFrame([], "text string, toxic int")
    assert toxicity_score(df, train(df, empty)).first().predicted == 0


def test_spaced_words_beside_other_letters(trained):
    reader = Deobfuscator(trained["model"])
    assert "idiot" in reader.words("you are a i d i o t")
    assert "idiot" in reader.words("garden y i d i o t")
    assert {"moron", "idiot"} <= reader.words("the m o r o n i d i o t here")
    assert {"moron", "idiot", "scum"} <= reader.words("m 0 r 0 n 1 d 1 0 t $ c u m")


def test_long_sign_tokens_are_decoded(trained):
    reader = Deobfuscator(trained["model"])
    token = "garden-1d10t.river-m0r0n.window-letter.morning-paper.market-l0$er"
    assert len(token) > 60 and {"idiot", "moron", "loser", "garden", "market"} <= reader.words(token)
    assert "idiot" in reader.words("x" * 300 + "-" + "1d10t")
    assert len(trained["model"].restore("1d10t-" * 20_000, cut=True)[0]) > 50_000  # of any length


def test_scores_of_spaced_and_joined(spark, trained):
    texts = ["you are a i d i o t", "a m o r o n l o s e r", "garden-1d10t.river-m0r0n.window-letter.morning-paper.market-river", "a r i v e r", "1 2 3 4 5 6 7"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert [r.predicted for r in toxicity_score(df, trained).orderBy("doc_id").collect()] == [1, 1, 1, 0, 0]


def test_spaced_by_more_than_one_sign(trained):
    reader = Deobfuscator(trained["model"])
    for text in ("you i  d  i  o  t there", "i . d . i . o . t", "i -- d -- i -- o -- t", "i\nd\ni\no\nt", "1  d  1  0  t"):
        assert "idiot" in reader.words(text), text
    assert "idiot" in reader.restore_text("you i  d  i  o  t there")
    for n in (5, 10, 50, 1_000):
        for sign in " .-_\n":
            assert "idiot" in reader.words("you " + (sign * n).join("idiot") + " there"), (n, sign)
    assert "i" * 5_000 not in reader.restore_text("x " * 3_000) and "idiot" in reader.restore_text("garden " + " ".join("idiot" * 300))
    assert not reader.words("a - b river") & {"idiot", "ab"}
